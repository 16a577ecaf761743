"""Normalised Indel similarity as a native expression.

ratio(a, b) = 2 * LCS(a, b) / (len(a) + len(b)); 1.0 for two empty strings.
One side is a fixed text (a header alias) of at most ``MAX_FIXED``
characters: the dynamic programme's row is then one number, a bit for each
character of the fixed text, and each character of the other side costs a
few operations on it. No row is copied.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wideprep.functions.text import _col

MAX_FIXED = 60  # the sum of two rows still fits a signed 64-bit number


def fixed_text(text: str) -> Column:
    """Struct of a fixed text: a, its distinct characters d, where each stands as bits m (0 first, for all other characters)."""
    if len(text) > MAX_FIXED:
        raise ValueError(f"a fixed text has at most {MAX_FIXED} characters")
    distinct = "".join(dict.fromkeys(text))
    bits = [0] + [sum(1 << i for i, c in enumerate(text) if c == d) for d in distinct]
    return F.struct(F.lit(text).alias("a"), F.lit(distinct).alias("d"), F.array(*[F.lit(b).cast("long") for b in bits]).alias("m"))


def lcs_length(chars: Column, fixed: Column) -> Column:
    """Length of the longest common subsequence of an array of characters and a :func:`fixed_text`."""
    n = F.length(fixed["a"])
    full = F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1

    def step(row: Column, ch: Column) -> Column:
        common = row.bitwiseAND(F.element_at(fixed["m"], F.instr(fixed["d"], ch) + 1))
        return (row + common).bitwiseOR(row - common).bitwiseAND(full)

    return n - F.bit_count(F.aggregate(chars, full, step))


def characters(c) -> Column:
    return F.filter(F.split(_col(c), ""), lambda x: x != "")


def ratio_bound(c, fixed: Column) -> Column:
    """What the ratio cannot exceed, by the lengths alone."""
    n, k = F.length(_col(c)), F.length(fixed["a"])
    return F.when(n + k == 0, F.lit(1.0)).otherwise(2.0 * F.least(n, k) / (n + k))


def indel_ratio(c, fixed: Column, chars: Column | None = None) -> Column:
    total = F.length(_col(c)) + F.length(fixed["a"])
    chars = characters(c) if chars is None else chars
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(chars, fixed) / total)
