"""SimHash near-duplicates through an inverted index over byte positions, with count filtering.

A 64-bit fingerprint has eight bytes. Two fingerprints that differ in at most d bits differ in at most d bytes, so they share
at least 8 - d bytes in place: the guaranteed minimum of matches. The index lists fingerprints under several positional
bytes at once: a family of position sets such that every choice of 8 - d positions holds one of the sets whole. So each
qualifying pair meets in a list, and lists stay short, where lists under one byte would each hold N / 256 entries. Within
a list the shared positional bytes of each pair are tallied, pairs below the minimum are dropped, and the rest are
verified by their bit distance.

Equal fingerprints are one entry. A list longer than ``BLOCK`` is dealt to blocks, and every pair of blocks is compared by its own
task, so no list has to fit one task; what leaves a task is a spanning forest of the verified links (at most one link
for each entry), never all pairs. Components are then those of all links.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and is linked like any other; one with
fewer words than the shingle length has its whole sequence as its one shingle; repeated rows share a component; rows with a null
id get the component of their fingerprint; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, new_name, store
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK = 1024
#: Entries that share a list by chance, on average, before lists are keyed by one more byte.
CHANCE = 4
#: Words of 64 row numbers that are broadcast at most, some 50 bytes each.
BROADCAST_WORDS = 1_000_000
A_TO_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = (text or b"").translate(A_TO_Z).split()  # splits at \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        block = np.array(hashes[i:i + 8192], np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (set_bits * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, number: str | None = None) -> DataFrame:
    """doc_id, fp, row: one row for each document; ``row`` is the column ``number``, if given."""

    def make():
        def work(batch):
            raw = batch["body"].cast(pa.binary()).to_pylist()
            return {"doc_id": batch["doc_id"], "fp": [fingerprint(t, shingle) for t in raw], "row": batch["row"]}

        return work

    row = (F.col(number) if number else F.lit(None)).cast("long").alias("row")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"), row)
    return arrow_map(rows, ["doc_id", "body", "row"], "doc_id long, fp long, row long", make)


def position_sets(size: int, shared: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions such that any ``shared`` of the eight positions hold one of them whole: the positions are
    dealt to the most groups of which one must still get ``size``, and each group's subsets are taken."""
    groups = max(g for g in range(1, 9) if (size - 1) * g < shared and 8 >= g * size)
    dealt = [tuple(range(g, 8, groups)) for g in range(groups)]
    return sorted({c for d in dealt for c in combinations(d, size)})


def _key_size(entries: int, shared: int) -> int:
    """Bytes in a key: enough that lists hold few entries by chance; any size keeps every qualifying pair."""
    size = 1
    while size < shared and entries / 256**size > CHANCE:
        size += 1
    return size


def _forest(fps: np.ndarray, group: np.ndarray, side: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links that connect what pairs within ``max_bits`` connect inside each run of equal ``group``. Pairs of one side of a
    pair of blocks (equal ``side`` of 0 or 1) are left to that block's own task; ``side`` 2 marks a block by itself."""
    bits, label = fps.view(np.uint64), np.arange(len(fps))
    at, step, out_a, out_b = np.arange(len(fps)), 1, [], []
    while True:  # entries ``step`` apart, for as long as some list is that long
        at = at[at + step < len(fps)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return out_a, out_b
        x = at[(label[at] != label[at + step]) & ((side[at] == 2) | (side[at] != side[at + step]))]
        differ = bits[x] ^ bits[x + step]
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # shared positional bytes
        x, differ = x[tally >= 8 - max_bits], differ[tally >= 8 - max_bits]
        for i in x[np.bitwise_count(differ) <= max_bits].tolist():
            a, b = i, i + step
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                out_a.append(int(fps[i]))
                out_b.append(int(fps[i + step]))
        while len(x) and not np.array_equal(label, label[label]):
            label = label[label]
        step += 1


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all of ``distinct`` (fp) that lie within ``max_bits`` of each other, directly."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be between 0 and 7")
    shared = 8 - max_bits
    sets = position_sets(_key_size(distinct.count(), shared), shared)
    masks = F.array(*[F.lit(_signed(sum(0xFF << (8 * p) for p in s))) for s in sets])
    entries = distinct.select("fp", F.posexplode(masks).alias("set", "mask"))
    entries = entries.select("fp", "set", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"))
    # lists of one entry hold no pair; longer ones know their number of blocks
    lists = entries.groupBy("set", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = store(lists.select("set", "bytes", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "lists")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    dealt = entries.join(lists, ["set", "bytes"]).withColumn("own", own)
    dealt = dealt.select("fp", "set", "bytes", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")
    dealt = dealt.select("fp", "set", "bytes", low, high, side)
    keys = ["set", "bytes", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # rows of the last list, which may go on in the next batch
        for batch in chain(batches, [None]):
            rows = [] if batch is None else [np.array(batch.column(c), np.int64) for c in range(6)]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows)] if rows else kept
            if not rows or not len(rows[0]):
                continue
            group = np.concatenate([[0], np.cumsum(np.any([np.diff(c) != 0 for c in rows[1:5]], axis=0))])
            cut = len(group) if batch is None else int(np.searchsorted(group, group[-1]))
            kept = [c[cut:] for c in rows]
            a, b = _forest(rows[0][:cut], group[:cut], rows[5][:cut], max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).select("fp", *keys, "side").mapInArrow(
        compare, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _classes(docs: DataFrame, key: str, text: str, shingle: int, max_bits: int, number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, row) of each document, and (fp, root, component_id) of each fingerprint."""
    prints = store(fingerprints(docs, key, text, shingle, number), "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"), max_bits))
    member = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id")
    member = store(member, "members")
    firsts = store(member.groupBy("root").agg(F.min("first_id").alias("component_id")), "firsts")
    return prints, store(member.join(firsts, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links, itself included): one row for each document."""
    prints, classes = _classes(docs, key, text, shingle, max_bits)
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows and columns of ``docs`` with one document of each component: the one with the smallest id; of rows with that id in
    the component, one (of the smallest fingerprint). An id that stands over texts of several components stays in each that it
    represents. A component whose ids are all null keeps one row."""
    number = new_name(docs, "row")
    # numbered and written once, so that the number names a row in every later read; only numbers meet in the aggregate and the choice
    numbered = store(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    prints, classes = _classes(numbered, key, text, shingle, max_bits, number)
    members = prints.join(classes, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = store(members.groupBy("root").agg(F.min(F.struct("fp", "row")).alias("first")).select(F.col("first.row").alias(number)), "kept")
    return rows_numbered(numbered, keep, number).select(*(F.col(f"`{c}`") for c in docs.columns))


def rows_numbered(rows: DataFrame, keep: DataFrame, number: str) -> DataFrame:
    """The rows whose ``number`` is in ``keep``. Numbers run on inside a stored file, so 64 of them are one word of bits; up to
    ``BROADCAST_WORDS`` words are broadcast and no row is shuffled. More are met by a join on the number."""
    at, bits = new_name(rows, "at"), new_name(rows, "bits")
    words = keep.groupBy(F.shiftright(number, 6).alias(at)).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(number).bitwiseAND(63).cast("int"))).alias(bits))
    words = store(words, "kept-words")
    if words.count() > BROADCAST_WORDS:
        return rows.join(keep, number, "left_semi")
    met = rows.join(F.broadcast(words), F.shiftright(number, 6) == F.col(at))
    return met.filter(F.getbit(F.col(bits), F.col(number).bitwiseAND(63).cast("int")) == 1)
