"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Each document is encoded whole with a given byte-level vocabulary, only its length is kept, and lengths are counted
before anything is shuffled. From the histogram, suffix sums answer for every context limit L: how many documents are
longer, how many tokens there are in all, how many remain if each document is cut at L, and which quantile L is.

Defined cases: null and empty texts have length 0 and are counted there; long texts, also of nothing but white space, are encoded
whole; an empty table has an empty histogram; texts of special tokens are ordinary text; repeated rows count each time; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, file_bytes, store

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation rule this vocabulary was made with
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: Unicode white space, as the pattern's engine takes it
WHITE_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space is cut by hand from this length on; the engine fails above some 700,000.
LONG_RUN = 65_536
#: Lengths in one run of the suffix sums' inner step.
SPAN = 256


def encoder(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_length(vocabulary, text: str, long_run: int = LONG_RUN) -> int:
    """Tokens of a text. The pattern's engine runs out of stack on very long runs of white space, so such a run is cut out where the pattern
    cuts: all of it at the end of the text, else all but its last character, which goes with what follows."""
    if len(text) < long_run:
        return len(vocabulary.encode_ordinary(text))
    total = at = 0
    for run in re.finditer(f"{WHITE_SPACE}{{{long_run},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(vocabulary.encode_ordinary(text[at:run.start()])) + len(vocabulary._encode_single_piece(text[run.start():end]))
        at = end
    return total + len(vocabulary.encode_ordinary(text[at:]))


def token_lengths(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns, and ``n_tokens`` of each whole text."""
    raw = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))  # one vocabulary file: about a megabyte
    types = dict(df.dtypes)

    def make():
        vocabulary_ = encoder(raw.value)

        def work(batch):
            lengths = [encoded_length(vocabulary_, t) if t else 0 for t in batch["__text"].to_pylist()]
            return {**{c: batch[c] for c in keep}, "n_tokens": lengths}

        return work

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_tokens long"])
    return arrow_map(df.select(*keep, F.col(text).cast("string").alias("__text")), [*keep, "__text"], schema, make)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """length, documents: one row for each length that occurs; counted map-side first."""
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("documents"))


def limits_table(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: documents of that length, documents longer, tokens in
    documents no longer, tokens kept if longer documents are cut, tokens lost, all tokens, and the share of documents
    that fit. Sums run inside spans of ``SPAN`` lengths; spans meet as one row each."""
    histogram = store(histogram, "histogram")  # it is read for the spans and for the lengths; texts are encoded once
    h = histogram.select("length", "documents", (F.col("length") * F.col("documents")).alias("tokens"),
                         F.floor(F.col("length") / SPAN).alias("span"))
    up = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spans = h.groupBy("span").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t")).select(
        "span", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("d_before"),
        F.coalesce(F.sum("t").over(up), F.lit(0)).alias("t_before"),
        F.sum("d").over(whole).alias("all_documents"), F.sum("t").over(whole).alias("all_tokens"))
    inside = Window.partitionBy("span").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    j = h.withColumn("d_in", F.sum("documents").over(inside)).withColumn("t_in", F.sum("tokens").over(inside)).join(spans, "span")
    fit, fit_tokens = F.col("d_before") + F.col("d_in"), F.col("t_before") + F.col("t_in")
    longer = F.col("all_documents") - fit
    kept = fit_tokens + longer * F.col("length")
    return j.select(
        "length", "documents", longer.alias("documents_longer"), fit_tokens.alias("tokens_fitting"),
        kept.alias("tokens_truncated"), (F.col("all_tokens") - kept).alias("tokens_lost"),
        "all_documents", "all_tokens", (fit / F.col("all_documents")).alias("quantile"))


def length_quantile(limits: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share ``q`` of the documents does not exceed."""
    return limits.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """Tokens that remain when every document is cut at ``limit``, whether or not that length occurs."""
    below = F.when(F.col("length") <= limit, F.col("length")).otherwise(limit)
    return limits.agg(F.coalesce(F.sum(F.col("documents") * below), F.lit(0)).alias("tokens"))
