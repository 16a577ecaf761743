"""Dense, stable row ordinals (``_row_id`` = 1..n in a declared order).

A table in Spark has no row positions, so everything positional (record
ids, keep first/last, report order, cell audit) hangs off an explicit
ordinal. Building it scales without a single-partition window:

1. ``orderBy(order_cols)`` - range partitioning on the full (unique) order
   key, so a hot leading value is still spread over many partitions;
2. ``monotonically_increasing_id`` = (partition index << 33) + position;
3. the sorted rows are written as Parquet under the shared storage
   folder (``spark.checkpoint.dir``): the positions are now fixed, and a lost
   executor re-reads files instead of re-sorting;
4. per-partition row counts (one row per partition, a bounded table) are
   turned into start offsets with a window over that tiny table and
   broadcast back: ``_row_id = offset + position + 1``. The numbered rows are
   written again, without a shuffle and in the same order. Each file
   then holds one range of ids, disjoint from all others and known from its
   footer, so a filter on ids is pushed down and skips files, and no
   read meets an offset again.

The order key must be unique, otherwise equal keys may come back in any
order; ``with_ordinal`` can check that (one extra aggregate).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideprep.functions.numbers import ref
from wideprep.session import STORED, freed_shuffles, new_table_path, stored_table

ROW_ID = "_row_id"
_MID = "_mid"
_POS_MASK = (1 << 33) - 1
# blocks of 1,024 ordinals, some 300 bytes each, that are broadcast at most
BLOCKS_BROADCAST = 1_000_000


def _partition_of(mid: Column) -> Column:
    return F.shiftright(mid, 33)


def _position_in(mid: Column) -> Column:
    return mid.bitwiseAND(F.lit(_POS_MASK))


def store_sorted(df: DataFrame | Iterable[DataFrame], order_cols: list, name: str = "ordinal", drop=()) -> DataFrame:
    """Sort, tag with (partition, position), write once, read back.
    ``drop`` names sort-only columns that are not written. A table may come in slices (:func:`store_sorted_slices`)."""
    return store_sorted_slices([df] if isinstance(df, DataFrame) else df, order_cols, name, drop)


def store_sorted_slices(slices: Iterable[DataFrame], order_cols: list, name: str = "ordinal", drop=()) -> DataFrame:
    """:func:`store_sorted` of a table that comes in slices (one at least), every row of a slice before all of the next in the
    order: each is sorted and written by itself and its shuffle files go before the next one begins, so they never lie
    on disk for the whole table. The partitions of a slice are numbered after those of the slices before it."""
    path, first = None, 0
    for df in slices:
        spark = df.sparkSession
        path = path or new_table_path(spark, name)
        tagged = df.orderBy(*order_cols).withColumn(_MID, F.monotonically_increasing_id() + F.lit(first << 33))
        with freed_shuffles(spark):
            tagged.drop(*drop).write.mode("append").options(**STORED).parquet(path)
        last = spark.read.parquet(path).agg(F.max(_partition_of(F.col(_MID)))).first()[0]
        first = 0 if last is None else last + 1
    return spark.read.parquet(path)


def attach_ordinal(stored: DataFrame, name: str = ROW_ID, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Turn the stored ``_mid`` into a stored dense 1-based ordinal. One scan of
    ``_mid`` alone finds the offsets. ``shape``: a projection of the numbered
    rows, made while they are written."""
    spark = stored.sparkSession
    counts = stored.groupBy(_partition_of(F.col(_MID)).alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = stored.join(F.broadcast(offsets), _partition_of(F.col(_MID)) == F.col("_pid"))  # one row a partition
    rid = (F.col("_off") + _position_in(F.col(_MID)) + 1).alias(name)
    keep = [F.col("`" + c.replace("`", "``") + "`") for c in stored.columns if c != _MID]
    path = new_table_path(spark, "numbered")
    numbered = joined.select(rid, *keep)
    with freed_shuffles(spark):
        (shape(numbered) if shape else numbered).write.options(**STORED).parquet(path)
    return spark.read.parquet(path)


def numbered(stored: DataFrame, name: str = ROW_ID) -> DataFrame:
    """The rows of :func:`store_sorted` with the ordinal of :func:`attach_ordinal`, worked out where they are read: nothing is
    written again, and a reader that leaves the ordinal out does not pay for it. The driver reads one count a partition."""
    counts = dict(stored.groupBy(_partition_of(F.col(_MID)).alias("_pid")).agg(F.count(F.lit(1)).alias("_n")).collect())
    starts, rows = [], 0
    for pid in range(max(counts, default=0) + 1):
        starts.append(rows)
        rows += counts.get(pid, 0)
    start = F.get(F.expr(f"array({', '.join(f'{s}L' for s in starts)})"), _partition_of(F.col(_MID)).cast("int"))
    keep = [F.col("`" + c.replace("`", "``") + "`") for c in stored.columns if c != _MID]
    return stored.select((start + _position_in(F.col(_MID)) + 1).alias(name), *keep)


def with_ordinal(df: DataFrame, order_cols: list, name: str = ROW_ID, check_unique: bool = False) -> DataFrame:
    """``df`` plus a dense ordinal column ``name`` following ``order_cols``."""
    if check_unique:
        keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
        dup = df.groupBy(*keys).count().where("count > 1").limit(1).count()
        if dup:
            raise ValueError("order key is not unique; add columns until it is")
    return attach_ordinal(store_sorted(df, order_cols), name)


def _kept_blocks(kept: DataFrame, name: str) -> DataFrame:
    """(_block, _words, _starts): for each 1,024 ordinals that hold one of ``kept``, its bits in 16 words and the number of kept ordinals before
    each word. The running sum is taken by blocks within a million ordinals, then over those, one small row each."""
    i = ref(name)
    words = ", ".join(f"bit_or(if((shiftright({i}, 6) & 15) = {w}, shiftleft(1L, CAST({i} & 63 AS INT)), 0L))" for w in range(16))
    found = kept.where(F.col(i).isNotNull()).groupBy(F.expr(f"shiftright({i}, 10)").alias("_block")).agg(F.expr(f"array({words})").alias("_words"))
    blocks = stored_table(found, "kept-ordinals").select(
        "_block", "_words", F.shiftright("_block", 10).alias("_far"), F.expr("aggregate(_words, 0L, (n, w) -> n + bit_count(w))").alias("_n"))
    far = blocks.groupBy("_far").agg(F.sum("_n").alias("_far_n"))
    before_far = Window.orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    far = far.select(F.col("_far").alias("_at"), F.coalesce(F.sum("_far_n").over(before_far), F.lit(0)).alias("_before_far"))
    before = Window.partitionBy("_far").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(far), F.col("_far") == F.col("_at"))
    starts = "transform(_words, (w, k) -> aggregate(slice(_words, 1, k), _before_far + _before, (n, x) -> n + bit_count(x)))"
    return placed.select("_block", "_words", F.expr(starts).alias("_starts"))


def renumbered(df: DataFrame, kept: DataFrame, name: str = ROW_ID, blocks: int = BLOCKS_BROADCAST) -> DataFrame:
    """The rows of ``df`` whose unique ordinal is one of ``kept``, which get a dense ordinal in the same order. The kept ordinals are
    one bit each, which is broadcast, so the rows of ``df``, however wide, are neither shuffled nor sorted. Above ``blocks``
    blocks of ordinals (a thousand million) Spark joins them as it sees fit."""
    found = stored_table(_kept_blocks(kept, name), "kept-blocks")
    if found.count() <= blocks:
        found = F.broadcast(found)
    i = ref(name)
    place, bit = f"CAST(shiftright({i}, 6) & 15 AS INT)", f"CAST({i} & 63 AS INT)"
    rows = df.join(found, F.expr(f"shiftright({i}, 10)") == F.col("_block")).where(
        F.expr(f"get(_words, {place}) & shiftleft(1L, {bit})") != 0)
    number = F.expr(f"get(_starts, {place}) + bit_count(get(_words, {place}) & ~shiftleft(-1L, {bit})) + 1")
    return rows.select(number.alias(name), *[F.col(ref(c)) for c in df.columns if c != name])
