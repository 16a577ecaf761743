"""Proportional stratified interleaving into shards, with DataFrame functions only.

Rows are ranked inside their source in a seeded random order. Row r of n gets the fractional rank (r - 1 + u) / n, where
u in [0, 1) is drawn from the seed and the source, so that many small sources do not all meet at one place. All rows
sorted by fractional rank are cut into equal runs; each run holds every source in proportion, and counts differ by one
at most (law ``rows``).

No rank or cut needs one task: rows fall into cells by the leading digits of their random key (or fractional rank),
cells are counted map-side, and a row's place is the count before its cell plus its place inside. A source with a third
of all rows is spread over its cells like any other.

Defined cases: a null source is a source of its own; a null text has size 1 and the checksum of the empty text; rows of one id are
placed one after another (equal rows are interchangeable), unless there are so many (a null id, say) that they would fill cells by
themselves: then each is drawn by its stored number too; an empty table gives an empty result; texts, long ones as well, are
read once to measure them and never shuffled; other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store

#: Rows a cell should hold, and cells that are summed in one task.
CELL_ROWS = 500
RUN = 1024
HOT_IDS = 1000


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _placed(rows: DataFrame, groups: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """``rows`` and ``name``: the place, from 0, in the order (cell, order) inside ``groups``."""
    counts = store(rows.groupBy(*groups, cell).agg(F.count(F.lit(1)).alias("__n")), "cells")
    counts = counts.withColumn("__run", F.floor(F.col(cell) / RUN))
    earlier = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy(*groups, "__run").agg(F.sum("__n").alias("__n")).select(
        *groups, "__run", earlier(Window.partitionBy(*groups).orderBy("__run")).alias("__before"))
    starts = counts.withColumn("__here", earlier(Window.partitionBy(*groups, "__run").orderBy(cell))).join(
        runs, [*groups, "__run"]).select(*groups, cell, (F.col("__before") + F.col("__here")).alias("__start"))
    inside = Window.partitionBy(*groups, cell).orderBy(*order)
    keys = [*groups, cell]
    return (rows.withColumn("__in", F.row_number().over(inside) - 1).join(starts, keys)
            .withColumn(name, F.col("__start") + F.col("__in")).drop("__start", "__in"))


def interleave(df: DataFrame, shards: int = 16, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, text_crc32, place (position in the whole interleaved order), shard, slot."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = df.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    narrow = narrow.withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    narrow = store(narrow.withColumn("row", F.monotonically_increasing_id()), "measured")
    total = narrow.count()
    cells = max(1, -(-total // CELL_ROWS))

    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # rows of an id that would fill cells by itself (at most HOT_IDS ids) are drawn by their stored number as well
    often = narrow.groupBy(id_text.alias("hot")).agg(F.count(F.lit(1)).alias("rows_of")).filter(
        F.col("rows_of") > max(CELL_ROWS, total // HOT_IDS)).select("hot")
    drawn = narrow.join(F.broadcast(store(often, "hot-ids")), id_text == F.col("hot"), "left")
    own = F.when(F.col("hot").isNotNull(), F.concat(F.lit(":"), F.col("row").cast("string"))).otherwise("")
    drawn = drawn.withColumn("draw", _unit(F.concat(F.lit(f"{seed}:"), id_text, own))).drop("hot", "row")
    drawn = drawn.withColumn("cell", F.floor(F.col("draw") * cells).cast("int"))
    ranked = _placed(drawn, ["src"], "cell", ["draw", "doc_id", "text_crc32", "size"], "rank")
    sizes = store(narrow.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "sources")
    phase = _unit(F.concat(F.lit(f"{seed}/"), F.col("src")))
    spread = store(ranked.join(sizes, "src").withColumn("fraction", (F.col("rank") + phase) / F.col("n")), "ranked")
    spread = spread.withColumn("cut", F.least(F.floor(F.col("fraction") * cells), F.lit(cells - 1)).cast("int"))
    spread = spread.withColumn("all", F.lit(0))
    placed = _placed(spread, ["all"], "cut", ["fraction", "src", "rank"], "place")

    base, extra = divmod(total, shards)
    head = extra * (base + 1)  # the first ``extra`` shards hold one row more
    p = F.col("place")
    late = F.floor((p - head) / max(base, 1))
    shard = F.when(p < head, F.floor(p / (base + 1))).otherwise(late + extra)
    slot = F.when(p < head, p % (base + 1)).otherwise((p - head) % max(base, 1))
    return placed.select("doc_id", "source", "size", "text_crc32", "place",
                         shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
