"""Best-fit packing into sequences of several permitted lengths, chosen jointly.

A document longer than the largest permitted length is cut into full pieces and a rest; no token is dropped. Pieces are
packed longest first. A piece goes to the open sequence with the least room that still takes it. If none does, a new
one is opened at the permitted length with the least net cost: its own cost, less the worth of the room it leaves, where
room is worth the cheapest price a token of any permitted length, discounted by how well earlier room was used. At the
end every sequence shrinks to the smallest permitted length that holds its contents. A sequence of length C costs
``C + C * C / quadratic`` (linear layers and attention).

Pieces are dealt to packing groups of about ``group_pieces`` by a hash of id, piece, length and number of the stored row (so that rows
alike, or without an id, spread as well), each sorted by length; one group
is packed by one task that reads its rows as a stream and keeps only sequences that still have room; a task packs several groups
in turn, so the shuffle has far fewer partitions than there are groups. The waste of a group is a few open sequences, so
many groups cost little. Only lengths are shuffled, never texts.

Defined cases: null and empty texts have no tokens and take no part (no row); lengths are what ``lengths`` holds, so ties
are broken by id and piece; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

CAPACITIES = (2048, 4096, 8192, 16384)
QUADRATIC = 65_536
GROUP_PIECES = 4096
#: Groups one task may pack in turn; more tasks than ``spark.sql.shuffle.partitions`` run only beyond it.
TASK_GROUPS = 64
SCHEMA = ("doc_id long, piece int, token_start long, token_end long, pack_group int, bin long, bin_capacity int, "
          "bin_offset int, bin_fill int")


def byte_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens for byte-level models: a token is a UTF-8 byte. For other vocabularies see tokens.token_lengths."""
    return docs.select(F.col(key).cast("long").alias("doc_id"),
                       F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_tokens"))


def cost(capacity: int, quadratic: float = QUADRATIC) -> float:
    return capacity + capacity * capacity / quadratic


class Packer:
    """Best fit over one group; pieces come longest first. ``full`` gets every sequence that takes no more."""

    def __init__(self, capacities: tuple[int, ...], quadratic: float):
        self.caps = capacities
        self.costs = [cost(c, quadratic) for c in capacities]
        self.price = min(x / c for x, c in zip(self.costs, capacities))
        self.room: list[tuple[int, int]] = []  # (room left, sequence), sorted
        self.open: dict[int, tuple[int, list]] = {}
        self.made = 0
        self.offered = self.used = 1.0  # room left at opening, and how much of it was filled later

    def _opening(self, length: int) -> int:
        worth = self.price * min(1.0, self.used / self.offered)
        first = bisect_left(self.caps, length)
        return min(range(first, len(self.caps)), key=lambda i: (self.costs[i] - worth * (self.caps[i] - length)) / length)

    def add(self, length: int, piece: tuple) -> None:
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            left, seq = self.room.pop(at)
            self.used += length
        else:
            left, seq = self.caps[self._opening(length)], self.made
            self.made += 1
            self.open[seq] = (left, [])
            self.offered += left - length
        self.open[seq][1].append((length, piece))
        insort(self.room, (left - length, seq))

    def close(self, seqs) -> Iterator[tuple]:
        """Rows of these sequences, shrunk to the smallest permitted length."""
        for seq in seqs:
            _, pieces = self.open.pop(seq)
            fill = sum(n for n, _ in pieces)
            capacity, offset = self.caps[bisect_left(self.caps, fill)], 0
            for n, piece in pieces:
                yield (*piece, seq, capacity, offset, fill)
                offset += n

    def full(self) -> Iterator[tuple]:
        """Sequences without any room."""
        end = bisect_left(self.room, (1, -1))
        done, self.room = self.room[:end], self.room[end:]
        yield from self.close(seq for _, seq in done)

    def rest(self) -> Iterator[tuple]:
        done, self.room = self.room, []
        yield from self.close(seq for _, seq in done)


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, quadratic: float = QUADRATIC,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece: doc_id, piece, token_start, token_end (within the document), pack_group, bin (unique within
    the group), bin_capacity, bin_offset (where the piece starts in its sequence), bin_fill (tokens in the sequence)."""
    caps = tuple(sorted(set(capacities)))
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    longest = caps[-1]
    pieces = lengths.filter(F.col("n_tokens") > 0).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"),
        F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / longest).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * longest
    pieces = store(pieces.select("doc_id", "piece", start.alias("token_start"), F.least(start + longest, F.col("n_tokens")).alias("token_end"),
                                 F.monotonically_increasing_id().alias("row")), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    length = (F.col("token_end") - F.col("token_start")).cast("int")
    dealt = pieces.withColumn("length", length).withColumn(
        "pack_group", F.pmod(F.xxhash64("doc_id", "piece", "length", "row"), F.lit(groups)).cast("int"))
    tasks = min(groups, max(int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // TASK_GROUPS)))
    dealt = dealt.repartition(tasks, "pack_group").sortWithinPartitions(
        "pack_group", F.col("length").desc(), "doc_id", "piece")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows) -> Iterator[pa.RecordBatch]:
            rows = list(rows)
            for i in range(0, len(rows), 8192):
                cols = list(zip(*rows[i:i + 8192]))
                order = dict(zip(("doc_id", "piece", "token_start", "token_end", "pack_group", "bin", "bin_capacity",
                                  "bin_offset", "bin_fill"), cols))
                types = {"doc_id": pa.int64(), "token_start": pa.int64(), "token_end": pa.int64(), "bin": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(order[n], types.get(n, pa.int32())) for n in names], names)

        packer, group = Packer(caps, quadratic), None
        for batch in batches:
            b = batch.to_pydict()
            for d, p, s, e, n, g in zip(b["doc_id"], b["piece"], b["token_start"], b["token_end"], b["length"], b["pack_group"]):
                if g != group:
                    yield from out(packer.rest())
                    packer, group = Packer(caps, quadratic), g
                packer.add(n, (d, p, s, e, g))
            yield from out(packer.full())
        yield from out(packer.rest())

    return dealt.select("doc_id", "piece", "token_start", "token_end", "length", "pack_group").mapInArrow(run, SCHEMA)


def total_cost(packed: DataFrame, quadratic: float = QUADRATIC) -> DataFrame:
    """Sequences, tokens, room and cost of a packing."""
    c = F.col("bin_capacity").cast("double")
    bins = packed.filter(F.col("bin_offset") == 0)
    return bins.agg(F.count(F.lit(1)).alias("bins"), F.sum("bin_fill").alias("tokens"), F.sum("bin_capacity").alias("room"),
                    F.sum(c + c * c / quadratic).alias("cost"))
