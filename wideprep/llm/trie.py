"""Prefix trie of conversations by a splitter skeleton.

A conversation is the sequence of its turns; each distinct sequence of first turns is a node of the trie. ``prefix_trie`` returns a row a
node with figures of its subtree, without grouping by prefixes level by level:

1. a turn becomes a 16-byte digest of (role, text), a conversation its path, the digests end to end. Sorted by (path, id), the members of every
   node stand together, and its last turn's members come first, by id;
2. a sample gives splitters, real rows that cut the order into shards of about ``shard_turns`` turns. A node whose members lie in
   several shards is a prefix of the splitter between them. The trie of the splitter paths, the skeleton, is broadcast;
3. each shard is sorted and read once with a stack of the open nodes. It finishes all its own nodes; of skeleton nodes it gives partial
   aggregates. Since a shard knows the row after its last one (the next splitter), all figures are plain sums over shards;
4. the partial aggregates are added up by skeleton node, and the skeleton's ids are joined to the children of its nodes.

Identical conversations, or a common first turn, are spread over shards like any other rows, as the id is part of the order; their nodes are
skeleton nodes. The digest of a node's ends is one SHA-256 over their ids in order, so shards hand over ids joined in pieces of 4,096,
and one task streams through the pieces of a node.

Bounds: at most ``MAX_SHARDS`` splitters, hence as many skeleton paths; the sample on the driver has about 8 rows a shard; a task holds
the open nodes and the rows of their finished children, at most a shard's nodes. A conversation is one record: 20 bytes a turn.

Defined cases: rows with a null id take no part; null role or text is empty; turns go by number, a null one first, equal ones by
digest; repeated rows are repeated turns; a long text is one digest; an empty table gives no row; other
columns are not read, so clashing names do no harm. A negative id belongs to the family of the next multiple of 5 below it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, store

FAMILY, HEADS = 5, 9
DIGEST = 16
SHARD_TURNS = 32_768
MAX_SHARDS = 65_536
OVERSAMPLE = 8
PIECE = 4_096
OUT_ROWS = 8_192
#: Skeletons up to so many nodes are broadcast as (number, id) pairs, 12 bytes each; larger ones are joined by shuffle.
BROADCAST_NODES = 1_000_000
_OUT = ("kind int, skel int, parent_skel int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, shard int, seq int, ids string")
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path (16 bytes a turn), sizes (UTF-8 bytes of each turn's text) of every rebuilt conversation: the first h turns of the
    family's first conversation, then its own turns after its first h. One shuffle, by family."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    digest = F.substring(F.sha2(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256), 1, 2 * DIGEST)
    row = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("n"), digest.alias("d"), F.octet_length(text("text")).alias("b"))
    first = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))
    families = turns.where(F.col("conv_id").isNotNull()).groupBy(first.alias("first")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    each = families.select("first", "rows", F.explode(F.array_distinct(F.transform("rows", lambda r: r.c))).alias("conv_id"))

    def of(c: Column) -> Column:
        return F.filter("rows", lambda r: r.c == c)

    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    each = each.select("conv_id", of(F.col("conv_id")).alias("own"), of(F.col("first")).alias("head"), h.alias("h"))
    path = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    each = each.select("conv_id", path.alias("p"))
    return each.select("conv_id", F.unhex(F.array_join(F.transform("p", lambda r: r.d), "")).alias("path"),
                       F.transform("p", lambda r: r.b).alias("sizes"))


def shared(a: bytes, b: bytes) -> int:
    """Number of leading turns in common."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // DIGEST
    k = 0
    while a[k:k + DIGEST] == b[k:k + DIGEST]:
        k += DIGEST
    return k // DIGEST


def _splitters(convs: DataFrame, shard_turns: int) -> list[tuple[bytes, int]]:
    """Rows that start the shards after the first, in order: (path, id)."""
    n, turns = convs.agg(F.count(F.lit(1)), F.sum(F.size("sizes") + 1)).first()
    shards = min(MAX_SHARDS, -(-(turns or 0) // shard_turns))
    if shards < 2:
        return []
    share = min(1.0, OVERSAMPLE * shards / n)
    drawn = convs.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = sorted((bytes(r["path"]), r["conv_id"], r["k"]) for r in drawn.select("path", "conv_id", (F.size("sizes") + 1).alias("k")).collect())
    cuts, at, every = [], 0, sum(s[2] for s in sample) / shards
    for path, conv, k in sample:
        if at >= every * (len(cuts) + 1):
            cuts.append((path, conv))
        at += k
    return cuts


def _skeleton(cuts: list[tuple[bytes, int]]) -> tuple[list[list[int]], int]:
    """The trie of the splitters' paths: for each splitter the numbers of its nodes by depth; 0 is the root. And the number of nodes."""
    paths, n, before, last = [], 1, b"", [0]
    for path, _ in cuts:
        same = shared(before, path)
        new = len(path) // DIGEST - same
        last = last[:same + 1] + list(range(n, n + new))
        paths.append(last)
        n, before = n + new, path
    return paths, n


class _Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "waiting", "size", "skel", "depth")

    def __init__(self, depth: int, size: int, skel: int | None):
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.depth, self.size, self.skel = depth, size, skel
        self.ends, self.waiting = None, []


def _walk(rows: Iterator[tuple[int, bytes, list[int]]], shard: int, cuts: list, skeleton: list) -> Iterator[tuple]:
    """Node rows of one sorted shard, as tuples of ``_OUT``."""
    low = cuts[shard - 1][0] if shard else None
    high = cuts[shard][0] if shard < len(cuts) else None
    stack: list[_Node] = []
    seq = 0

    def number(path: bytes, depth: int, in_low: int, in_high: int) -> int | None:
        if depth == 0:
            return 0
        return skeleton[shard - 1][depth] if depth <= in_low else skeleton[shard][depth] if depth <= in_high else None

    def piece(node: _Node):
        nonlocal seq
        seq += 1
        row = (2, node.skel, None, None, None, None, None, None, None, None, None, shard, seq, ",".join(map(str, node.ends)))
        node.ends = []
        return row

    def close(node: _Node, over: bool) -> Iterator[tuple]:
        """``over``: no later row is a member; else the node goes on in the next shard."""
        parent = stack[-1] if stack else None
        node.saved += (node.n - over) * node.size
        for child in node.waiting:
            yield (*child[:5], node.conv, *child[6:])
        if parent:
            parent.n += node.n
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.children += over
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
        if node.skel is None:
            digest = (node.ends or hashlib.sha256()).hexdigest()
            row = (0, None, parent.skel, node.conv, node.depth, None, node.n, node.children, node.leaves, node.saved, digest, None, None, None)
            if parent.skel is None:
                parent.waiting.append(row)
            else:
                yield row
            return
        if node.ends:
            yield piece(node)
        yield (1, node.skel, parent.skel if parent else None, node.conv, node.depth, None, node.n, node.children, node.leaves, node.saved,
               None, None, None, None)

    rows = iter(rows)
    now = next(rows, None)
    while now is not None:
        conv, path, sizes = now
        after = next(rows, None)
        if len(stack) <= len(sizes):
            in_low = -1 if low is None else shared(path, low)
            in_high = -1 if high is None else shared(path, high)
            for depth in range(len(stack), len(sizes) + 1):
                stack.append(_Node(depth, sizes[depth - 1] if depth else 0, number(path, depth, in_low, in_high)))
        node, text = stack[-1], str(conv)
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        if node.skel is not None:
            node.ends = node.ends or []
            node.ends.append(conv)
            if len(node.ends) == PIECE:
                yield piece(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(text.encode())
        else:
            node.ends.update(f",{text}".encode())
        follows = after[1] if after is not None else high
        keep = -1 if follows is None else shared(path, follows)
        node.leaves += keep < len(sizes)  # a member that goes on from here would follow at once
        while len(stack) > keep + 1:
            yield from close(stack.pop(), True)
        now = after
    while stack:
        yield from close(stack.pop(), False)


def _partial_rows(convs: DataFrame, cuts: list, skeleton: list) -> DataFrame:
    """Every shard's rows of ``_OUT``: nodes of its own (kind 0), partial aggregates (1) and pieces of ends (2) of skeleton nodes."""
    held = convs.sparkSession.sparkContext.broadcast((cuts, skeleton))

    def deal():
        starts = held.value[0]

        def run(batch):
            keys = zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist())
            return batch | {"shard": [bisect_right(starts, key) for key in keys]}

        return run

    dealt = arrow_map(convs, ["conv_id", "path", "sizes"], "conv_id long, path binary, sizes array<int>, shard int", deal)
    placed = dealt.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    names = [f.split()[0] for f in _OUT.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "sizes")))

        def batch_of(found):
            return pa.RecordBatch.from_pydict(dict(zip(names, zip(*found))), schema=schema)

        source = rows()
        first = next(source, None)
        found = []
        while first is not None:  # one shard, as a rule
            shard, first_of_next = first[0], []

            def members(first=first, shard=shard, first_of_next=first_of_next):
                yield first[1:]
                for row in source:
                    if row[0] != shard:
                        first_of_next.append(row)
                        return
                    yield row[1:]

            for row in _walk(members(), shard, *held.value):
                found.append(row)
                if len(found) == OUT_ROWS:
                    yield batch_of(found)
                    found = []
            first = first_of_next[0] if first_of_next else None
        if found:
            yield batch_of(found)

    return placed.mapInArrow(run, _OUT)


def _ends(pieces: DataFrame) -> DataFrame:
    """skel, ends_sha256: one pass over the pieces of each node in order, a piece at a time."""
    placed = pieces.select("skel", "shard", "seq", "ids").repartition("skel").sortWithinPartitions("skel", "shard", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(skel, digest):
            return pa.RecordBatch.from_pydict({"skel": pa.array([skel], pa.int32()), "ends_sha256": [digest.hexdigest()]})

        skel = digest = None
        for batch in batches:
            for now, ids in zip(batch.column("skel").to_pylist(), batch.column("ids").to_pylist()):
                if now != skel:
                    if digest is not None:
                        yield out(skel, digest)
                    skel, digest = now, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
        if digest is not None:
            yield out(skel, digest)

    return placed.mapInArrow(run, "skel int, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node of the trie of rebuilt
    conversations. ``turns``: conv_id, turn, role, text."""
    convs = store(rebuilt(turns), "trie-conversations")
    cuts = _splitters(convs, shard_turns)
    skeleton, n_nodes = _skeleton(cuts)
    rows = store(_partial_rows(convs, cuts, skeleton), "trie-rows")
    total = rows.where("kind = 1").groupBy("skel").agg(
        F.max("parent_skel").alias("parent_skel"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    ended = total.join(_ends(rows.where("kind = 2")), "skel", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    whole = store(ended, "trie-skeleton")
    names = whole.select(F.col("skel").alias("parent_skel"), F.col("conv_id").alias("skel_conv"))
    if n_nodes <= BROADCAST_NODES:
        names = F.broadcast(names)
    nodes = rows.where("kind = 0").select(*_RESULT, "parent_skel").unionByName(
        whole.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*_RESULT, "parent_skel"))
    joined = nodes.join(names, "parent_skel", "left")
    return joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "skel_conv")).select(_RESULT)
