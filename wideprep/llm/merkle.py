"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf. Leaves are sorted by (source, id) with a dense ordinal, so each knows its place in its source; 4,096 consecutive ones
(three levels of 16) are a superblock. Then:

1. superblocks reduce their leaves to one digest each, a task never holding more than one superblock's narrow rows;
2. the levels above, a 4,096th of the rows, are built by grouping runs of 16: per source up to its subroot, then over the
   subroots up to the root;
3. from the root downwards every node hands its siblings on to its children, so that each superblock gets the outer nodes its proofs need;
4. leaves and outer nodes are cogrouped by superblock: ``applyInPandas`` reduces the leaves again, joins each leaf's siblings with the outer
   ones, and folds the leaf (or its tampered form) up to the root.

A hot source is split over superblocks; no source or level meets in one task. Stored: narrow rows, three times a leaf, and the upper levels.

Defined cases: null fields are ``-`` in a leaf; a null source is a source of its own, the first; a null id comes first in its source and is not tampered;
rows of one id in one source go by their leaf digest; repeated rows are repeated leaves; a long text is hashed as one
value; an empty table gives no row; other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideprep.operators.ordinal import with_ordinal

from .common import store

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
LOCAL_LEVELS = 3
#: More sources than this are joined by (source, salt) and not broadcast; a row of the broadcast is about 50 bytes and the name.
BROADCAST_SOURCES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(values: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each `-` or its byte count, a colon and itself."""
    def field(c):
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*(field(c) for c in values)), 256)


def tampered() -> Column:
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, forged: digests as 32 bytes; forged is null for rows that are not tampered with."""
    values = [F.col(c) for c in FIELDS]
    changed = [*values[:-1], F.translate(F.col("text"), _UPPER, _LOWER)]
    return docs.select("doc_id", "source", F.unhex(leaf_digest(values)).alias("leaf"),
                       F.when(tampered(), F.unhex(leaf_digest(changed))).alias("forged"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], size: int, local_levels: int) -> list[list[str]]:
    """The leaves and the levels above them inside one superblock of a source of ``size`` leaves."""
    out = [nodes]
    while size > 1 and len(out) <= local_levels:
        below, size = out[-1], -(-size // FAN)
        out.append([_sha("".join(below[i:i + FAN])) for i in range(0, len(below), FAN)])
    return out


def _placed(docs: DataFrame, block: int) -> DataFrame:
    """Leaves with the number of their source (``tree``), its ``size``, the superblock and the place in it."""
    # stored first: range boundaries are drawn from the narrow rows, so texts are digested once
    rows = with_ordinal(store(leaves(docs), "merkle-leaves"), ["source", "doc_id", "leaf"], name="at")
    found = rows.groupBy("source").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("size"))
    found = with_ordinal(found, ["start"], name="tree")
    if found.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(found.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    else:
        salted = found.withColumnRenamed("source", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = rows.join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("at") % 64 == F.col("salt")))
    place = F.col("at") - F.col("start")
    # ids travel as text: pandas would turn integers beside nulls into floats
    return joined.select(F.col("doc_id").cast("string").alias("doc_id"), "leaf", "forged", "tree", "size", F.floor(place / block).alias("block"), (place % block).cast("int").alias("place"))


def _tops(placed: DataFrame, local_levels: int) -> DataFrame:
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        size = int(pdf["size"].iloc[0])
        top = _levels([bytes(x).hex() for x in pdf["leaf"]], size, local_levels)[-1]
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "idx": [pdf["block"].iloc[0]], "digest": top, "size": [-(-size // FAN**local_levels)]})

    rows = placed.select("tree", "block", "size", "place", "leaf")
    return store(rows.groupBy("tree", "block").applyInPandas(reduce, "tree long, idx long, digest string, size long"), "merkle-tops")


def _grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Runs of 16 level by level up to one node a tree: the stored runs of each level, and the trees' roots (tree, digest)."""
    levels, roots = [], nodes.where("size = 1").select("tree", "digest")
    nodes = nodes.where("size > 1")
    while not nodes.isEmpty():
        run = F.sort_array(F.collect_list(F.struct("idx", "digest")))
        runs = store(nodes.groupBy("tree", F.floor(F.col("idx") / FAN).alias("up")).agg(
            F.transform(run, lambda x: x.digest).alias("run"), F.ceil(F.first("size") / FAN).alias("size")), "merkle-runs")
        levels.append(runs)
        above = runs.select("tree", F.col("up").alias("idx"), F.sha2(F.array_join("run", ""), 256).alias("digest"), "size")
        roots = roots.unionByName(above.where("size = 1").select("tree", "digest"))
        nodes = above.where("size > 1")
    return levels, store(roots, "merkle-roots")


def _hand_down(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """roots: tree, sides, and what else is handed on. Returns them for every lowest node: tree, idx, ..., sides array<struct<before, after>>,
    from the node's own run up to the root."""
    extra = [c for c in roots.columns if c not in ("tree", "sides")]
    nodes = roots.withColumn("idx", F.lit(0).cast("long"))
    roots = nodes
    for runs in reversed(levels):
        top = runs.where("size = 1").join(roots.drop("idx"), "tree")
        inner = runs.where("size > 1").join(nodes.withColumnRenamed("idx", "up"), ["tree", "up"])
        at = F.posexplode("run").alias("k", "own")
        opened = top.unionByName(inner.select(top.columns)).select("*", at)
        side = F.struct(F.array_join(F.slice("run", F.lit(1), F.col("k")), "").alias("before"),
                        F.array_join(F.slice("run", F.col("k") + 2, F.lit(FAN)), "").alias("after"))
        children = opened.select("tree", (F.col("up") * FAN + F.col("k")).alias("idx"), *extra, F.concat(F.array(side), "sides").alias("sides"))
        # trees whose root lies at this level or below have no run here
        nodes = store(children.unionByName(roots.join(runs.select("tree").distinct(), "tree", "left_anti").select(children.columns)), "merkle-sides")
    return nodes


def manifest(docs: DataFrame, local_levels: int = LOCAL_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; a row for each row of ``docs``."""
    placed = _placed(docs, FAN**local_levels)
    levels, subroots = _grow(_tops(placed, local_levels))
    n = subroots.count()
    top_levels, top = _grow(subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("idx"), "digest", F.lit(n).cast("long").alias("size")))
    root = top.first()
    no_sides = F.array().cast("array<struct<before:string,after:string>>")
    sides = _hand_down(top_levels, top.select("tree", no_sides.alias("sides")))
    sides = sides.select((F.col("idx") + 1).alias("tree"), "sides").join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    outer = _hand_down(levels, sides).withColumnRenamed("idx", "block")
    root = root["digest"] if root else None

    def finish(pdf: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        sides = [(s["before"], s["after"]) for s in out["sides"].iloc[0]]
        outer_text = "".join(b + a for b, a in sides)
        local = _levels([bytes(x).hex() for x in pdf["leaf"]], int(pdf["size"].iloc[0]), local_levels)
        climbs: dict[tuple[int, int], tuple[str, list]] = {}

        def above(level: int, k: int):
            """Siblings' text and (before, after) pairs of node k of a level, from its run up to the root."""
            if level == len(local) - 1:
                return outer_text, sides
            if (level, k) not in climbs:
                lo = k - k % FAN
                run = local[level][lo:lo + FAN]
                before, after = "".join(run[:k - lo]), "".join(run[k - lo + 1:])
                text, pairs = above(level + 1, k // FAN)
                if level == 0:
                    return before + after + text, [(before, after), *pairs]
                climbs[level, k] = before + after + text, [(before, after), *pairs]
            return climbs[level, k]

        proofs, folded = [], []
        for k, forged in enumerate(pdf["forged"]):
            text, pairs = above(0, k)
            proofs.append(_sha(text))
            digest = local[0][k] if forged is None else bytes(forged).hex()
            for before, after in pairs:
                digest = _sha(before + digest + after)
            folded.append(digest)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "leaf": local[0], "subroot": out["subroot"].iloc[0], "root": root, "proof_sha256": proofs,
                             "folded_root": folded, "verified": [f == root for f in folded]})

    done = placed.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
