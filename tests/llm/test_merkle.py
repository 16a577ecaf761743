import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from wideprep.llm import merkle, queries


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return h(*(field(v) for v in row))


def climb(nodes):
    """Root of a tree, and for each leaf its (before, after) pairs."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for w, k in zip(ways, at):
            lo = k - k % 16
            w.append((nodes[lo:k], nodes[k + 1:lo + 16]))
        nodes, at = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], ways


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, above = climb([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, ways), up in zip(trees, above):
        for r, way in zip(own, ways):
            way = way + up
            forged = (*r[:4], lowered(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
            digest = leaf(forged)
            for before, after in way:
                digest = h(*before, digest, *after)
            out.append((r[0], leaf(r), subroot, root, h(*(x for b, a in way for x in b + a)), digest, digest == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(df):
    return [tuple(r) for r in df.select(*merkle.FIELDS).collect()]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = found(queries.op13_merkle_manifest(spark, sf))
    assert got == brute(rows_of(spark.read.parquet(f"{sf}/documents.parquet")))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("local_levels, broadcast", [(1, 100_000), (2, 0), (3, 0)])
def test_hot_source_over_superblocks(spark, monkeypatch, local_levels, broadcast):
    monkeypatch.setattr(merkle, "BROADCAST_SOURCES", broadcast)
    n = F.col("id")
    source = F.when(n % 3 == 0, "hot").when(n % 3 == 1, F.concat(F.lit("s"), n % 17)).when(n < 20, F.concat(F.lit("one"), n))
    df = spark.range(2400).select(n.alias("doc_id"), source.alias("source"), F.lit(None).cast("string").alias("lang"), n.alias("n_chars"),
                                  F.concat(F.lit("É Text "), n % 7).alias("text"))
    assert found(merkle.manifest(df, local_levels)) == brute(rows_of(df))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_around_whole_runs(spark, n):
    df = spark.range(n).selectExpr("id as doc_id", "'a' as source", "'en' as lang", "id as n_chars", "'T' as text")
    for local_levels in (1, 2):
        assert found(merkle.manifest(df, local_levels)) == brute(rows_of(df))


def test_cases(spark, messy, empty):
    big = spark.createDataFrame([((1 << 60) + 1, "A" * 3_000_000, "en", "a", 3, 1), ((1 << 60) + 1, None, "en", "a", 3, 1)], messy.schema)
    docs = messy.union(big).withColumn("tree", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("at", F.lit(0))
    for local_levels in (1, 3):
        assert found(merkle.manifest(docs, local_levels)) == brute(rows_of(docs))
    assert merkle.manifest(empty).collect() == []
    assert merkle.manifest(empty).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
