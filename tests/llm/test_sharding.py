import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from wideprep.llm import queries, sharding


def unit(text):
    return int(md5(text.encode()).hexdigest()[:12], 16) / float(1 << 48)


def brute(rows, shards=16, seed=7):
    by = defaultdict(list)
    for d, s, t in rows:
        body = (t or "").encode()
        by["n" if s is None else "s" + s].append((unit(f"{seed}:{'' if d is None else d}"), d is not None, d or 0, zlib.crc32(body), len(body) + 1, d))
    order = []
    for s, members in by.items():
        members.sort()
        order += [((r + unit(f"{seed}/{s}")) / len(members), s, r, m) for r, m in enumerate(members)]
    order.sort(key=lambda x: x[:3])
    base, extra = divmod(len(order), shards)
    out, at = [], 0
    for k in range(shards):
        for slot in range(base + (k < extra)):
            m = order[at][3]
            out.append((m[5], m[4], m[3], k, slot))
            at += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("cell_rows", [500, 7])
def test_equals_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(sharding, "RUN", 4)
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in queries.op6_sharding(spark, sf).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_every_shard_matches_the_mixture(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    rows = sharding.interleave(df).collect()
    count = Counter((r["shard"], r["source"]) for r in rows)
    size = Counter(r["source"] for r in rows)
    assert all(abs(count[k, s] - n / 16) <= 2 for s, n in size.items() for k in range(16))
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(per[k])) for k in per)


def test_cases(messy, empty):
    rows = sharding.interleave(messy).collect()
    assert sorted(r["place"] for r in rows) == list(range(messy.count()))
    assert {r["shard"] for r in rows} == set(range(10)) and {r["slot"] for r in rows} == {0}
    null = next(r for r in rows if r["doc_id"] == 2)
    assert null["size"] == 1 and null["text_crc32"] == 0
    assert sharding.interleave(empty).count() == 0


def test_a_hot_id_is_spread_over_cells(spark, monkeypatch):
    seen = []
    original = sharding._placed

    def spy(rows, groups, cell, order, name):
        seen.append(max(r["count"] for r in rows.groupBy(*groups, cell).count().collect()))
        return original(rows, groups, cell, order, name)

    monkeypatch.setattr(sharding, "_placed", spy)
    df = spark.range(9000, numPartitions=3).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    rows = sharding.interleave(df).collect()
    assert sorted(r["place"] for r in rows) == list(range(9000)) and max(seen) < 700
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    nulls = Counter(r["shard"] for r in rows if r["doc_id"] is None)
    assert len(nulls) == 16 and max(nulls.values()) < 2 * min(nulls.values())
