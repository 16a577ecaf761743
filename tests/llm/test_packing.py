from collections import defaultdict

from pyspark.sql import functions as F

from wideprep.llm import packing, queries, tokens


def check(rows, lengths, capacities):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["pack_group"], r["bin"]].append(r)
        docs[r["doc_id"]].append((r["token_start"], r["token_end"]))
    for members in bins.values():
        members.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in members:
            assert r["bin_offset"] == at
            at += r["token_end"] - r["token_start"]
        assert all(r["bin_fill"] == at for r in members)
        assert {r["bin_capacity"] for r in members} == {min(c for c in capacities if c >= at)}  # downsized
    for d, n in lengths.items():
        want = [(s, min(s + max(capacities), n)) for s in range(0, n, max(capacities))]
        assert sorted(docs[d]) == want
    return sum(packing.cost(m[0]["bin_capacity"]) for m in bins.values())


def test_every_token_is_placed_once_and_bins_are_downsized(spark):
    sf = "/root/testdata/sf0.001"
    docs = tokens.token_lengths(spark.read.parquet(f"{sf}/documents.parquet"))
    lengths = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    joint = check(queries.op2_packing(spark, sf).collect(), lengths, packing.CAPACITIES)
    assert joint <= packing.cost(16384) * len(packing.pack(docs, (16384,)).filter("bin_offset = 0").collect())


def brute_pack(lengths, caps):
    """Best fit, longest first, over plain lists."""
    price, bins, offered, used = min(packing.cost(c) / c for c in caps), [], 1.0, 1.0
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], b[2]))
            used += n
        else:
            worth = price * min(1.0, used / offered)
            c = min((c for c in caps if c >= n), key=lambda c: ((packing.cost(c) - worth * (c - n)) / n))
            b = [c, [], len(bins)]
            bins.append(b)
            offered += c - n
        b[0] -= n
        b[1].append(n)
    return sorted(sorted(b[1]) for b in bins)


def test_equals_brute_force_best_fit(spark):
    lengths = [(i, (i * 37) % 97 + 1) for i in range(400)]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    rows = packing.pack(df, (50, 100, 200), group_pieces=1000).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin"]].append(r["token_end"] - r["token_start"])
    assert sorted(sorted(b) for b in bins.values()) == brute_pack([n for _, n in lengths], (50, 100, 200))


def test_cases(messy, empty):
    rows = packing.pack(packing.byte_lengths(messy)).collect()
    ids = [r["doc_id"] for r in rows]
    assert 2 not in ids and 3 not in ids and ids.count(1) == 2 and ids.count(5) == -(-200_000 // 16384)
    assert packing.pack(packing.byte_lengths(empty)).count() == 0
    total = packing.total_cost(packing.pack(packing.byte_lengths(messy))).first()
    assert total["tokens"] == packing.byte_lengths(messy).agg(F.sum("n_tokens")).first()[0]


def test_rows_alike_spread_over_groups(spark):
    df = spark.range(5000, numPartitions=4).selectExpr("cast(null as long) as doc_id", "70L as n_tokens")
    sizes = [r["count"] for r in packing.pack(df, (100, 200), group_pieces=100).groupBy("pack_group").count().collect()]
    assert sum(sizes) == 5000 and len(sizes) == 50 and max(sizes) < 200
