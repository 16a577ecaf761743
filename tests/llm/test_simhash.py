import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from wideprep.llm import components, queries, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    parent = {d: d for d, _ in prints}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (a, x), (b, y) in combinations(prints, 2):
        if bin(x ^ y).count("1") <= 3:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: root(d) for d, _ in prints}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    prints = [(r["doc_id"], brute_print(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_components(prints)
    rows = queries.op7_simhash(spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{x:016x}" for d, x in prints}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("shared", range(1, 9))
def test_every_choice_of_shared_positions_holds_a_key(shared):
    for size in range(1, shared + 1):
        sets = [set(s) for s in simhash.position_sets(size, shared)]
        assert all(any(s <= set(c) for s in sets) for c in combinations(range(8), shared))


@pytest.mark.parametrize("block,bits", [(1024, 3), (16, 3), (16, 0), (16, 5)])
def test_links_connect_what_is_near_even_in_long_lists(spark, block, bits):
    import random

    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(6))) & (2**64 - 1) for b in base for _ in range(80)})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.fingerprint_links(df, bits, block).collect()}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= bits for a, b in got)
    near = {(simhash._signed(a), simhash._signed(b)) for a, b in combinations(fps, 2) if bin(a ^ b).count("1") <= bits}
    assert _classes(fps, got) == _classes(fps, near)


def _classes(fps, links):
    parent = {simhash._signed(x): simhash._signed(x) for x in fps}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    got = {r["vertex"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[i] == 500 for i in range(501, 560)) and got[9] == 8
    assert 7 not in got and components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cases(messy, empty):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["fp"] == by[3]["fp"] == by[4]["fp"] == 0 and by[4]["component_id"] == 2
    assert by[7]["component_id"] == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5", "6", "None"]


def test_one_id_over_two_texts_keeps_each_component(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "red green blue cyan pink grey")
    rows = [(5, a), (5, b), (3, a), (7, c), (7, c), (None, c + " x"), (None, c + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([(3, a), (5, b), (7, c), (0, c + " x")])


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_rows_are_kept_by_number_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_WORDS", most)
    rows = spark.range(1000, numPartitions=3).select((F.col("id") * 7 + (F.col("id") % 3) * (1 << 33)).alias("n"), F.col("id").alias("__at"),
                                                     F.lit("x").alias("__bits"))
    keep = rows.filter("__at % 10 < 4").select("n")
    got = simhash.rows_numbered(rows, keep, "n").select(*rows.columns).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in rows.filter("__at % 10 < 4").collect())
