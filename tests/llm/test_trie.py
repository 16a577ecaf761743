import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from wideprep.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append((n is not None, n or 0, d, role, text))
    for own in convs.values():
        own.sort()
    nodes = {}
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple((r, t) for *_, r, t in convs.get(c - c % 5, [])[:h] + convs[c][h:])
        for d in range(len(path) + 1):
            node = nodes.setdefault(path[:d], {"members": [], "ends": [], "kids": set()})
            node["members"].append(c)
            if d == len(path):
                node["ends"].append(c)
            if d:
                nodes[path[:d - 1]]["kids"].add(path[:d])
    out = {}

    def total(p):
        node = nodes[p]
        leaves, saved = int(not node["kids"]), (len(node["members"]) - 1) * len(p[-1][1].encode()) if p else 0
        for kid in node["kids"]:
            a, b = total(kid)
            leaves, saved = leaves + a, saved + b
        out[p] = (leaves, saved)
        return leaves, saved

    if nodes:
        total(())
    return sorted(((min(n["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(n["members"]), len(n["kids"]), *out[p],
                   sha256(",".join(map(str, n["ends"])).encode()).hexdigest()) for p, n in nodes.items()), key=str)


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_prefix_trie(spark, sf)
    assert got.columns == trie._RESULT
    assert found(got) == brute(rows_of(spark.read.parquet(f"{sf}/conversations.parquet")))


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 100_000])
def test_shared_prefixes_over_many_shards(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(trie, "PIECE", 3)
    monkeypatch.setattr(trie, "OUT_ROWS", 5)
    rng = random.Random(shard_turns)
    rows = []
    for c in range(90):
        kind = c % 3  # a third is one conversation, a third shares its first turn, the rest is drawn from few texts
        texts = ["hot", "copy", "é"] if kind == 0 else ["hot"] + [rng.choice("ab") for _ in range(rng.randrange(4))] if kind == 1 else \
            [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
        rows += [(c, n, "user" if n % 2 else "assistant", t) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(trie, "OVERSAMPLE", 8)
    assert found(trie.prefix_trie(df, shard_turns)) == brute(rows)


def test_large_skeletons_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(trie, "BROADCAST_NODES", 0)
    rows = [(c, n, "user", f"{n}{c // 7}") for c in range(40) for n in range(c % 6 + 1)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 5)) == brute(rows)


def test_cases(spark):
    rows = [(0, None, "user", "first"), (0, 0, None, None), (0, 1, "", ""), (0, 1, "user", "tie"), (0, 1, "assistant", "tie"), (0, 2, "user", "x"), (0, 2, "user", "x"),
            (None, 0, "user", "no id"), (None, None, None, None), (3, 0, "user", "long " * 200_000), (-3, 0, "user", "negative"), (12, 0, "a", "b"), (13, 0, "a:", "b")]
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, path string")
    for shard_turns in (2, 1000):
        assert found(trie.prefix_trie(wide, shard_turns)) == brute(rows)
    assert trie.prefix_trie(wide.limit(0)).collect() == []
    assert trie.prefix_trie(wide.where("conv_id is null")).collect() == []


def test_one_deep_conversation(spark):
    rows = [(c, n, "user", str(n)) for c in (5, 6) for n in range(3000 + c)]
    got = found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 500))
    assert len(got) == 3007 and {r[3] for r in got} == {1, 2} and {r[5] for r in got} == {1}
