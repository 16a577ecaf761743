import math
import zlib

import numpy as np

from wideprep.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_langid(spark, sf).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_gram_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Der schnelle braune Fuchs springt über den faulen Hund " * 30
    at, n = langid.counts_of(text)
    monkeypatch.setattr(langid, "PIECE", 7)
    at2, n2 = langid.counts_of(text)
    assert at.tolist() == at2.tolist() and n.tolist() == n2.tolist()


def test_weights_are_sparse_and_cases(messy, empty, spark):
    model = langid.learn(messy)
    rows = langid.predict(messy, model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == messy.count()
    for d in (2, 3, 4, 6):
        assert by[d]["lang_pred"] == "und" and by[d]["score"] == 0.0
    nothing = langid.learn(empty)
    assert nothing["languages"] == []
    assert {r["lang_pred"] for r in langid.predict(messy, nothing).collect()} == {"und"}
    assert langid.predict(empty, nothing).count() == 0
    full = langid.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert (full["weights"] == 0).mean() > 0.5


def brute_pass(rows, k):
    """Follow the regularised leader coordinate by coordinate, in plain Python."""
    z, n = {}, {}
    for at, x, y in rows:
        w = {}
        for a in at:
            for c in range(k):
                zi, ni = z.get((a, c), 0.0), n.get((a, c), 0.0)
                sign = 1 if zi > 0 else -1
                w[a, c] = 0.0 if abs(zi) <= langid.L1 else -(zi - sign * langid.L1) / ((langid.BETA + math.sqrt(ni)) / langid.ALPHA + langid.L2)
        score = [sum(v * w[a, c] for a, v in zip(at, x)) for c in range(k)]
        top = max(score)
        p = [math.exp(s - top) for s in score]
        for a, v in zip(at, x):
            for c in range(k):
                g = v * (p[c] / sum(p) - (c == y))
                old = n.get((a, c), 0.0)
                z[a, c] = z.get((a, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * w[a, c]
                n[a, c] = old + g * g
    return z, n


def test_learner_equals_plain_ftrl():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(60)]
    z, n = np.zeros((40, 3)), np.zeros((40, 3))
    langid._pass(rows, z, n)
    bz, bn = brute_pass([(a.tolist(), x.tolist(), y) for a, x, y in rows], 3)
    for (a, c), v in bz.items():
        assert abs(z[a, c] - v) < 1e-9 and abs(n[a, c] - bn[a, c]) < 1e-9


def test_document_frequencies_cover_all_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("text as body")
    total, df = langid.document_frequencies(rows.repartition(5))
    want, n = np.zeros(langid.FEATURES), 0
    for r in rows.collect():
        counted = langid.counts_of(r["body"])
        if counted:
            want[counted[0]] += 1
            n += 1
    assert total == n and (df == want).all()


def test_a_rare_language_is_learned(spark):
    english = ["the river runs past the old house", "we went to the market in the morning", "this is a letter about nothing much"]
    rows = [(i, english[i % 3] + f" {'abcdefghij'[i % 10]}", "en") for i in range(12_000)]
    hungarian = ["a gyors barna róka átugorja a lusta kutyát", "szép napot kívánok mindenkinek ezen a reggelen", "nem tudom hogy mikor jön meg a vonat",
                 "köszönöm szépen a finom ebédet és a bort", "hol van a legközelebbi vasútállomás kérem", "holnap délután elmegyünk a nagymamához",
                 "ezt a könyvet tegnap este olvastam végig", "az őszi eső lassan áztatja a kertet"]
    rows += [(20_000 + i, t, "hu") for i, t in enumerate(hungarian)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, per_language=600)
    assert model["languages"] == ["en", "hu"]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).filter("doc_id >= 20000").collect()}
    assert sum(v == "hu" for v in found.values()) >= 7


def test_numerals_are_no_letters():
    assert langid.counts_of("½ ² ① Ⅷ 12 _ !") is None
    at, n = langid.counts_of("ab½cd")
    at2, n2 = langid.counts_of("ab cd")
    assert at.tolist() == at2.tolist() and n.tolist() == n2.tolist()
