import zlib

import numpy as np
from wideprep.llm import queries, toxicity


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op9_toxicity(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [(toxic[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    hit, miss = held.count((1, 1)), held.count((1, 0))
    assert hit >= 0.9 * (hit + miss) and held.count((0, 1)) <= 0.01 * len(held)


def test_grammar_matches_clauses_not_words():
    lexer, table = toxicity.Lexer({"clown": 2.0}), toxicity.grammar()
    match = lambda t: {p: v for p, v in zip(toxicity.PATTERNS, toxicity.match_clauses(t, lexer, table)) if v}
    assert match("what a clown") == {"insult": 2.0}
    assert match("you are a clown") == {"insult+target": 2.0}
    assert match("clown, you") == {"insult": 2.0, "insult+target": 2.0}
    assert match("he is not a clown") == {"insult+negation": 2.0}
    assert match("she said clown") == {"insult+report": 2.0}
    assert match("you left. a clown came") == {"insult": 2.0}  # the target is in another clause
    assert match("I will kill you") == {"threat": 1.0, "threat+target": 1.0}
    assert match("never kill") == {"threat+negation": 1.0} and match("nothing here") == {} == match(None)


def test_stems_are_learned(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    docs = [(i, " ".join(words[(i + j) % 5] for j in range(6)) + (f" grobix{'abcdefgh'[i % 8]}" if i % 4 == 0 else "") + ".") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    lexer, table = toxicity.Lexer(model["lexicon"]), toxicity.grammar()
    assert toxicity.score_text("gamma grobixzz delta", model, lexer, table) > 0.5 > toxicity.score_text("gamma delta", model, lexer, table)


def test_cases(messy, empty, spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(messy, labels)
    rows = toxicity.score(messy, model).collect()
    assert len(rows) == messy.count() and len({r["score"] for r in rows}) == 1
    assert toxicity.keep_clean(messy, model | {"bias": -3.0}).columns == messy.columns
    none = toxicity.learn(empty, labels.limit(0))
    assert none["lexicon"] == {} and np.isclose(none["bias"], 0.0) and toxicity.score(empty, none).count() == 0


def test_inflections_contractions_and_breaks():
    lexer, table = toxicity.Lexer({"clown": 2.0}), toxicity.grammar()
    match = lambda t: {p: v for p, v in zip(toxicity.PATTERNS, toxicity.match_clauses(t, lexer, table)) if v}
    for text in ("i am killing you", "he killed them", "someone stabbed you", "ich habe dich getötet", "il va te tuer", "te mataré a ti"):
        assert any(p.startswith("threat") for p in match(text)), text
    assert match("he isn't a clown") == match("he isn’t a clown") == {"insult+negation": 2.0}
    assert match("don't kill") == {"threat+negation": 1.0}
    assert match("not today, clown") == {"insult": 2.0} and match("this is not nice but clown") == {"insult": 2.0}
    assert match("not such a clown") == {"insult+negation": 2.0}
    assert match("he said, what a clown") == {"insult+report": 2.0}
    assert toxicity.inflected("stab", "en") == {"stab", "stabs", "stabbed", "stabbing"} and "strangling" in toxicity.inflected("strangle", "en")
    assert toxicity.inflected("kill", "en") == {"kill", "kills", "killed", "killing"}


def test_composed_table_equals_the_machines_one_by_one():
    table, parts = toxicity.grammar(), toxicity.machines()
    rng = np.random.default_rng(5)
    for _ in range(200):
        state, states = 0, [m[0] for m in parts]
        for symbol in rng.integers(len(toxicity.SYMBOLS), size=40).tolist():
            steps = [m[1](s, symbol) for m, s in zip(parts, states)]
            states = [s for s, _ in steps]
            state, marks = table[state][symbol]
            assert marks == tuple(bool(mark) for _, mark in steps)


def test_lost_weights_leave_a_fitting_bias():
    x, y, n = np.array([[0.0], [1.0]]), np.array([1.0, 0.0]), np.array([30.0, 70.0])
    bias, weights = toxicity._logistic(x, y, n)
    assert weights == [0.0] and np.isclose(1 / (1 + np.exp(-bias)), 0.3)
