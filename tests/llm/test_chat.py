from collections import defaultdict
from hashlib import sha256

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wideprep.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = ["### ", "</turn>", "</turn>\n", "\\", "\\h", "\\s", "\\e", "\\c", ": ", "#", "<", "/turn>", "\n", "é", "😀", "a", " ", "user", "assistant"]


def digest(x):
    return sha256(x.encode()).hexdigest()


def brute(rows):
    """Result of the query from the source alone; the length by rules of its own."""
    convs = defaultdict(list)
    for c, n, role, text in rows:
        convs[c].append((n is not None, n or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        every = "".join(r + t for r, t in turns)
        level = 2 if "\\" in every else int(any(m in r or m in t for r, t in turns for m in ("### ", "</turn>")) or any(": " in r for r, _ in turns))
        n = 0
        for r, t in turns:
            n += len(r) + len(t) + 14 + (level == 2) * (r + t).count("\\")
            n -= (level > 0) * sum(2 * x.count("### ") + 5 * x.count("</turn>") for x in (r, t))
        learned = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned), n))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.CONFLICT), (-7, 1, "assistant", queries.CONFLICT)]
    assert queries.CONFLICT == r"\### Assistant: </turn> ok"
    df = queries.op12_chat_format(spark, sf)
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(0, 30), st.lists(st.sampled_from(TRICKY), max_size=4), st.lists(st.sampled_from(TRICKY), max_size=9)), min_size=20, max_size=80))
def test_round_trip_of_conflicting_texts(spark, drawn):
    rows = [(c, n, "".join(r), "".join(t)) for n, (c, r, t) in enumerate(drawn)]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", chat.parse(F.col("formatted"))).withColumn(
        "learned", chat.loss_text(F.col("formatted"), F.col("loss_mask"))).collect()
    for r in out:
        want = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["learned"] == "".join(t for role, t in want if role == "assistant")
        assert sum(sum(m) for m in r["loss_mask"]) == len(r["formatted"])
        at, under = 0, ""
        for m in r["loss_mask"]:
            under += r["formatted"][at + m["before"]:at + m["before"] + m["under"]]
            at += sum(m)
        assert not (r["escape_level"] == 0 and under != r["learned"])


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain # text: fine"), (2, 0, "user", "a ### b"), (3, 0, "user", r"C:\new"), (4, 0, "user: x", "y")]
    got = {r["conv_id"]: (r["escape_level"], r["formatted"]) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (0, "### user: plain # text: fine</turn>\n"), 2: (1, "### user: a \\hb</turn>\n"),
                   3: (2, "### user: C:\\snew</turn>\n"), 4: (1, "### user\\cx: y</turn>\n")}


@pytest.mark.parametrize("bad", ["no turn", "### user: a", "### user a</turn>\n", "### user: \\x</turn>\n", "### user: a ### b</turn>\n", "x### user: a</turn>\n"])
def test_the_parser_refuses_what_is_outside_the_grammar(spark, bad):
    got = spark.range(1).select(chat.parse(F.lit(bad)).alias("t")).first()["t"]
    assert not got or None in got


def test_cases(spark):
    rows = [(1, None, "user", "null turn"), (1, 0, None, None), (1, 0, None, None), (1, 0, "assistant", ""), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"),
            (None, 0, "user", "x"), (None, None, None, None), (2, 0, "assistant", "long </turn> " * 200_000)]
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", formatted int, turns string")
    got = {r["conv_id"]: r for r in chat.format_chats(wide).withColumn("back", chat.parse(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1]["back"]] == [("user", "null turn"), ("", ""), ("", ""), ("assistant", ""), ("assistant", "a"), ("assistant", "b")]
    assert [tuple(t) for t in got[None]["back"]] == [("", ""), ("user", "x")]
    assert got[2]["back"][0]["text"] == "long </turn> " * 200_000
    assert chat.format_chats(wide.limit(0)).collect() == []
