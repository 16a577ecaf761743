import duckdb

from wideprep.llm import decontam, queries


def shingles(text):
    w = decontam.words_of(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_query_equals_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rows = sorted(tuple(r) for r in queries.op10_decontamination(spark, sf).collect())
    assert rows and rows == sorted(con.execute(queries.ORACLE["op10_decontamination"]).fetchall())
    items = [(i, shingles(t)) for i, t in con.execute("SELECT item_id, text FROM benchmark").fetchall()]
    docs = [(d, shingles(t)) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()]
    assert {(d, i) for d, i, *_ in rows} == {(d, i) for d, x in docs for i, y in items if y and len(x & y) >= 0.8 * len(y)}


def test_short_items_in_long_documents_near_copies_and_scattered_ones(spark):
    words = [f"w{i}" for i in range(60_000)]
    item = " ".join(f"item{i}" for i in range(12))
    near = item.replace("item0 ", "other ")  # 7 of 8 shingles
    far = item.replace("item5 ", "other ")  # 3 of 8
    halves = " ".join(item.split()[:8]) + " gap " * 900 + " ".join(item.split()[4:])
    docs = [(1, " ".join(words[:30_000]) + " " + item.upper() + "! " + " ".join(words[30_000:])), (2, " ".join(words) + " " + near),
            (3, " ".join(words) + " " + far), (4, halves), (5, " ".join(words))]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["shared"], r["item_shingles"]) for r in found} == {(1, 8, 8), (2, 7, 8), (4, 8, 8)}


def test_items_in_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(50)]
    docs = [(i, f"start {t} end") for i, t in items]
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 20)
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i, i) for i in range(50)]


def test_cases(messy, empty, spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy"), (2, None), (3, ""), (4, "word word"), (None, "an orphan text without any id")],
                                  "item_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in decontam.contaminated(messy, bench).collect()), key=str)
    assert found == [(1, 1), (1, 1), (7, 1), (None, None)]
    kept = decontam.drop_contaminated(messy, bench)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 4
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(messy, bench.limit(0)).count() == 0


def test_one_text_under_many_ids_is_searched_once(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 20)
    text = " ".join(f"q{j}" for j in range(20))
    items = [(i, text) for i in range(300)] + [(i, " ".join(f"z{i}x{j}" for j in range(9))) for i in range(300, 330)] + [(300, text)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts, rows = decontam._item_texts(bench, "item_id", "text", 5, 96)
    blocks = list(decontam._blocks(texts, decontam.Signatures(5, 96)))
    assert texts.count() == 31 and rows.count() == len(items) and max(len(b.items) for b in blocks) <= 20
    docs = spark.createDataFrame([(1, f"a {text} b"), (2, "nothing")], "doc_id long, text string")
    found = decontam.contaminated(docs, bench).collect()
    assert sorted(r["item_id"] for r in found) == [*range(300), 300] and {r["doc_id"] for r in found} == {1}
    assert [r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()] == [2]
