import corpus_pipeline
from wideprep.llm import decontam, pii, simhash, tokens, toxicity


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, frame = {r["doc_id"]: r["text"] for r in docs.collect()}, docs
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]

    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    lexer, table = toxicity.Lexer(model["lexicon"]), toxicity.grammar()
    want = {d for d, t in rows.items() if toxicity.score_text(t, model, lexer, table) < 0.5}
    frame = steps["toxicity"](spark, frame, sf)
    assert frame.columns == docs.columns and {r["doc_id"] for r in frame.collect()} == want

    from test_simhash import brute_components, brute_print

    group = brute_components([(d, brute_print(rows[d])) for d in sorted(want)])
    frame = steps["simhash_near_dedup"](spark, frame, sf)
    want = set(group.values())
    assert frame.columns == docs.columns and sorted(r["doc_id"] for r in frame.collect()) == sorted(want)

    from test_decontam import shingles

    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d for d in want if not any(x and len(x & shingles(rows[d])) >= decontam.CONTAINMENT * len(x) for x in items)}
    frame = steps["benchmark_decontamination"](spark, frame, sf)
    assert frame.columns == docs.columns and {r["doc_id"] for r in frame.collect()} == want

    frame = steps["pii"](spark, frame, sf)
    texts = {d: pii.redact_text(rows[d], pii.find_spans(rows[d])) for d in want}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in frame.collect()} == {d: (t, len(t)) for d, t in texts.items()}

    vocabulary = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    packed = steps["best_fit_packing"](spark, frame, sf).collect()
    assert sum(r["token_end"] - r["token_start"] for r in packed) == sum(tokens.encoded_length(vocabulary, t) for t in texts.values())
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def test_stages_keep_extra_columns_and_take_messy_tables(spark, messy, empty):
    sf = "/root/testdata/sf0.001"
    for frame in (messy, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, sf)
            assert frame.columns == messy.columns
        assert corpus_pipeline.pack_sequences(spark, frame, sf).count() >= 0


def test_columns_named_like_helpers_survive(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(5, text, 9, 8, 7), (6, text + " x", 1, 2, 3), (7, "a b c d e f g h i j k", 4, 5, 6)],
                               "doc_id long, text string, __id long, __fp long, __row long")
    kept = simhash.keep_one(df).collect()
    assert {tuple(r) for r in kept} <= {tuple(r) for r in df.collect()} and (5, text, 9, 8, 7) in map(tuple, kept)
