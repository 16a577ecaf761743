import base64

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wideprep.llm import queries, tokens

ENCODER = tokens.encoder(open(tokens.VOCABULARY, "rb").read())


def test_histogram_and_suffix_sums_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = [len(enc.encode_ordinary(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op5_token_counts(spark, sf).collect()
    assert {r["length"]: r["documents"] for r in rows} == {x: n.count(x) for x in set(n)}
    for r in rows:
        x = r["length"]
        assert r["documents_longer"] == sum(v > x for v in n) and r["tokens_fitting"] == sum(v for v in n if v <= x)
        assert r["tokens_truncated"] == sum(min(v, x) for v in n) and r["tokens_lost"] == sum(n) - r["tokens_truncated"]
        assert abs(r["quantile"] - sum(v <= x for v in n) / len(n)) < 1e-12


def test_quantiles_limits_and_cases(messy, empty):
    lengths = tokens.token_lengths(messy)
    n = sorted(r["n_tokens"] for r in lengths.collect())
    limits = tokens.limits_table(tokens.length_histogram(lengths))
    assert n[:3] == [0, 0, 0] and limits.filter("length = 0").first()["documents"] == 3
    assert tokens.truncated_total(limits, 10).first()[0] == sum(min(x, 10) for x in n)
    assert tokens.length_quantile(limits, 0.5).first()[0] == n[len(n) // 2 - 1]
    assert tokens.limits_table(tokens.length_histogram(tokens.token_lengths(empty))).count() == 0


def test_special_strings_are_ordinary_text(spark):
    df = spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string")
    assert tokens.token_lengths(df).first()["n_tokens"] > 1


@given(st.text(st.sampled_from(" \n\t\u3000\x85ab1é!'s"), max_size=60), st.integers(2, 6))
@settings(max_examples=300, deadline=None)
def test_long_white_space_is_cut_where_the_pattern_cuts(text, long_run):
    assert tokens.encoded_length(ENCODER, text, long_run) == len(ENCODER.encode_ordinary(text))


def test_texts_of_white_space_alone(spark):
    n = 3_000_000
    rows = [(1, " " * n), (2, "\n" * n + "end"), (3, "a" + "\t" * n + " b" + " " * 100_000), (4, "\u3000" * n)]
    found = {r["doc_id"]: r["n_tokens"] for r in tokens.token_lengths(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[k] > 0 for k in (1, 2, 3, 4)) and len(found) == 4
    for text in (" " * 400_000, "x" + "\n" * 400_000 + "y"):  # as far as the engine goes
        assert tokens.encoded_length(ENCODER, text) == len(ENCODER.encode_ordinary(text))
