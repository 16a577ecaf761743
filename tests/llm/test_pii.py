import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wideprep.llm import pii, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def brute(text):
    """The base kinds by the contract's own expressions."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for k, (name, p) in enumerate({"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}.items()):
        for m in re.finditer(p, text or ""):
            d = digits(m[0])
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, name, m.end()))
    return [f"{n}:{s}:{e}" for s, k, n, e in sorted(out)]


def base(text):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in pii.find_spans(text) if s["kind"] in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0123456789()é_%\n", max_size=60))
def test_base_spans_equal_the_plain_expressions(text):
    assert base(text) == brute(text)


@pytest.mark.parametrize("text", ["x a.b@c.d.e, 1.2.3.4.5 4111 1111 1111 1111 +1 (555) 555-0100", "@@a@b.c", "9.9.9.999 1.2.3.4", ""])
def test_base_spans_of_examples(text):
    assert base(text) == brute(text)


def test_checksums_and_context():
    kinds = lambda t: [(s["kind"], s["score"]) for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == [("iban", 1.0)]
    assert not kinds("IBAN DE88 3704 0044 0532 0130 00")
    assert not [k for k, _ in kinds("number 555-123-4567 of the order") if k == "national_phone"]
    assert ("national_phone", 0.6) in kinds("call me: 555-123-4567")
    assert ("ssn", 0.6) in kinds("social security 123-45-6789") and not kinds("part 123-45-6789")
    assert kinds("card 4111111111111111")[0][1] > kinds("order 4111111111111111")[0][1]


def test_long_digit_and_letter_runs_take_linear_time():
    text = "1" * 300_000 + " " + "a" * 300_000 + "@"
    assert pii.find_spans(text) == []


def test_detect_redact_and_cases(messy, empty, spark):
    rows = pii.detect(messy).collect()
    assert len(rows) == messy.count() and all(r["pii"] == [] for r in rows)
    assert pii.detect(empty).count() == 0 and pii.redact(empty).columns == empty.columns
    df = spark.createDataFrame([(1, "é mail a@b.co now", 17, "x"), (2, None, None, "y")], "doc_id long, text string, n_chars long, pii string")
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert out[1]["text"] == "é mail [EMAIL] now" and out[1]["n_chars"] == 18 and out[1]["pii"] == "x"
    assert out[2]["text"] is None and out[2]["n_chars"] is None


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, sf).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(w.startswith(k) for w in want) for k in pii.BASE_KINDS]
        assert not set(want) - set(r["spans"].split(","))


@pytest.mark.parametrize("text, value", [
    ("ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "ES91 2100 0418 4502 0005 1332"), ("AT61 1904 3002 3457 3201 BIC X", "AT61 1904 3002 3457 3201"),
    ("to BE68 5390 0754 7034 KBC", "BE68 5390 0754 7034"), ("ES9121000418450200051332 BANK", "ES9121000418450200051332"),
    ("DE89 3704 0044 0532 0130 00 BIC", "DE89 3704 0044 0532 0130 00"), ("AB12 CDEF GHIJ BE68 5390 0754 7034", "BE68 5390 0754 7034")])
def test_iban_before_an_upper_case_word(text, value):
    assert [text[s["start"]:s["end"]] for s in pii.find_spans(text) if s["kind"] == "iban"] == [value]


def test_very_long_numbers_are_no_addresses():
    spans = pii.find_spans("1.1.1." + "0" * 5_000_000 + " and 2.2.2." + "9" * 10_000 + " and 10.0.0." + "0" * 9_000 + "7")
    assert [s["kind"] for s in spans if s["kind"] == "ip"] == ["ip", "ip"]
