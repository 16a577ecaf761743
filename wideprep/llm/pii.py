"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds, in this order: email, ip, card, phone (the base kinds) and iban, national_phone, ssn (added by the method).
A base span needs its shape and its validator (parts at most 255, Luhn, digit counts) and always stays; its score only
tells how sure the find is. An added span stays if its validator (mod-97 for iban) agrees and its score, moved up or
down by words within ``CONTEXT`` characters, reaches ``threshold``.

Defined cases: a null text has no spans and stays null when redacted; an empty text has none; whole texts are searched,
in time linear in their length; equal rows give equal results; other columns pass through untouched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_phone", "ssn")
THRESHOLD = 0.5
CONTEXT = 48
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"

# The patterns of the base kinds (possessive, and from the first digit of a run, where that changes nothing)
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Proposals of the added kinds
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL_PHONE = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

# Prior score of a confirmed span, words that raise it and words that lower it
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_phone": 0.35, "ssn": 0.35}
RAISE = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "client", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "cvv", "expires", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "iban": ("iban", "account", "bank", "transfer", "bic", "swift"),
    "national_phone": ("phone", "tel", "call", "mobile", "fax", "contact", "cell"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
LOWER = ("version", "build", "order", "invoice", "isbn", "serial", "sku", "example", "sample", "test", "checksum", "ticket")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_LOCAL.match(text[start - 1]):
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ibans(text: str):
    """Proposals that mod-97 confirms. As the pattern may take words that follow, ends are tried from the longest down to each
    place where the proposal has a space; the search goes on after the end that agrees, or after the first group."""
    at = 0
    while m := IBAN.search(text, at):
        ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]
        at = m.start() + 4
        for end in ends:
            plain = text[m.start():end].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield m.start(), end
                at = end
                break


def _proposed(text: str):
    """(kind number, start, end) of each span that its validator confirms."""
    for s, e in _emails(text):
        yield 0, s, e
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield 1, m.start(), m.end()
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield 2, m.start(), m.end()
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield 3, m.start(), m.end()
    yield from ((4, s, e) for s, e in _ibans(text))
    for m in NATIONAL_PHONE.finditer(text):
        yield 5, m.start(), m.end()
    for m in SSN.finditer(text):
        yield 6, m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = WORD.findall(text[max(0, start - CONTEXT):start].lower()) + WORD.findall(text[end:end + CONTEXT].lower())
    score = PRIOR[kind] + 0.25 * any(w in RAISE[kind] for w in near) - 0.25 * any(w in LOWER for w in near)
    return round(min(1.0, max(0.0, score)), 4)


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[dict]:
    """Spans by start, then kind as listed; offsets are code points, the end exclusive."""
    out = []
    for k, s, e in sorted(_proposed(text or ""), key=lambda x: (x[1], x[0])):
        score = _score(text, KINDS[k], s, e)
        if k < len(BASE_KINDS) or score >= threshold:
            out.append({"kind": KINDS[k], "start": s, "end": e, "score": score, "value": text[s:e]})
    return out


def redact_text(text: str | None, spans: list[dict]) -> str | None:
    """The text with each stretch of overlapping spans replaced by the name of its first kind."""
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]["start"], spans[i]["end"], spans[i]["kind"]
        while i < len(spans) and spans[i]["start"] < end:
            end = max(end, spans[i]["end"])
            i += 1
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def detect(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, and ``pii``: the spans with kind, offsets, score and value."""
    types = dict(df.dtypes)
    kept = [F.col(c) for c in keep]

    def make():
        def work(batch):
            return {**{c: batch[c] for c in keep}, "pii": [find_spans(t, threshold) for t in batch["__text"].to_pylist()]}

        return work

    narrow = df.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"pii {SPAN_TYPE}"])
    return arrow_map(narrow, [*keep, "__text"], schema, make)


def redact(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with every span in ``text`` replaced by its kind's name; ``n_chars``, if there,
    is set to the new length."""

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        return pd.Series([redact_text(t, find_spans(t, threshold)) for t in texts], dtype=object)

    out = df.withColumn(text, clean(F.col(text).cast("string")))
    if "n_chars" in df.columns:
        kind = dict(df.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text)).cast(kind))
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
