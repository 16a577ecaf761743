"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters of the lower-cased text, words parted by one space, give n-grams of one to three characters, hashed to ``FEATURES`` buckets; a
bucket's count is damped by log(1 + count), weighted by its inverse document frequency, and the vector scaled to length
one. Document frequencies are counted over all texts outside the held-out fold, inside the tasks first. Training is
follow-the-regularised-leader with per-coordinate rates and elastic-net penalties (the L1 part leaves
most weights exactly zero). It runs on shards of a bounded sample in parallel: each round every shard passes over its rows from the
common state, and the states are averaged. A temperature, fitted on a part of the sample kept out of training, calibrates the
probabilities.

Only rows outside the held-out fold with a text and a language teach. The sample is drawn language by language, by a hash of the id: about
``per_language`` rows of each (the documented bound; expected number, so a few more or less), and all rows of a language that has no
more. So every language is learned at any size of the table. Rows of languages with fewer than ``RARE`` rows train on every shard, as the average of the states would lose them else, and none
calibrates.

Defined cases: a text that is null or has no letter is ``und`` with score 0; if nothing can be learned every text is ``und``; one
learned language gets score 1; ties go to the language first in order; repeated rows get a prediction each; prediction reads whole
texts in pieces of bounded memory; language, source and id are never read by a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out, store

PER_LANGUAGE = 1_500
RARE = 50
FEATURES = 1 << 15
GRAMS = (1, 2, 3)
ROUNDS = 4
SHARDS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 0.1
PIECE = 1 << 18
NOT_LETTERS = re.compile(r"[\W\d_]+")


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a text's n-grams; None without letters."""
    plain = NOT_LETTERS.sub(" ", text.lower()) if text else ""
    if not plain.replace(" ", "").isalpha():  # nothing left, or numerals that count as word characters
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    if not plain.strip():
        return None
    plain = f" {plain.strip()} "
    total = np.zeros(FEATURES, np.int64)
    for at in range(0, len(plain), PIECE):
        piece = plain[max(0, at - max(GRAMS) + 1):at + PIECE]
        new = at - max(0, at - max(GRAMS) + 1)  # characters that belong to the piece before
        chars = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in GRAMS:
            if len(chars) < n:
                continue
            h = np.full(len(chars) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h + chars[i:len(chars) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            h = h[max(0, new - n + 1):]
            total += np.bincount((h >> np.uint64(17)).astype(np.int64) & (FEATURES - 1), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(counted, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counted
    x = np.log1p(n) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the regularised leader: zero where |z| stays within L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _pass(rows, z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL over (buckets, values, class) rows, in place."""
    for at, x, y in rows:
        w = ftrl_weights(z[at], n[at])
        error = _softmax(x @ w)
        error[y] -= 1.0
        g = x[:, None] * error[None, :]
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and of those that hold each bucket; ``texts``: body. Every task counts its texts and gives a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FEATURES + 1, np.int64)  # the last counts texts
        for batch in batches:
            for t in batch.column("body").to_pylist():
                counted = counts_of(t)
                if counted:
                    held[counted[0]] += 1
                    held[FEATURES] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["at", "n"])

    df = np.zeros(FEATURES + 1)
    for r in texts.select("body").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # FEATURES rows
        df[r["at"]] = r["n"]
    return int(df[FEATURES]), df[:FEATURES]


def draw(rows: DataFrame, per_language: int) -> DataFrame:
    """lang, shard, body of the sample; ``rows``: id, lang, body. One count a language, then a filter on the hash of the id; no sort."""
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows_of"))  # one row a language
    order = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("langid")), F.lit(1 << 40))
    shard = F.pmod(order, F.lit(SHARDS + 1)).cast("int")
    shards = F.when(F.col("rows_of") < RARE, F.sequence(F.lit(0), F.lit(SHARDS - 1))).otherwise(F.array(shard))
    chosen = order < F.lit(1 << 40) * F.least(F.lit(1.0), per_language / F.col("rows_of"))
    return rows.join(F.broadcast(sizes), "lang").filter(chosen).select("lang", F.explode(shards).alias("shard"), "body")


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> dict:
    """The model: ``languages``, ``weights`` (buckets x languages), ``idf``, ``temperature``."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("body"))
    rows = rows.filter(F.col("body").isNotNull()).filter(~held_out(F.col("id")))

    def make():
        def work(batch):
            out = {"lang": [], "shard": [], "at": [], "n": []}
            for s, lang_, t in zip(batch["shard"].to_pylist(), batch["lang"].to_pylist(), batch["body"].to_pylist()):
                counted = counts_of(t)
                if counted:
                    for k, v in zip(out, (lang_, s, counted[0].astype(np.int32), counted[1].astype(np.int32))):
                        out[k].append(v)
            return out

        return work

    sample = draw(rows.filter(F.col("lang").isNotNull()), per_language)
    sample = store(arrow_map(sample, ["shard", "lang", "body"], "lang string, shard int, at array<int>, n array<int>", make), "sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    total, df = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1.0
    k = len(languages)
    z, n = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))
    number = {name: i for i, name in enumerate(languages)}

    def one_round(state):
        def run(key_, table):
            z0, n0 = (a.copy() for a in state.value)
            held = [(*vector((np.array(a), np.array(c)), idf), number[name]) for a, c, name in zip(
                table.column("at").to_pylist(), table.column("n").to_pylist(), table.column("lang").to_pylist())]
            order_ = np.random.default_rng(11 + key_[0].as_py()).permutation(len(held))
            _pass([held[i] for i in order_], z0, n0)
            return pa.table({"rows": [len(held)], "z": [z0.astype("<f8").tobytes()], "n": [n0.astype("<f8").tobytes()]},
                            schema=pa.schema([("rows", pa.int64()), ("z", pa.binary()), ("n", pa.binary())]))

        return run

    teach = sample.filter(F.col("shard") < SHARDS)  # the last shard calibrates
    for _ in range(ROUNDS if k > 1 else 0):
        state = context.broadcast((z, n))
        parts = teach.groupBy("shard").applyInArrow(one_round(state), "rows long, z binary, n binary").collect()  # SHARDS rows
        share = np.array([p["rows"] for p in parts], float) / max(sum(p["rows"] for p in parts), 1)
        parts = sorted(zip(share, parts), key=lambda p: bytes(p[1]["z"][:64]))
        z = sum(s * np.frombuffer(p["z"], "<f8").reshape(FEATURES, k) for s, p in parts)
        n = sum(s * np.frombuffer(p["n"], "<f8").reshape(FEATURES, k) for s, p in parts)
        state.unpersist()
    weights = ftrl_weights(z, n)
    model = {"languages": languages, "weights": weights, "idf": idf, "temperature": 1.0}
    if k > 1:
        model["temperature"] = _temperature(sample.filter(F.col("shard") == SHARDS), model, number)
    return model


def _temperature(rows: DataFrame, model: dict, number: dict) -> float:
    """The temperature with the least log loss on rows that did not train, by their logits (a bounded part of the sample)."""

    def make():
        def work(batch):
            out = {"z": [], "y": []}
            for a, c, name in zip(batch["at"].to_pylist(), batch["n"].to_pylist(), batch["lang"].to_pylist()):
                at, x = vector((np.array(a), np.array(c)), model["idf"])
                out["z"].append((x @ model["weights"][at]).tolist())
                out["y"].append(number[name])
            return out

        return work

    got = arrow_map(rows, ["at", "n", "lang"], "z array<double>, y int", make).collect()
    if not got:
        return 1.0
    z, y = np.array([g["z"] for g in got]), np.array([g["y"] for g in got])

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean())

    return min((float(t) for t in np.geomspace(0.25, 4, 60)), key=loss)


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages weights

    def make():
        m = shared.value
        names, weights, idf = m["languages"], m["weights"] / m["temperature"], m["idf"]

        def one(t):
            counted = counts_of(t) if names else None
            if counted is None:
                return "und", 0.0
            at, x = vector(counted, idf)
            p = _softmax(x @ weights[at])
            best = int(p.argmax())
            return names[best], float(p[best])

        def work(batch):
            found = [one(t) for t in batch["body"].to_pylist()]
            return {"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return work

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return arrow_map(rows, ["doc_id", "body"], "doc_id long, lang_pred string, score double", make)
