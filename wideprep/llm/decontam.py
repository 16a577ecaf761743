"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are short and documents long, so the MinHash of a whole document says little about an item inside it. Items are
partitioned by size (shingle counts from 2^c to below 2^(c+1)); for each class, a document is searched in overlapping windows
of two class sizes, so that a passage of item size lies whole in one window and the Jaccard similarity of item and
window has a floor that depends on the class alone. An item is a candidate if any of ``permutations`` minimums of a window equals
the item's (bands of one row: with containment 0.8 the chance to miss is below 1e-6). Items are found by an inverted index of
(permutation, minimum), so a window costs the same with few items and with many. Minimums are only computed for
windows that hold some shingle of some item; no other window can share one.

Each candidate is verified exactly: the share of the item's distinct shingles that occur anywhere in the document must
reach ``containment``; shingles are compared as words, not as hashes.

Equal item texts are one text for the search; ids come back by a join. Size classes and minimums of items are worked out in tasks. Documents
are scanned once for each block of item texts (about ``BLOCK_ITEMS`` texts or ``BLOCK_CHARS`` characters, and at most half of either if
they spread evenly), which is broadcast; nothing about documents is shuffled.

Defined cases: words are runs of letters and digits in lower case; null, empty and shorter-than-a-shingle texts and
items share nothing and match nothing; repeated rows and items match each; ties do not arise, every item above the
threshold is returned; without documents or items there is no row; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, store

SHINGLE = 5
CONTAINMENT = 0.8
PERMUTATIONS = 96
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32_000_000
WORD = re.compile(r"[^\W_]+")
MEMO = 200_000
FOUND = "doc_id long, number long, shared long, item_shingles long, containment double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when large."""

    def __missing__(self, word):
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words."""
    if len(word_hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(word_hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + word_hashes[i:len(word_hashes) - n + 1 + i]
    return _mix(out)


class Signatures:
    """The permutations, and size class and minimums of a set of shingle hashes."""

    def __init__(self, n: int, permutations: int):
        self.n = n
        rng = np.random.default_rng(20240501)
        self.a = rng.integers(1, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, permutations, dtype=np.uint64)

    def minimums(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(h), 4096):
            out = np.minimum(out, _mix(h[i:i + 4096, None] * self.a + self.b).min(0))
        return out

    def keys(self, minimums: np.ndarray) -> np.ndarray:
        """One number for (permutation, minimum); numbers that agree by chance only add candidates."""
        return _mix(minimums + np.arange(len(self.a), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def of(self, text: str | None, hashes: WordHashes) -> tuple[int, np.ndarray] | None:
        """Size class and keys of an item; None if it is shorter than a shingle."""
        words = words_of(text)
        grams = {tuple(words[i:i + self.n]) for i in range(len(words) - self.n + 1)}
        if not grams:
            return None
        h = np.unique(shingle_hashes(np.array([hashes[w] for w in words], np.uint64), self.n))
        return len(grams).bit_length() - 1, self.keys(self.minimums(h))


class ItemIndex:
    """A block of item texts: (number, text, size class, keys). What the search needs is made when first used, once a process."""

    def __init__(self, items: list[tuple[int, str, int, bytes]], signatures: Signatures):
        self.items, self.signatures, self.classes = items, signatures, None

    def ready(self) -> ItemIndex:
        if self.classes is not None:
            return self
        n, by_class = self.signatures.n, {}
        self.vocabulary, self.ids, self.shingles = set(), [], []
        for number, text, size, keys in self.items:
            words = words_of(text)
            self.vocabulary.update(words)
            by_class.setdefault(size, []).append((len(self.ids), np.frombuffer(keys, "<u8")))
            self.ids.append(number)
            self.shingles.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)})
        self.known = {g for grams in self.shingles for g in grams}
        self.classes = {}
        for size, members in by_class.items():
            keys = np.concatenate([k for _, k in members])
            order = np.argsort(keys, kind="stable")
            self.classes[size] = keys[order], np.repeat([i for i, _ in members], len(members[0][1]))[order]
        return self

    def sharing(self, size: int, h: np.ndarray) -> set[int]:
        """Items of a class with some minimum of these shingle hashes."""
        keys, owners = self.classes[size]
        own = self.signatures.keys(self.signatures.minimums(h))
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        return {int(x) for a, b in zip(lo, hi) if a < b for x in owners[a:b]}

    def search(self, words: list[str], hashes: WordHashes, containment: float) -> list[tuple[int, int, int, float]]:
        """(item_id, shared, item_shingles, containment) of the items found in a document."""
        n = self.signatures.n
        if len(words) < n:
            return []
        # runs of n words that items know, first by their words, then whole
        in_items = np.fromiter(map(self.vocabulary.__contains__, words), np.int64, len(words))
        runs = np.flatnonzero(np.convolve(in_items, np.ones(n, np.int64), "valid") == n)
        at = [int(i) for i in runs if tuple(words[i:i + n]) in self.known]
        if not at:
            return []
        held = {tuple(words[i:i + n]) for i in at}
        positions, total = np.array(at), len(words) - n + 1
        candidates: set[int] = set()
        for size in self.classes:
            upper = 2 ** (size + 1)
            length = 2 * upper
            if total <= length:
                starts = [0]
            else:
                first = positions // upper
                starts = sorted({int(x) * upper for x in np.concatenate([first, first - 1]) if x >= 0})
            for s in starts:
                span = words[s:s + length + n - 1]
                h = shingle_hashes(np.array([hashes[w] for w in span], np.uint64), n)
                candidates |= self.sharing(size, np.unique(h))
        out = []
        for c in sorted(candidates):
            shared, of = len(self.shingles[c] & held), len(self.shingles[c])
            if shared >= containment * of:
                out.append((self.ids[c], shared, of, shared / of))
        return out


def _item_texts(benchmark: DataFrame, key: str, text: str, shingle: int, permutations: int) -> tuple[DataFrame, DataFrame]:
    """The distinct item texts with number, size class and keys, stored; and the rows (item_id, number)."""
    rows = benchmark.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("item")).filter("item is not null")

    def make():
        signatures, hashes = Signatures(shingle, permutations), WordHashes()

        def work(batch):
            out = {"item": [], "size": [], "keys": []}
            for t in batch["item"].to_pylist():
                signed = signatures.of(t, hashes)
                if signed:
                    for name, value in zip(out, (t, signed[0], signed[1].astype("<u8").tobytes())):
                        out[name].append(value)
            return out

        return work

    signed = arrow_map(rows.select("item").distinct(), ["item"], "item string, size int, keys binary", make)
    texts = store(signed.withColumn("number", F.monotonically_increasing_id()), "item-texts")
    return texts, rows.join(texts.select("item", "number"), "item").select("item_id", "number")


def _blocks(texts: DataFrame, signatures: Signatures) -> Iterator[ItemIndex]:
    """The item texts in parts of bounded size."""
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size["n"] // (BLOCK_ITEMS // 2)), -(-size["chars"] // (BLOCK_CHARS // 2)))
    for i in range(parts):
        part = texts.filter(F.pmod(F.xxhash64("number"), F.lit(parts)) == i)
        yield ItemIndex([(r["number"], r["item"], r["size"], bytes(r["keys"])) for r in part.collect()], signatures)  # one block


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT,
                 permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment: one row for each item that a document holds."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    context = docs.sparkSession.sparkContext
    texts, items = _item_texts(benchmark, item_key, item_text, shingle, permutations)
    found = []
    for block in _blocks(texts, Signatures(shingle, permutations)):
        index = context.broadcast(block)

        def make(index=index):
            here, hashes = index.value.ready(), WordHashes()

            def work(batch):
                hits = [(d, *hit) for d, t in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist())
                        for hit in here.search(words_of(t), hashes, containment)]
                return {k: [h[i] for h in hits] for i, k in enumerate(("doc_id", "number", "shared", "item_shingles", "containment"))}

            return work

        found.append(arrow_map(rows, ["doc_id", "body"], FOUND, make))
    return reduce(DataFrame.unionAll, found).join(items, "number").select("doc_id", "item_id", "shared", "item_shingles", "containment")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows and columns of ``docs`` without documents that hold an item. Each row is judged by its own text, and rows
    with a null id as well."""
    context = docs.sparkSession.sparkContext
    shingle, containment, permutations = how.get("shingle", SHINGLE), how.get("containment", CONTAINMENT), how.get("permutations", PERMUTATIONS)
    texts, _ = _item_texts(benchmark, how.get("item_key", "item_id"), how.get("item_text", "text"), shingle, permutations)
    out = docs
    for block in _blocks(texts, Signatures(shingle, permutations)):
        index = context.broadcast(block)

        @F.pandas_udf("boolean")
        def clean(texts, index=index):
            import pandas as pd

            here, hashes = index.value.ready(), WordHashes()
            return pd.Series([not here.search(words_of(t), hashes, containment) for t in texts], dtype=bool)

        out = out.filter(clean(F.col(text).cast("string")))
    return out
