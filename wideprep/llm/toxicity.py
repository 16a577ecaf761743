"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns each token into a symbol: insult, threat (verbs in their inflected forms), target, negation (contractions
too), reported speech, break (a comma, "but"), clause end, or nothing. Six small machines read the symbols: insults, threats,
a target nearby before or after, a negation shortly before with no break between, and reported speech anywhere earlier in
the clause. Their composition is one table of states; running it over a clause yields weighted matches of a pattern (plain, targeted,
negated, reported, ...), and it is the matched clauses that score, not the words alone.

Insults and their weights are learned: words and word beginnings (stems of ``STEMS`` letters) whose documents are
labelled toxic far more often than chance, among at most ``max_train`` labelled documents outside the held-out fold,
taken in a random order of ids. Of their terms the ``10 * MAX_LEXICON`` that most toxic documents hold are tested, and of those
that pass the ``MAX_LEXICON`` heaviest are kept; a rarer insult is not learned. The patterns' weights come from a logistic regression on the
same documents.

Defined cases: null and empty texts have no clause and get the score of a document without matches; labels that are
null, or contradict each other for one id, teach nothing; documents repeat freely; without any toxic or any clean label
the score is the smoothed share of toxic labels; whole texts are read; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out, store

MAX_TRAIN = 20_000
MAX_LEXICON = 5_000
STEMS = (4, 5, 6)
MIN_SHARE = 0.9
NEAR_TARGET, NEAR_NEGATION = 4, 3
TOKEN = re.compile(r"\w+n['’]t\b|\bn['’](?=\w)|\w+|[.!?;:\n,]")
ENDS, COMMA = frozenset(".!?;:\n"), ","
MEMO = 200_000


def inflected(verb: str, language: str) -> set[str]:
    """The regular forms of a verb."""
    if language == "en":
        stem = verb[:-1] if verb.endswith("e") else verb + verb[-1] if re.fullmatch(r".*[aeiou][bdgmnprt]", verb) and len(verb) < 5 else verb
        return {verb, verb + "s", stem + "ed", stem + "ing"}
    cut, endings = {"de": (2, "en e st t te ten tet et ete eten"), "fr": (2, "er e es é ée és ées ez ons ent era erai erez eront ait aient ant"),
                    "es": (2, "ar o as a an é ó amos aron ado ada ando aré ará arán aría")}[language]
    stem = verb[:-cut]
    return {verb, *(stem + e for e in endings.split()), *(("ge" + stem + "t", "ge" + stem + "et") if language == "de" else ())}


# Closed word classes of the grammar (English, German, French, Spanish); verbs by their regular forms, irregular ones beside them
THREAT_VERBS = {"en": "kill murder shoot stab strangle behead", "de": "töten umbringen erschießen", "fr": "tuer assassiner poignarder",
                "es": "matar asesinar apuñalar"}
IRREGULAR = "shot umgebracht umzubringen erschossen erschoss"
THREATS = frozenset(f for language, verbs in THREAT_VERBS.items() for v in verbs.split() for f in inflected(v, language)).union(IRREGULAR.split())
BREAKS = frozenset("but aber sondern mais pero sino".split()) | {COMMA}
TARGETS = frozenset("you your yours u he she they them him her du dich dir ihr euch sie tu te toi vous ils usted ustedes tú vosotros".split())
NEGATIONS = frozenset("not no never nor neither cannot without nicht kein keine niemals ne pas jamais nunca jamás ni tampoco".split())
REPORTS = frozenset("said says say wrote writes quoted quote called reported claims sagte schrieb nannte dit écrit dijo escribió llamó".split())

OTHER, END, BREAK, TARGET, NEGATION, REPORT, THREAT, INSULT = SYMBOLS = range(8)
PATTERNS = ("insult", "insult+target", "insult+negation", "insult+report", "threat", "threat+target", "threat+negation", "threat+report")


def _machine(start, step):
    """A transducer: (start state, step(state, symbol) -> (state, whether it marks a match here))."""
    return start, step


def _recent(symbol: int, reach: int, until: tuple[int, ...] = (END,)):
    """Marks symbols up to ``reach`` tokens after ``symbol``, with none of ``until`` between; breaks are not counted."""
    return _machine(0, lambda s, x: (0 if x in until else reach if x == symbol else s if x == BREAK else max(0, s - 1), s > 0))


def _earlier(symbol: int):
    """Marks symbols anywhere after ``symbol`` in the clause."""
    return _machine(0, lambda s, x: (0 if x == END else int(s or x == symbol), s > 0))


def _awaiting(symbols: tuple[int, ...], reach: int):
    """Marks a target up to ``reach`` tokens after one of ``symbols``, which then counts as targeted."""
    def step(s, x):
        if x == END:
            return 0, False
        if x in symbols:
            return reach, False
        return (0, s > 0) if x == TARGET else (s if x == BREAK else max(0, s - 1), False)
    return _machine(0, step)


def _emits(symbol: int):
    return _machine(0, lambda s, x: (0, x == symbol))


def compose(*machines):
    """The machines side by side as one: table[state][symbol] = (next state, marks of each machine)."""
    start = tuple(m[0] for m in machines)
    numbers, table, todo = {start: 0}, [], [start]
    while todo:
        state = todo.pop(0)
        row = []
        for symbol in SYMBOLS:
            steps = [m[1](s, symbol) for m, s in zip(machines, state)]
            after = tuple(s for s, _ in steps)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append((numbers[after], tuple(bool(mark) for _, mark in steps)))
        table.append(row)
    return table


def machines() -> tuple:
    """Insult, threat, target before, target after, negated, reported."""
    return (_emits(INSULT), _emits(THREAT), _recent(TARGET, NEAR_TARGET), _awaiting((INSULT, THREAT), NEAR_TARGET),
            _recent(NEGATION, NEAR_NEGATION, (END, BREAK)), _earlier(REPORT))


def grammar() -> list[list[tuple[int, tuple[bool, ...]]]]:
    return compose(*machines())


class Lexer(dict):
    """Token to (symbol, weight); forgets all when large."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token):
        if len(self) >= MEMO:
            self.clear()
        weight = max((self.lexicon.get(f, 0.0) for f in terms(token)), default=0.0)
        symbol = (INSULT if weight > 0 else THREAT if token in THREATS else TARGET if token in TARGETS
                  else NEGATION if token in NEGATIONS or token[-2:] in ("'t", "’t") or token in ("n'", "n’")
                  else REPORT if token in REPORTS else END if token in ENDS else BREAK if token in BREAKS else OTHER)
        out = self[token] = (symbol, weight if symbol == INSULT else 1.0)
        return out


def terms(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def match_clauses(text: str | None, lexer: Lexer, table) -> np.ndarray:
    """Summed weights of the matched patterns, in the order of ``PATTERNS``."""
    out = np.zeros(len(PATTERNS))
    read = [lexer[t] for t in TOKEN.findall(text.lower())] if text else []
    if not read or max(s for s, _ in read) < THREAT:
        return out
    at = 0
    while at < len(read):
        end = at
        while end < len(read) and read[end][0] != END:
            end += 1
        clause = read[at:end]
        at = end + 1
        if max((s for s, _ in clause), default=0) < THREAT:
            continue
        state, last = 0, None
        for symbol, weight in clause:
            state, (insult, threat, targeted, upgrade, negated, reported) = table[state][symbol]
            if insult or threat:
                base = 0 if insult else 4
                last = base, weight
                out[base + (3 if reported else 2 if negated else 1 if targeted else 0)] += weight
            elif upgrade and last:
                out[last[0] + 1] += last[1]  # "clown, you": the target after it adds a targeted match
                last = None
    return out


def _features(matches: np.ndarray) -> np.ndarray:
    return np.log1p(matches)


def _training(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_train: int) -> DataFrame:
    """toxic, body of the labelled documents that teach."""
    ids = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).filter(~held_out(F.col(key)))
    ids = ids.groupBy(F.col(key).cast("long").alias("__id")).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    ids = ids.filter("lo = hi").select("__id", (F.col("hi") > 0).cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("__id", F.lit("toxicity")), "__id").limit(max_train)  # a documented bound
    body = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).cast("string").alias("body"))
    return store(body.join(F.broadcast(store(ids, "labelled")), "__id").select("toxic", "body"), "training")


def _term_counts(training: DataFrame, only: frozenset | None) -> DataFrame:
    """term, toxic, n: documents of each label that hold the term; counts leave a task summed."""

    def make():
        def work(batch):
            count = Counter()
            for y, t in zip(batch["toxic"].to_pylist(), batch["body"].to_pylist()):
                found = {f for w in set(TOKEN.findall((t or "").lower())) if w not in ENDS and w != COMMA for f in terms(w)}
                count.update((f, y) for f in (found if only is None else found & only))
            return {"term": [f for f, _ in count], "toxic": [y for _, y in count], "n": list(count.values())}

        return work

    parts = arrow_map(training, ["toxic", "body"], "term string, toxic int, n long", make)
    return parts.groupBy("term", "toxic").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          max_train: int = MAX_TRAIN) -> dict:
    """The model: ``lexicon`` (term to weight), ``bias``, and ``weights`` of the patterns."""
    training = _training(docs, labels, key, text, label, max_train)
    totals = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        share = (bad + 1) / (bad + good + 2)
        return {"lexicon": {}, "bias": float(np.log(share / (1 - share))), "weights": [0.0] * len(PATTERNS)}
    first = _term_counts(training.filter("toxic = 1"), None)
    candidates = first.orderBy(F.col("n").desc(), "term").limit(10 * MAX_LEXICON).collect()  # bounded
    ours = frozenset(r["term"] for r in candidates)
    clean = {r["term"]: r["n"] for r in _term_counts(training.filter("toxic = 0"), ours).collect()}
    lexicon, base = {}, bad / (bad + good)
    for r in candidates:
        n, m = r["n"], clean.get(r["term"], 0)
        share = n / (n + m)
        # log-likelihood ratio against the base rate; a chance find among all candidates has to be unlikely
        gain = n * np.log(share / base) + (m * np.log((1 - share) / (1 - base)) if m else 0.0)
        if share >= MIN_SHARE and gain > np.log(max(len(candidates), 2)):
            lexicon[r["term"]] = float(np.log((n + 0.5) / bad / ((m + 0.5) / good)))
    lexicon = dict(sorted(lexicon.items(), key=lambda x: (-x[1], x[0]))[:MAX_LEXICON])
    x, y, n = _counted(training, lexicon)
    bias, weights = _logistic(x, y, n)
    return {"lexicon": lexicon, "bias": bias, "weights": weights}


def _counted(training: DataFrame, lexicon: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pattern features of the training documents, label, and how often each such row occurs (at most ``max_train`` rows)."""

    def make():
        lexer, table = Lexer(lexicon), grammar()

        def work(batch):
            found = [np.round(_features(match_clauses(t, lexer, table)), 1).tolist() for t in batch["body"].to_pylist()]
            return {"x": found, "toxic": batch["toxic"]}

        return work

    rows = arrow_map(training, ["toxic", "body"], "x array<double>, toxic int", make)
    rows = rows.groupBy("x", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort(key=lambda r: (r["toxic"], list(r["x"])))
    return np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), np.array([r["n"] for r in rows], float)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> tuple[float, list[float]]:
    """Newton steps of a ridge logistic regression; pattern weights do not go below zero."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (n * (p - y)) + penalty @ w
        step = np.linalg.solve(a.T @ (a * (n * p * (1 - p))[:, None]) + penalty, gradient)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    kept = np.maximum(w[1:], 0.0)
    bias, rest = w[0], x @ kept
    for _ in range(50):  # the bias that goes with the weights kept
        p = 1 / (1 + np.exp(-np.clip(bias + rest, -30, 30)))
        bias += min(4.0, max(-4.0, float((n * (y - p)).sum() / max((n * p * (1 - p)).sum(), 1e-9))))
    return float(bias), [float(v) for v in kept]


def score_text(text: str | None, model: dict, lexer: Lexer, table) -> float:
    z = model["bias"] + float(_features(match_clauses(text, lexer, table)) @ np.array(model["weights"]))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: every whole text, a row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LEXICON terms

    def make():
        lexer, table = Lexer(shared.value["lexicon"]), grammar()

        def work(batch):
            return {"doc_id": batch["doc_id"], "score": [score_text(t, shared.value, lexer, table) for t in batch["body"].to_pylist()]}

        return work

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return arrow_map(rows, ["doc_id", "body"], "doc_id long, score double", make)


def keep_clean(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows and columns of ``docs`` that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts):
        import pandas as pd

        lexer, table = Lexer(shared.value["lexicon"]), grammar()
        return pd.Series([score_text(t, shared.value, lexer, table) for t in texts], dtype=float)

    return docs.filter(toxic(F.col(text).cast("string")) < threshold)
