"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, so that the nearest by cosine is the nearest by distance. Each of ``tables`` tables hashes a vector
with ``hashes`` Gaussian projections, floor((a.x + b) / width). A query visits, in every table, its own bucket and the
``probes`` - 1 perturbed buckets most likely to hold a neighbour, in order of the summed squared distances to the
bucket walls it would cross. Candidates of all tables are merged and ranked by exact cosine in double precision.

The number of projections starts at one that grows with the logarithm of the table, so buckets keep their expected size; as a
fixed number of probes then visits an ever smaller share of the rows, it is lowered until recall holds. Recall is measured in each
run: the exact neighbours of ``SAMPLE`` queries (those of the smallest xxhash64 of id) are found by brute force in blocks, and
the tables must hold ``RECALL`` of them in probed buckets; with no projection left, all rows are one bucket and the search is exact.
Buckets of a table are dealt to parts of about ``part_rows`` rows by a hash of the bucket; a part that holds more, because many
vectors share a bucket, is dealt to several blocks by id, and queries that probe it go to each; more than ``query_rows`` of them are dealt
to groups, each of which meets every block. A task sees one block and one group, and hands on each query's best only, so neither
candidates, vectors nor queries gather anywhere.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of a dimension other
than the most frequent one (ties: the smaller); ids that are null take no part; rows that repeat an id and vector count once,
and of several vectors of one id the nearest counts; the query's own id is never a result; fewer candidates give fewer
rows; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, store

#: Every vector is written once a table. Four tables with fewer projections find as much as sixteen, in less time.
TABLES = 4
PROBES = 480
WIDTH = 2.0
PART_ROWS = 16_384
#: Queries of one part in a task, with the keys they probe: some 4 KB each.
QUERY_ROWS = 8_192
SEED = 20_240
SAMPLE = 100
#: Of the sample's neighbours; 0.9 of all queries' is required, and 500 neighbours of the sample leave an error of about 0.01.
RECALL = 0.95


def hash_count(rows: int) -> int:
    """Projections a table to start from: grows with the logarithm of the number of rows."""
    return max(4, round(0.6 * math.log2(max(rows, 2)) + 2.5))


class Family:
    """The hash functions of all tables, from a seed."""

    def __init__(self, dimension: int, hashes: int, tables: int = TABLES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.width, self.tables, self.hashes = width, tables, hashes
        self.a = rng.normal(size=(tables, dimension, hashes))
        self.b = rng.uniform(0, width, (tables, 1, hashes))
        self.mix = rng.integers(1, 2**62, (tables, hashes), dtype=np.int64) | 1

    def project(self, table: int, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.a[table] + self.b[table]) / self.width

    def keys(self, table: int, cells: np.ndarray) -> np.ndarray:
        """One number for a bucket; buckets that agree by chance only add candidates."""
        return (cells.astype(np.int64) * self.mix[table]).sum(-1)

    def probes(self, table: int, projected: np.ndarray, count: int) -> np.ndarray:
        """Keys of the ``count`` buckets to visit for one query, likeliest first."""
        cell = np.floor(projected)
        low = projected - cell
        steps = sorted([(low[i] ** 2, i, -1) for i in range(len(low))] + [((1 - low[i]) ** 2, i, 1) for i in range(len(low))])
        found, heap = [cell], [(steps[0][0], (0,))] if steps else []
        while heap and len(found) < count:
            score, chosen = heapq.heappop(heap)
            dims = [steps[j][1] for j in chosen]
            if len(set(dims)) == len(dims):  # one hash can move one way only
                moved = cell.copy()
                for j in chosen:
                    moved[steps[j][1]] += steps[j][2]
                found.append(moved)
            last = chosen[-1]
            if last + 1 < len(steps):
                heapq.heappush(heap, (score - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (score + steps[last + 1][0], (*chosen, last + 1)))
        return np.unique(self.keys(table, np.array(found)))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec (doubles) of the vectors that take part."""
    vec = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).filter("id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.col("n").desc(), "d").limit(1).first()
    return rows.filter(F.size("vec") == (top["d"] if top else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows scaled by powers of two to a largest component near 1: no cosine changes, and squares neither overflow nor vanish."""
    m = np.stack([np.asarray(v, np.float64) for v in column.to_pylist()])
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, keepdims=True))[1])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _bytes(m: np.ndarray, kind: str = "<f8") -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(m, kind)]


def sample_neighbours(rows: DataFrame, is_query: Column, k: int, sample: int = SAMPLE) -> DataFrame:
    """vec, near (vectors of the exact ``k`` nearest) of up to ``sample`` queries, by brute force over blocks of rows."""
    drawn = rows.filter(is_query).orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # at most ``sample`` vectors
    queries = [(r["id"], r["vec"]) for r in drawn]

    def make():
        units = _unit(_matrix(pa.array([v for _, v in queries], pa.list_(pa.float64()))))

        def work(batch):
            m = _matrix(batch["vec"])
            score, ids, raw = units @ _unit(m).T, batch["id"].to_numpy(), _bytes(m)
            out = {"q": [], "vec_id": [], "score": [], "near": []}
            for q, (own, _) in enumerate(queries):
                s = np.where(ids == own, -np.inf, score[q])
                kth = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                at = np.flatnonzero((s >= kth) & (ids != own))
                for i in at[np.lexsort((ids[at], -s[at]))][:k]:
                    for name, value in zip(out, (q, int(ids[i]), float(s[i]), raw[i])):
                        out[name].append(value)
            return out

        return work

    found = arrow_map(rows, ["id", "vec"], "q int, vec_id long, score double, near binary", make) if queries else (
        rows.sparkSession.createDataFrame([], "q int, vec_id long, score double, near binary"))
    found = found.groupBy("q", "vec_id").agg(F.max(F.struct("score", "near")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("best.score").desc(), "vec_id"))
    near = found.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("q").agg(F.collect_list("best.near").alias("near"))
    given = rows.sparkSession.createDataFrame([(i, v) for i, (_, v) in enumerate(queries)], "q int, vec array<double>")
    return store(given.join(near, "q").drop("q").repartition(max(1, len(queries) // 5)), "sample-neighbours")


def measured_recall(neighbours: DataFrame, dimension: int, hashes: int, tables: int, probes: int, width: float) -> float:
    """The share of the sample's exact neighbours that lie in a probed bucket of any table; 1 without a sample."""

    def make():
        family = Family(dimension, hashes, tables, width)

        def work(batch):
            out = {"hits": [], "n": []}
            units = _unit(_matrix(batch["vec"]))
            for unit, near in zip(units, batch["near"].to_pylist()):
                near = _unit(np.frombuffer(b"".join(near), "<f8").reshape(len(near), -1))
                hit = np.zeros(len(near), bool)
                for t in range(tables):
                    keys = family.keys(t, np.floor(family.project(t, near)))
                    hit |= np.isin(keys, family.probes(t, family.project(t, unit[None])[0], probes))
                out["hits"].append(int(hit.sum()))
                out["n"].append(len(near))
            return out

        return work

    r = arrow_map(neighbours, ["vec", "near"], "hits long, n long", make).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).first()
    return r["hits"] / r["n"] if r["n"] else 1.0


def settled_hashes(rows: DataFrame, is_query: Column, k: int, start: int, dimension: int, tables: int, probes: int, width: float) -> int:
    """The most projections, from ``start`` down, with which the measured recall reaches ``RECALL``; 0 is an exact search."""
    neighbours = sample_neighbours(rows, is_query, k)
    for hashes in range(start, 0, -1):
        if measured_recall(neighbours, dimension, hashes, tables, probes, width) >= RECALL:
            return hashes
    return 0


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
            tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, part_rows: int = PART_ROWS,
            query_rows: int = QUERY_ROWS, hashes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for each query row's ``k`` nearest; ``is_query`` is a condition on column ``id``. Without
    ``hashes`` the number of projections is set by measured recall."""
    rows = store(usable(vectors, key, vector), "vectors")
    # single-precision input is shuffled as such: scaled by powers of two it loses nothing
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    count, dimension = shape["n"], shape["d"] or 1
    if hashes is None:
        hashes = settled_hashes(rows, is_query, k, hash_count(count), dimension, tables, probes, width) if count else 1
    if not hashes:
        tables = 1  # every table would be the same single bucket
    parts = max(1, -(-count // part_rows))

    def part_of(keys: np.ndarray) -> np.ndarray:
        spread = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return (spread % np.uint64(parts)).astype(np.int32)

    def count_parts():
        family = Family(dimension, hashes, tables, width)

        def work(batch):
            unit = _unit(_matrix(batch["vec"]))
            out = {"t": [], "p": [], "n": []}
            for t in range(tables):
                p, n = np.unique(part_of(family.keys(t, np.floor(family.project(t, unit)))), return_counts=True)
                out["t"] += [t] * len(p)
                out["p"] += p.tolist()
                out["n"] += n.tolist()
            return out

        return work

    def index():
        family = Family(dimension, hashes, tables, width)

        def work(batch):
            m = _matrix(batch["vec"])
            unit, ids, raw = _unit(m), batch["id"].to_pylist(), _bytes(m, kind)
            out = {"t": [], "p": [], "id": [], "key": [], "vec": []}
            for t in range(tables):
                keys = family.keys(t, np.floor(family.project(t, unit)))
                out["t"] += [t] * len(ids)
                out["p"] += part_of(keys).tolist()
                out["id"] += ids
                out["key"] += keys.tolist()
                out["vec"] += raw
            return out

        return work

    def visit():
        family = Family(dimension, hashes, tables, width)

        def work(batch):
            m = _matrix(batch["vec"])
            unit, raw = _unit(m), _bytes(m, kind)
            out = {"t": [], "p": [], "id": [], "keys": [], "vec": []}
            for t in range(tables):
                projected = family.project(t, unit)
                for i, q in enumerate(batch["id"].to_pylist()):
                    keys = family.probes(t, projected[i], probes)
                    where = part_of(keys)
                    for p in np.unique(where):
                        for name, value in zip(out, (t, int(p), q, keys[where == p], raw[i])):
                            out[name].append(value)
            return out

        return work

    sizes = arrow_map(rows, ["id", "vec"], "t int, p int, n long", count_parts).groupBy("t", "p").agg(F.sum("n").alias("n"))
    sizes = store(sizes.select("t", "p", F.ceil(F.col("n") / (2.0 * part_rows)).cast("int").alias("blocks")), "parts")
    data = arrow_map(rows, ["id", "vec"], "t int, p int, id long, key long, vec binary", index)
    asked = arrow_map(rows.filter(is_query), ["id", "vec"], "t int, p int, id long, keys array<long>, vec binary", visit)
    asked = store(asked, "asked")
    turns = asked.groupBy("t", "p").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("groups"))
    sizes = store(sizes.join(turns, ["t", "p"]), "parts-asked")  # parts that no query probes need no shuffle
    data = data.join(sizes, ["t", "p"]).withColumn("s", F.pmod(F.xxhash64("id", "vec"), F.col("blocks")).cast("int"))
    data = data.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("blocks", "groups")
    asked = asked.join(sizes, ["t", "p"]).withColumn("g", F.pmod(F.xxhash64("id", "vec"), F.col("groups")).cast("int"))
    asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "groups")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            keys, ids = left.column("key").to_numpy(), left.column("id").to_numpy()
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            m = np.frombuffer(b"".join(left.column("vec").to_pylist()), kind).reshape(len(ids), -1)[order].astype(np.float64)
            norms = np.sqrt((m * m).sum(1))
            for q, probed, raw in zip(right.column("id").to_pylist(), right.column("keys").to_pylist(), right.column("vec").to_pylist()):
                v = np.frombuffer(raw, kind).astype(np.float64)
                lo, hi = np.searchsorted(keys, probed, "left"), np.searchsorted(keys, probed, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi) if a < b] or [np.zeros(0, np.int64)])
                at = at[ids[at] != q]
                if not len(at):
                    continue
                score = (m[at] * v).sum(1) / (norms[at] * np.sqrt((v * v).sum()))
                found: dict[int, float] = {}
                for i in np.lexsort((ids[at], -score)):
                    found.setdefault(int(ids[at[i]]), float(score[i]))
                    if len(found) == k:
                        break
                out["query_id"] += [q] * len(found)
                out["vec_id"] += found
                out["score"] += found.values()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    keys_ = ["t", "p", "s", "g"]
    found = data.groupBy(*keys_).cogroup(asked.groupBy(*keys_)).applyInArrow(best, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
