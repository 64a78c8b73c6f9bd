"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is cut into partitions of equal size; a small classifier learns to name
a vector's partition. Every vector is filed under its most probable partition, a query goes to several, and
all vectors found there are ranked by exact cosine. How many partitions a query visits is read off the
sample: so many that they hold nearly all true neighbours of the sample's own vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.names import col
from larkspur.llm.storage import stage


@dataclass
class Router:
    """A perceptron with one hidden layer; ``probes`` partitions are visited."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each row, itself apart, in blocks of bounded size."""
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def cut_graph(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Balanced partition of the neighbour graph: grown from spread seeds, then vertices move to the partition of
    most of their neighbours while it has room."""
    rng, n = np.random.default_rng(seed), len(x)
    room = int(np.ceil(slack * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(6):
        own = np.argmax(x @ centres.T, axis=1)
        for p in range(parts):
            if (own == p).any():
                c = x[own == p].sum(axis=0)
                centres[p] = c / max(np.linalg.norm(c), 1e-9)
    pull = x @ centres.T
    label, size = np.full(n, -1), np.zeros(parts, dtype=np.int64)
    for i in np.argsort(-pull.max(axis=1), kind="stable"):
        for p in np.argsort(-pull[i], kind="stable"):
            if size[p] < room:
                label[i], size[p] = p, size[p] + 1
                break
    both = [[] for _ in range(n)]
    for i, row in enumerate(near.tolist()):
        for j in row:
            both[i].append(j)
            both[j].append(i)
    links = [np.array(b) for b in both]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[links[i]], minlength=parts)
            here = label[i]
            for p in np.argsort(-votes, kind="stable")[:3]:
                if votes[p] <= votes[here]:
                    break
                if size[p] < room:
                    size[here], size[p], label[i] = size[here] - 1, size[p] + 1, p
                    moved += 1
                    break
        if moved < n // 200:
            break
    return label


def train(x: np.ndarray, parts: int, wanted: float = 0.985, neighbours: int = 10, hidden: int = 128, epochs: int = 25, seed: int = 3) -> Router:
    """Fits partitions and router to unit vectors ``x``."""
    d = x.shape[1] if x.ndim == 2 else 0
    if parts < 2 or len(x) <= 4 * neighbours:
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1)
    near = _neighbours(x, neighbours)
    label = cut_graph(x, near, parts)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(i)), label[i]] -= 1
            p /= len(i)
            back = (p @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x[i].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.005 * 0.9**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    router = Router(*w, parts)
    order = np.argsort(-router.odds(x), axis=1, kind="stable")
    filed, place = order[:, 0], np.argsort(order, axis=1)  # place[i, p]: how late i visits p
    late = np.take_along_axis(place, filed[near[:, :5]], axis=1).ravel()
    router.probes = int(np.searchsorted(np.cumsum(np.bincount(late, minlength=parts)) / len(late), wanted) + 1)
    return router


def usable(vector: Column, size: int | None = None) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(out, F.lit(False))


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of ``v`` for each row of ``q``, its own among them; ties go to the smaller id. Equal vectors
    are compared once.

    Cosines are settled in steps of 1e-12 for the order, so that scaled copies of one direction tie.
    """
    order = np.lexsort((v_id,))
    v_id, v = v_id[order], v[order]
    kinds, of = np.unique(v, axis=0, return_inverse=True)
    of = of.ravel()
    grouped = np.argsort(of, kind="stable")  # rows of one kind together, ids ascending
    start = np.searchsorted(of[grouped], np.arange(len(kinds) + 1))
    scale_q, scale_k = np.linalg.norm(q, axis=1), np.linalg.norm(kinds, axis=1)
    s = (q / scale_q[:, None]) @ (kinds / scale_k[:, None]).T
    some = min(k, len(kinds))
    rows = []
    for i in range(len(q)):
        at = np.flatnonzero(s[i] >= np.partition(s[i], -some)[-some] - 1e-9)  # all that may tie with the last
        exact = np.einsum("ij,j->i", kinds[at], q[i]) / (scale_k[at] * scale_q[i])
        found = []
        for j, x in zip(at, exact, strict=True):
            ids = v_id[grouped[start[j] : min(start[j + 1], start[j] + k)]]
            found += [(-round(float(x), 12), int(y), x) for y in ids]
        rows += [(int(q_id[i]), y, x) for _, y, x in sorted(found)[:k]]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, part_rows: int = 800, sample: int = 8192, block_rows: int = 4096, group_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each query, its own id apart.

    ``vectors`` and ``queries`` have an id and a vector. Null ids, and vectors that are null, zero, not finite
    or of another length than most, take no part; equal vectors rank by id. A query id that is repeated with other
    vectors asks with the one first in order. Columns of other names are not read; empty tables give an empty one. The
    sample is drawn by hash of the id. A partition's rows are dealt into blocks of about ``block_rows`` and its queries
    into groups of about ``group_rows``, so one vector with a third of all rows spreads over tasks; queries of equal
    vectors are asked once.
    """
    spark = vectors.sparkSession
    good = lambda df: df.where(col(id_col).isNotNull() & usable(col(vector_col))).select(col(id_col).cast("long").alias("id"), col(vector_col).alias("v"))
    rows = good(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, total = sizes[0]["d"], sizes[0]["count"]
    parts = int(min(1024, max(1, total // part_rows)))
    sample = max(sample, 32 * parts)
    rows = rows.where(F.size("v") == d)
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total))).orderBy("id").limit(2 * sample).toPandas()
    x = np.unique(_unit(drawn["v"]), axis=0) if len(drawn) else np.zeros((0, d))
    sent = spark.sparkContext.broadcast(train(x.astype(np.float32), parts))

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(part=sent.value.odds(_unit(f["v"])).argmax(axis=1).astype(np.int32))

    kind = rows.schema["v"].dataType.simpleString()
    filed = stage(rows.mapInPandas(file, f"id long, v {kind}, part int"), "filed")
    held = {r[0]: r[1] for r in filed.groupBy("part").count().collect()}  # at most 1024 rows
    even = int(min(block_rows, max(64, -(-total // max(parts, 12)))))
    shape = spark.createDataFrame([(p, n, max(1, -(-n // even))) for p, n in held.items()], "part int, n long, blocks int")

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            order = np.argsort(-sent.value.odds(_unit(f["v"])), axis=1, kind="stable")
            visits = []
            for row in order.tolist():
                own, seen = [], 0
                for p in row:
                    if len(own) >= sent.value.probes and seen > k:
                        break
                    own.append(p)
                    seen += held.get(p, 0)
                visits.append(own)
            yield f.assign(part=visits)

    every = stage(good(queries).where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")), "queries")
    one = stage(every.groupBy("v").agg(F.min("id").alias("q")), "vectors")
    asked = one.select(F.col("q").alias("id"), "v").mapInPandas(route, f"id long, v {kind}, part array<int>").withColumn("part", F.explode("part"))
    asked = stage(asked, "asked")
    groups = asked.groupBy("part").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("groups"))  # at most 1024 rows
    shape = F.broadcast(shape.join(groups, "part"))
    dealt = lambda df, name, n: df.join(shape, "part").withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), n).cast("int"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = dealt(asked, "group", F.col("groups")).select("id", "v", "part", "group", all_of("blocks").alias("block"), F.lit(True).alias("asks"))
    there = dealt(filed, "block", F.col("blocks")).select("id", "v", "part", all_of("groups").alias("group"), "block", F.lit(False).alias("asks"))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        q, v = f[f["asks"]], f[~f["asks"]]
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        stacked = np.stack([np.asarray(a, dtype=np.float64) for a in v["v"]])
        asking = np.stack([np.asarray(a, dtype=np.float64) for a in q["v"]])
        return _best(q["id"].to_numpy(), asking, v["id"].to_numpy(), stacked, k + 1)

    found = asked.unionByName(there).groupBy("part", "group", "block").applyInPandas(compare, "query_id long, vec_id long, score double")
    order = [F.desc(F.round("score", 12)), F.col("vec_id")]
    rank = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    near = found.withColumn("rank", rank("query_id")).where(F.col("rank") <= k + 1).select(F.col("query_id").alias("q"), "vec_id", "score")
    own = every.join(one, "v").select(F.col("id").alias("query_id"), "q")
    return own.join(near, "q").where("vec_id != query_id").withColumn("rank", rank("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """Every row whose vec_id is divisible by 50 against all rows, as ``search`` defines it for nulls, ties and repeated rows."""
    return search(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))
