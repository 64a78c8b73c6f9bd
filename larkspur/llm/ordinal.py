"""Quality classifier: cumulative-link regression on graded ratings.

One weight vector over hashed text serves all grades; ordered thresholds part them:
P(grade > k) = sigmoid(w x - threshold k). The expected grade and the tail probability of the best grade
select documents. It learns on the driver from at most ``sample`` rated documents, of which only hashed
features are gathered; scoring runs over all rows without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrays import lists
from larkspur.llm.bpe import Memo
from larkspur.llm.names import col, fresh

BITS = 18
SHAPES = 5
MARKS = "#*$%&|<>^~="


@dataclass
class Ratings:
    """Learned weights (hashed features, then document shapes) and thresholds, ascending."""

    weights: np.ndarray
    thresholds: np.ndarray


def word_features(word: str) -> list[int]:
    """Places of a word, its beginnings and its ending signs in the hashed vector."""
    plain = word.lower().strip(".,;:!?\"'()[]")
    names = [f"w{plain}"] + [f"{n}{plain[:n]}" for n in (3, 4, 5, 6) if len(plain) >= n]
    if not word[-1].isalnum():
        names.append(f"e{word[-2:] if not word[-2:-1].isalnum() else word[-1:]}")
    return [zlib.crc32(x.encode("utf-8", "replace")) & ((1 << BITS) - 1) for x in names]


def shape(words: list[str], distinct: set[str]) -> list[float]:
    """Length, share of distinct words, of words that end in a mark, of shouted words and of separators."""
    n = max(len(words), 1)
    marked = sum(1 for w in distinct if w[-1] in MARKS and len(w) > 1)
    loud = sum(1 for w in distinct if len(w) > 2 and w.isupper())
    return [math.log1p(len(words)) / 8, len(distinct) / n, marked / max(len(distinct), 1), loud / max(len(distinct), 1), words.count("|") / n]


def document(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Feature places, values and shape of a whole text."""
    words = (text or "").split()
    distinct = set(words)
    places, counts = np.unique(np.array([p for w in sorted(distinct) for p in word_features(w)], dtype=np.int64), return_counts=True)
    return places, counts / math.sqrt(max(len(distinct), 1)), shape(words, distinct)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], grades: np.ndarray, weight: np.ndarray, n_grades: int, rounds: int = 6, rate: float = 0.3, decay: float = 1e-5, seed: int = 11) -> Ratings:
    """Adaptive gradient ascent of the cumulative-link likelihood; thresholds are kept in order by their gaps."""
    size = (1 << BITS) + SHAPES
    w, g2 = np.zeros(size), np.full(size, 1e-2)
    start, gaps = -1.0, np.zeros(n_grades - 2)  # thresholds: start, start + exp(gap), ...
    t2 = np.full(n_grades - 1, 1.0)
    rng = np.random.default_rng(seed)
    cuts = lambda: start + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    shapes = (1 << BITS) + np.arange(SHAPES)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = np.concatenate((rows[i][0], shapes)), np.concatenate((rows[i][1], rows[i][2]))
            theta, y = cuts(), int(grades[i])
            tail = _sigmoid(w[at] @ v - theta)  # P(grade > k)
            above, below = (tail[y - 1] if y else 1.0), (tail[y] if y < n_grades - 1 else 0.0)
            p = max(above - below, 1e-9)
            slope = tail * (1 - tail)
            push = np.zeros(n_grades - 1)  # d log p / d (w x - threshold k)
            if y:
                push[y - 1] += slope[y - 1] / p
            if y < n_grades - 1:
                push[y] -= slope[y] / p
            push = np.clip(push * weight[i], -5, 5)
            step = push.sum() * v - decay * w[at]
            g2[at] += step * step
            w[at] += rate * step / np.sqrt(g2[at])
            d = np.concatenate(([-push.sum()], [-push[k + 1 :].sum() * math.exp(gaps[k]) for k in range(n_grades - 2)]))
            t2 += d * d
            moved = 0.3 * d / np.sqrt(t2)
            start += moved[0]
            gaps = np.clip(gaps + moved[1:], -3, 3)
    return Ratings(w.astype(np.float32), cuts())


def learn(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, id_col: str = "doc_id", sample: int = 6000) -> Ratings:
    """Learns from ``ratings`` (id, grade from 0): at most ``sample / n_grades`` documents of each grade, by hash of the id.

    Each sampled document counts by its grade's share of all ratings, so that probabilities stay honest. Rows
    with a null id or grade teach nothing; without any rating every document gets even odds. Repeated rows of
    ``docs`` teach as often as they stand; texts count whole.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull())
    counts = {r[0]: r[1] for r in rated.groupBy("grade").count().collect()}
    if not counts:
        return Ratings(np.zeros((1 << BITS) + SHAPES, dtype=np.float32), np.zeros(n_grades - 1))
    each = sample // n_grades
    chance = F.lit(0.0)
    for g, n in counts.items():
        chance = F.when(F.col("grade") == g, F.lit(min(1.0, 0.9 * each / n if n > each else 1.0))).otherwise(chance)
    ids = rated.where(F.pmod(F.xxhash64(id_col, F.lit("rating")), F.lit(1 << 30)) < chance * float(1 << 30)).limit(2 * sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [document(t) for t in f["text"]]
            yield pd.DataFrame({"grade": f["grade"], "at": [x[0] for x in got], "v": [x[1] for x in got], "s": [x[2] for x in got]})

    rows = docs.select(id_col, "text").join(F.broadcast(ids), id_col).select("grade", "text")  # the ids are bounded by the sample
    rows = rows.mapInPandas(run, "grade int, at array<int>, v array<float>, s array<double>").toArrow()
    grade = rows["grade"].to_numpy()
    found = [(int(g), *x) for g, *x in zip(grade, lists(rows["at"]), lists(rows["v"]), lists(rows["s"]), strict=True)]
    found.sort(key=lambda x: (x[0], len(x[1]), zlib.crc32(x[1].tobytes()), x[3].tobytes()))
    if not found:
        return Ratings(np.zeros((1 << BITS) + SHAPES, dtype=np.float32), np.zeros(n_grades - 1))
    grades = np.array([x[0] for x in found])
    drawn = np.bincount(grades, minlength=n_grades)
    weight = np.array([counts.get(g, 0) / max(drawn[g], 1) for g in range(n_grades)])
    weight = np.sqrt(weight / max(weight.max(), 1e-9))
    return fit([x[1:] for x in found], grades, weight[grades], n_grades)


def score(docs: DataFrame, model: Ratings, keep: float = 0.2, names: tuple[str, str, str] = ("expected_grade", "p_best", "kept")) -> DataFrame:
    """All columns of ``docs`` with the expected grade, the best grade's probability and whether that is ``keep`` or more,
    under ``names`` (columns of those names are replaced).

    A text that is null or has no words says nothing: its odds come from the thresholds alone and it isn't kept.
    Texts of any length count whole; repeated rows get equal results; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, p_best double, kept boolean")
    def rate(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, theta = sent.value.weights.astype(np.float64), sent.value.thresholds
        hashed = w.tolist()
        known = Memo(lambda x: math.fsum([hashed[p] for p in word_features(x)]), 1 << 17)
        for texts in frames:
            out = []
            for text in texts:
                words = (text or "").split()
                distinct = set(words)
                x = math.fsum(map(known.__getitem__, distinct)) / math.sqrt(max(len(distinct), 1)) + float(w[1 << BITS :] @ shape(words, distinct))
                tail = _sigmoid(x - theta)
                out.append((float(tail.sum()), float(tail[-1]), bool(words) and bool(tail[-1] >= keep)))
            yield pd.DataFrame(out, columns=["expected_grade", "p_best", "kept"])

    once = rate.asNondeterministic()  # else a filter on the result runs it a second time
    rated = fresh("rate", docs.columns)
    own = [col(c) for c in docs.columns if c not in names]
    rows = docs.select(*map(col, docs.columns), once(col("text")).alias(rated))
    return rows.select(*own, *[F.col(rated)[field].alias(n) for field, n in zip(("expected_grade", "p_best", "kept"), names, strict=True)])


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Grades 0 (bad), 1 (good but toxic), 2 (good and clean); of several labels of a document the worst holds."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, expected_grade, p_best, kept)`` of every document."""
    model = learn(docs.select("doc_id", "text"), grades_of_labels(labels))
    return score(docs.select("doc_id", "text"), model).drop("text")
