"""Language identification by hierarchical discrimination.

Linear support vector machines, one for each pair, decide the language family first and then, within the
family, the language. Inputs are shares of hashed letter pairs and triples of the whole text. The machines
learn on the driver from a sample of at most ``sample`` documents a language and about ``most`` in all, one of each
language at least, of which only hashed counts are gathered; everything else runs over all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrays import lists
from larkspur.llm.names import col, fresh

FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "iranian": "fa ckb ku ps tg",
    "indic": "hi bn mr ne gu pa ur",
    "semitic": "ar he mt",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
DIMS = 1 << 15
LETTER = regex.compile(r"\p{L}")
PART = 1 << 20
PRIMES = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


def family(lang: str) -> str:
    """The family of a language code; a code that the table lacks is a family of its own."""
    return FAMILY_OF.get(lang.split("-")[0], lang)


def _known_letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x3000)])


IS_LETTER = _known_letters()


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """Hashed codes of letter pairs and triples, lower case, anything but letters as one space.

    A long text is coded part by part for the sake of memory; the last two codes go over to the next part, so that
    the parts give what the whole text gives.
    """
    low, before = text.lower(), np.array([32], dtype=np.uint32)
    for at in range(0, max(len(low), 1), PART):
        piece = low[at : at + PART] + (" " if at + PART >= len(low) else "")
        c = np.frombuffer(piece.encode("utf-32-le", "replace"), dtype=np.uint32)
        c = np.concatenate((before, np.where((c >= 0x3000) | IS_LETTER[np.minimum(c, 0x2FFF)], c, np.uint32(32))))
        old = len(before)
        c = c[np.concatenate((np.ones(old, dtype=bool), (c[old:] != 32) | (c[old - 1 : -1] != 32)))]
        two = c[:-1] * PRIMES[0] ^ c[1:] * PRIMES[1]
        three = two[:-1] ^ c[2:] * PRIMES[2]
        before = c[-2:]
        for code in (two[old - 1 :], three[max(old - 2, 0) :]):
            code ^= code >> np.uint32(15)
            code *= PRIMES[1]
            yield (code >> np.uint32(17)).astype(np.int32)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a text and their shares."""
    counts = np.zeros(DIMS, dtype=np.int64)
    for codes in gram_codes(text):
        counts += np.bincount(codes, minlength=DIMS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(counts.sum(), 1)).astype(np.float32)


@dataclass
class Machine:
    """``weights`` has a column for each pair; families come first."""

    langs: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray


SCALE = 30.0


def train_pair(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss) by dual coordinate descent over sparse rows."""
    w, b, alpha = np.zeros(DIMS), 0.0, np.zeros(len(rows))
    norm = np.array([float((v * v).sum()) * SCALE**2 + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            margin = sign[i] * (SCALE * float(w[at] @ v) + b)
            new = min(max(alpha[i] - (margin - 1) / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[at] += step * SCALE * v
                b += step
                alpha[i] = new
    return w, b


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], cost: float = 10.0, rounds: int = 12, seed: int = 7) -> Machine:
    langs = sorted({lang for lang, _, _ in sample})
    families = sorted({family(x) for x in langs})
    pairs = list(combinations(families, 2))
    for f in families:
        pairs += combinations([x for x in langs if family(x) == f], 2)
    weights, bias = np.zeros((DIMS, max(len(pairs), 1)), dtype=np.float32), np.zeros(max(len(pairs), 1))
    for k, (a, b) in enumerate(pairs):
        name = family if k < len(families) * (len(families) - 1) // 2 else str
        own = [(1.0 if name(lang) == a else -1.0, at, v) for lang, at, v in sample if name(lang) in (a, b)]
        w, c = train_pair([(at, v) for _, at, v in own], np.array([s for s, _, _ in own]), cost, rounds, seed + k)
        weights[:, k], bias[k] = w * SCALE, c
    return Machine(langs, families, pairs, weights, bias)


def _shares(names: list[str], first: int, pairs: list[tuple[str, str]], margins: np.ndarray) -> np.ndarray:
    """For each row the mean probability with which a name beats the others."""
    if len(names) == 1:
        return np.ones((len(margins), 1))
    out = np.zeros((len(margins), len(names)))
    for k, (a, b) in enumerate(combinations(names, 2), first):
        assert pairs[k] == (a, b)
        p = 1 / (1 + np.exp(-2 * np.clip(margins[:, k], -20, 20)))
        out[:, names.index(a)] += p
        out[:, names.index(b)] += 1 - p
    return out / (len(names) * (len(names) - 1) / 2)


def predict(m: Machine, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Languages and scores; ``und`` with score 0 for null, without a letter or with nothing learned."""
    lettered = [bool(t and LETTER.search(t)) for t in texts]
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    rows = [i for i, x in enumerate(lettered) if x] if m.langs else []
    if not rows:
        return langs, scores
    margins = np.zeros((len(rows), m.weights.shape[1]))
    for k, i in enumerate(rows):
        total = 0
        for codes in gram_codes(texts[i]):
            margins[k] += m.weights[codes].sum(axis=0, dtype=np.float64) if len(codes) < 4096 else np.bincount(codes, minlength=DIMS) @ m.weights
            total += len(codes)
        margins[k] = margins[k] / max(total, 1) + m.bias
    of_family = _shares(m.families, 0, m.pairs, margins)
    best = of_family.argmax(axis=1)
    first = len(m.families) * (len(m.families) - 1) // 2
    for f, name in enumerate(m.families):
        members = [x for x in m.langs if family(x) == name]
        at = np.flatnonzero(best == f)
        if len(at):
            share = _shares(members, first, m.pairs, margins[at])
            for k, row in zip(at, share, strict=True):
                langs[rows[k]] = members[int(row.argmax())]
                scores[rows[k]] = float(of_family[k, f] * row.max())
        first += len(members) * (len(members) - 1) // 2
    return langs, scores


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls on ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", sample: int = 1200, most: int = 12000) -> Machine:
    """Learns from rows of (id, text, lang) with a language and an id; the sample is drawn by hash of the id.

    Null and empty texts teach nothing; repeated rows count as often as they are drawn. Columns of other names are
    not read. Without any row nothing is learned, and ``identify`` then answers ``und``.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return Machine([], [], [], np.zeros((DIMS, 1), dtype=np.float32), np.zeros(1))
    each = max(1, min(sample, most // len(counts)))
    chance = spark.createDataFrame([(lang, int((1 << 30) * min(1.0, 0.9 * each / n if n > each else 1.0))) for lang, n in counts.items()], "lang string, chance long")
    drawn = known.join(F.broadcast(chance), "lang").where(F.pmod(F.xxhash64(id_col, F.lit("language")), F.lit(1 << 30)) < F.col("chance"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [features(t or "") for t in f["text"]]
            yield pd.DataFrame({"lang": f["lang"], "at": [a for a, _ in got], "v": [v for _, v in got]})

    rows = drawn.select("lang", "text").mapInPandas(run, "lang string, at array<int>, v array<float>").toArrow()
    found = [x for x in zip(rows["lang"].to_pylist(), lists(rows["at"]), lists(rows["v"]), strict=True) if len(x[1])]
    found.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes(), x[2].tobytes()))
    return train(found)


def identify(docs: DataFrame, machine: Machine, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with the language and its score (columns of the names given for these are replaced).

    Null texts and texts without a letter give ``und`` and 0; equal texts give equal results, and equal scores go to
    the language first by name. Texts of any length count whole. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        langs, scores = predict(sent.value, [None if t is None else t for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    once = guess.asNondeterministic()  # else a filter on the result runs it a second time
    guessed = fresh("guess", docs.columns)
    own = [col(c) for c in docs.columns if c not in (lang_col, score_col)]
    return docs.select(*map(col, docs.columns), once(col("text")).alias(guessed)).select(*own, F.col(guessed)["lang_pred"].alias(lang_col), F.col(guessed)["score"].alias(score_col))


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; a third of the ids is held out."""
    out = held_out("doc_id", 3, 1)
    machine = learn(docs.where(~out).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), machine).drop("text")
