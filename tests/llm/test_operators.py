"""The training-data operators on small fixtures, against brute force, and on awkward rows."""

import hashlib
import itertools
import math
import os
import random
import re
import subprocess
import sys
import urllib.parse
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspur.llm import ann, bpe, brown, components, html_extract, jaccard, langid, line_rules, mixing, ordinal, storage, url_filter
from larkspur.llm.registry import ORACLE_SQL, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, score string"
SPACE = " \t\n\v\f\r"


def words_of(text):
    out, now = [], ""
    for c in text or "":
        if c in SPACE:
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def corpus(seed=1, n=60):
    """Prose, near copies, copies, an empty, a null and a long text, repeated rows, null keys and clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) + "." for _ in range(n)]
    for i in range(12):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0]] * 4 + ["", None, " \n\t ", "one", "one two three", "One TWO three", " ".join(rng.choice(vocabulary) for _ in range(30_000))]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None, "é"]), 0, "q", "s") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def fill(sizes, weights, share=1.5, cap=2.0):
    left, target = share * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            return target
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def test_mixing(docs, none):
    got = mixing.taken(mixing.mix(docs)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in mixing.taken(mixing.mix(docs.repartition(5))).collect())
    rows = corpus()
    size = {r[0]: len(words_of(r[1])) for r in rows}
    assert {r["doc_id"]: r["size"] for r in got} == size and len(got) == len(rows)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    totals = [sum(size[r[0]] for r in rows if r[3] == s) for s in names]
    targets = fill(totals, [(3, 1, 2)[i % 3] for i in range(len(names))])
    for s, total, target in zip(names, totals, targets, strict=True):
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == total for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= 96
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.taken(mixing.mix(none)).count() == 0


def test_mixing_repeats_rows_and_makes_documents(spark, docs):
    twice = spark.createDataFrame([(1, "a b c", "en", "x", 5, "", "")] * 3 + [(2, None, "en", "x", 0, "", "")], SCHEMA)
    assert mixing.taken(mixing.mix(twice)).agg(F.count("*"), F.sum("size")).first()[:] == (4, 9)
    plan = mixing.taken(mixing.mix(docs)).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(words_of(r["text"])) for r in rows) == plan and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_mixing_broadcasts_no_exploded_blocks(docs):
    """Slots and pieces are many more rows than the small tables they are exploded from."""
    for made in (mixing.mixed_documents(docs), mixing.taken(mixing.mix(docs))):
        made.collect()
        joins = re.findall(r"(\w+Join)(?:\(skew=true\))? \[source_no#\d+, block#\d+L?\]", made._jdf.queryExecution().executedPlan().toString())
        assert set(joins) == {"SortMergeJoin"}


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 64, 101):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


# 2


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    vectors = [(int(i), (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(2500)]
    same = [(3000 + i, vectors[0][1]) for i in range(300)]
    odd = [(4000, None), (4050, [0.0] * 16), (4100, [float("nan")] * 16), (4150, [1.0, None] + [0.0] * 14), (4200, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(vectors + same + odd, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 50 = 0")).collect()
    data = {i: np.array(v, dtype=np.float32).astype(float) for i, v in vectors + same}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in (i for i in ids if i % 50 == 0):
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s[np.searchsorted(ids, m[1])] - m[2]) < 1e-9 for m in mine)
        hit, total = hit + len({m[1] for m in mine} & set(best)), total + 5
    assert hit / total >= 0.9
    first = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 3000), key=lambda r: r["rank"])]
    assert first == [0, 3001, 3002, 3003, 3004]


def test_ties_of_many_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    one = rng.normal(size=8)
    scaled = [(int(i), (one * (1 + 0.37 * int(k))).tolist()) for k, i in enumerate(rng.permutation(40))]
    hot = [(100 + i, [float(i % 30 == j) for j in range(30)]) for i in range(30)]
    for rows, asked, best in ((scaled, 7, [0, 1, 2, 3, 4]), (hot, 129, [100, 101, 102, 103, 104])):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = ann.search(df, df.where(F.col("vec_id") == asked)).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == best


def test_recall_with_many_partitions_and_a_hot_vector(spark):
    """Eighty partitions, a sample of a fifth of the rows, queries and rows dealt into small groups, a third of one vector."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([centres[rng.integers(60, size=5400)] + 0.5 * rng.normal(size=(5400, 16)), np.repeat(rng.normal(size=(1, 16)), 2600, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, part int, `a.b` string")
    got = ann.search(df, df.where("vec_id % 50 = 0"), part_rows=100, sample=1600, block_rows=256, group_rows=8).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 8000, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        hit += len(found[q] & set(np.lexsort((np.arange(8000), -s))[:5].tolist()))
        assert len(found[q]) == 5
    assert hit / (5 * 160) >= 0.9


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["vec_id"]) for r in ann.digest(df).collect()) == [(0, 50), (0, 50), (50, 0)]
    assert ann.digest(df.limit(0)).count() == 0


# 3


def test_brown_scores(spark, docs, none):
    rows = corpus()
    tokens = {r[0]: [w.encode().lower() for w in words_of(r[1])] + [0] for r in rows}
    out = {r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows}
    c = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = brown.digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-6
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert brown.digest(none).count() == 0
    lone = brown.digest(spark.createDataFrame([(None, "a b", "", "", 0, "", "")], SCHEMA)).first()
    assert lone["train_tokens"] == 0 and lone["n_known"] == 0


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    pairs = np.zeros((41, 41))
    for _ in range(6000):  # even words follow odd words
        a = rng.integers(20) * 2
        b = rng.integers(20) * 2 + 1
        pairs[a, b] += 1
        pairs[b, rng.integers(20) * 2] += 1
    of = brown.exchange(pairs, 2)
    assert len(set(of[0:40:2])) == len(set(of[1:40:2])) == 1 and of[0] != of[1] and of[40] == 2


def test_moves_against_whole_tables():
    """The class that each word alone moves to, by the likelihood of the whole table with the word in each class."""
    rng = np.random.default_rng(3)
    classes, words = 5, 60
    k = classes + 1
    of = np.append(rng.integers(0, classes, words), classes)
    pairs = rng.poisson(0.6 * rng.random((words + 1, words + 1)) ** 3)
    member = np.eye(k)[of]
    table = member.T @ pairs @ member
    alone = pairs - np.diag(np.diag(pairs))
    before, after, same = (alone.T @ member)[:words], (alone @ member)[:words], np.diag(pairs)[:words]
    got = brown.best_classes(before, after, same, of[:words], table, classes)
    for w in range(words):
        values = []
        for c in range(classes):
            m = member.copy()
            m[w] = np.eye(k)[c]
            values.append(brown.likelihood(m.T @ pairs @ m))
        assert values[got[w]] > max(values) - 1e-6, w


def test_unseen_words_cost_more(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "a b b", "c a d", "d b a", "e"])], "doc_id long, text string")
    tests = spark.createDataFrame([(100 + i, f"a {w}") for i, w in enumerate(["a", "b", "c", "d", "e", "zz"])], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in brown.score(docs.union(tests), F.col("doc_id") < 100).collect()}
    assert all(s < 0 for s in got.values()) and got[105] < min(got[100 + i] for i in range(5))


def test_fluent_texts_score_above_gibberish(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    known = [word() for _ in range(300)]
    text = lambda: " ".join(rng.choice(known[: rng.choice((5, 50, 300))]) for _ in range(40))
    rows = [(i, text()) for i in range(200)] + [(1000 + i, text()) for i in range(20)] + [(2000 + i, " ".join(word() for _ in range(40))) for i in range(20)]
    got = {r["doc_id"]: r["score"] for r in brown.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000, classes=4).collect()}
    assert min(got[1000 + i] for i in range(20)) > max(got[2000 + i] for i in range(20))


def test_probabilities_sum_to_one():
    """Over the known words, the end and every other word, after each class."""
    rng = np.random.default_rng(2)
    n = rng.integers(1, 9, 30)
    of, discount, ends = rng.integers(0, 3, 30), 0.6, 7
    count, kinds = np.bincount(of, weights=n, minlength=3), np.bincount(of, minlength=3)
    seen = rng.integers(0, 20, (5, 4))
    p = 10 ** brown.transitions(seen, count, kinds, ends, discount, 5.0)
    emit = (n - discount) / count[of]
    for row in p:
        assert abs((row[of] * emit).sum() + row[3] + row[4] - 1) < 1e-9
    share = rng.random(3)
    share /= share.sum()
    byte = np.full(256, -300.0)
    byte[[97, 98]] = np.log10(share[:2])
    spelling = brown.Spelling(byte, float(np.log10(share[2])))
    words = [bytes(w) for k in range(1, 13) for w in itertools.product(b"ab", repeat=k)]
    logs = 10 ** spelling.logs(words)
    rest = (share[0] + share[1]) ** 12  # of longer words
    assert abs(logs.sum() + rest - 1) < 1e-9


def test_rare_words_take_part_in_exchange(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(w for _ in range(12) for w in (f"a{rng.randrange(60)}", f"b{rng.randrange(60)}"))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda parts: {r["doc_id"]: (r["score"], r["n_tokens"]) for r in brown.score(docs.repartition(parts), F.col("doc_id") >= 0, classes=2, head=2).collect()}
    got, other = run(1), run(5)
    assert all(abs(got[i][0] - other[i][0]) < 1e-6 for i in got)  # however chunks are cut
    mean = sum(s for s, _ in got.values()) / sum(n for _, n in got.values())
    assert mean > -1.8  # 60 words may follow a word, log10 of 1 / 60 is -1.78


# 4


def test_ordinal(spark, none):
    rng = random.Random(5)
    good = ["river", "stone", "light", "quiet", "garden", "winter", "paper", "window"]
    text = lambda bad: " ".join(rng.choice(good) for _ in range(40)) + (" vileword1" if bad == 1 else " ##x ##y ##z" * 6 if bad == 0 else "")
    rows = [(i, i % 3, text(i % 3)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "", "", 0, "", "") for i, _, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, g, _ in rows if i < 450], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ordinal.digest(docs, labels).collect()}
    held = [(g, got[i]) for i, g, _ in rows if i >= 450]
    assert sum(r["kept"] == (g == 2) for g, r in held) / len(held) > 0.95
    means = [np.mean([r["expected_grade"] for g, r in held if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2] and all(0 <= r["p_best"] <= 1 for _, r in held)
    out = ordinal.score(spark.createDataFrame(corpus(), SCHEMA), ordinal.learn(none, ordinal.grades_of_labels(labels)))
    assert out.count() == len(corpus()) and not out.where("text is null and kept").count()
    assert ordinal.digest(none, labels.limit(0)).count() == 0


def test_ordinal_likelihood_against_plain_ascent():
    """The learned likelihood comes near what ascent along finite differences reaches."""
    rng = np.random.default_rng(7)
    x = (rng.random((150, 5)) < 0.5).astype(float)
    z = x @ np.array([2.0, -1.5, 1.0, 0.0, -0.5]) + rng.logistic(size=150)
    y = (z > -0.5).astype(int) + (z > 1.0)

    def likelihood(p):
        cuts = np.array([p[5], p[5] + math.exp(p[6])])
        tail = np.column_stack((np.ones(150), 1 / (1 + np.exp(-(x @ p[:5])[:, None] + cuts)), np.zeros(150)))
        return np.log(np.maximum(tail[np.arange(150), y] - tail[np.arange(150), y + 1], 1e-9)).mean()

    p = np.zeros(7)
    for _ in range(1500):
        p += 0.5 * np.array([(likelihood(p + h) - likelihood(p - h)) / 2e-5 for h in np.eye(7) * 1e-5])
    rows = [(np.flatnonzero(r), np.ones(int(r.sum())), [0.0] * ordinal.SHAPES) for r in x]
    model = ordinal.fit(rows, y, np.ones(150), 3, rounds=150, rate=0.1)
    assert model.thresholds[0] < model.thresholds[1]
    mine = likelihood(np.array([*model.weights[:5], model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])]))
    assert mine > likelihood(p) - 0.02


# 5


def base_counts(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_line_rules(spark, none):
    prose = "The river runs past the old stone house and nobody stays there in winter any more, so they say."
    texts = [r[1] for r in corpus()] + [
        f"{prose}\n{prose}\n{prose}",
        f"{prose}\nIt was late when the two of us came back over the bridge, and by then the lamps were out.\nHome | About | Contact | Help\nAll rights reserved.",
        "\n".join("menu | entry | link | more | next" for _ in range(9)),
        "word*** other### third$$$ " * 12,
        "a b c d e f g h " * 3 + "x y z",
        "\x0b\x0c    x",
    ]
    df = spark.createDataFrame([(i, t, "", "", 0, "q", "s") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in line_rules.digest(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_counts(t), t
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    n = len(corpus())
    assert got[n + 1]["kept"] and got[n + 1]["n_failed_lines"] == 2 and not got[n + 2]["kept"] and not got[n + 3]["kept"]
    full = line_rules.clean(df.where(F.col("doc_id") == n + 1)).first()
    assert full["score"] == "s" and "Home |" not in full["quality"]["cleaned_text"] and full["quality"]["cleaned_text"].startswith("The river")
    assert line_rules.digest(none).count() == 0


# 6


@pytest.fixture(scope="module")
def codec():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return bpe.Codec(f.read())


def test_bpe_equals_the_library(codec):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(vocabulary_path())
    rng = random.Random(2)
    alphabet = [*"abcdeéÉstSTΣσİı'’.,!#&0123½ \n\t\x1c\x85 　ñ漢字ﬁ한😀<|>", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "the ", "tion", "aaaa", "é", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, "ab" * 1500, "", "\n"]
    for t in texts:
        ids = other.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == other.decode(ids, skip_special_tokens=False)
        assert codec.digest(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest())


def test_long_texts_are_cut_at_spaces(codec):
    t = "word " * 5000 + "x" * 700 + " end"
    assert [c for part in codec.chunks(t, 100) for c in part] == t.split()


def test_bpe_words_are_decoded_once(codec, monkeypatch):
    """Chunks that share a word share what it decodes to; words with marks behind them are the library's."""
    tokenizers = pytest.importorskip("tokenizers")

    words = [f"word{'abcdefghij'[i]}" for i in range(10)] + ["été", "ǆs", "İz", "ß", "Σίσυφος"]
    text = " ".join(w + mark for w in words for mark in ("", ".", ",", "?!", "...", "!a", "'s", "<"))
    calls = []
    monkeypatch.setattr(codec, "decode", lambda ids, f=codec.decode: calls.append(ids) or f(ids))
    codec.forget()
    got = codec.digest(text)
    assert len(calls) < 40
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert got == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


IDLE = """
import random, re, sys
import pandas, pyarrow
from larkspur.llm import bpe, jaccard
from larkspur.llm.registry import vocabulary_path

def mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Private_Dirty: +([0-9]+)", f.read())[1]) / 1024

rng = random.Random(1)
texts = lambda n: [" ".join("".join(rng.choices("abcdeimnorstu", k=rng.randint(3, 14))) for _ in range(n)) for _ in range(400)]
with open(vocabulary_path(), encoding="utf-8") as f:
    codec = bpe.Codec(f.read())
started = mb()
for t in texts(300):
    codec.digest(t)
codec.forget()
after_tokens = mb() - started
started = mb()
make = lambda frames: (pandas.DataFrame({"s": [s for s, _, _ in jaccard.hashed_sets(list(f["text"]), 5)]}) for f in frames)
for _ in jaccard._lean(make)(pandas.DataFrame({"text": texts(2000)}) for _ in range(2)):
    pass
print(after_tokens, mb() - started)
"""


def test_idle_workers_keep_little_memory():
    """What a task has freed goes back to the system: executors count it as long as the worker lives."""
    run = subprocess.run([sys.executable, "-c", IDLE], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), check=True)
    tokens, sets = map(float, run.stdout.split())
    assert tokens < 25
    assert sets < 25


def test_bpe_round_trip(spark, docs, none):
    rows = bpe.encode(docs, vocabulary_path())
    back = {r["doc_id"]: r["text"] for r in bpe.decode(rows, vocabulary_path()).collect()}
    for r in docs.collect():
        assert "".join(back[r["doc_id"]].replace("</w>", "").split()) == "".join((r["text"] or "").lower().split()).encode().decode("latin-1").translate({i: c for i, c in enumerate(bpe.byte_alphabet())})
    got = bpe.digests(docs, vocabulary_path())
    assert got.count() == docs.count() and got.where("doc_id is null").count() == 0
    assert bpe.digests(none, vocabulary_path()).count() == 0


# 7


def test_language(spark, none):
    rng = random.Random(4)
    parts = {"en": "th ing er and of wh", "de": "sch ung ich ein keit ü", "fr": "eau tion ré que è oi", "es": "ción ado rr ll ñ que"}
    say = lambda lang: " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 40)))
    rows = [(i, say(lang), lang, "", 0, "", "") for i, lang in enumerate(itertools.islice(itertools.cycle(parts), 400))]
    extra = [(1000, None, "en", "", 0, "", ""), (1001, "123 !!", "en", "", 0, "", ""), (None, rows[0][1], None, "", 0, "", ""), (1002, rows[0][1] + " x" * 600_000, None, "", 0, "", "")]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    got = langid.digest(df).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 for r in got)
    right = [r["lang_pred"] == rows[r["doc_id"]][2] for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(right) / len(right) > 0.97
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001)} == {1000: "und", 1001: "und"}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert [r["lang_pred"] for r in langid.identify(df.limit(3), langid.learn(none)).collect()] == ["und"] * 3
    one = langid.learn(df.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in langid.identify(df.where("doc_id < 9"), one).collect()} == {"fr"}


# 8


def test_parts_of_a_text_give_what_the_whole_gives(monkeypatch):
    rng = random.Random(1)
    count = lambda t: sum((np.bincount(c, minlength=langid.DIMS) for c in langid.gram_codes(t)), np.zeros(langid.DIMS, dtype=int))
    texts = ["".join(rng.choice("ab é. 1ß\n") for _ in range(rng.randint(0, 40))) for _ in range(100)]
    whole = [count(t) for t in texts]
    assert sum(count("ab c")) == 9  # five pairs and four triples of " ab c "
    for part in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "PART", part)
        assert all((count(t) == w).all() for t, w in zip(texts, whole, strict=True))


def test_language_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_urls(spark):
    rows = [
        (1, "https://a.example.net/en/1", "<link rel='canonical' href='/fr/9'>"), (2, "http://b.foo/x#t", '<head><LINK href="http://a.example.net/fr/9?z" rel=canonical></head>'),
        (3, "http://q.org/fr/1", '<meta http-equiv="refresh" content="0; url=http://b.foo/x">'), (4, "http://q.org/de/1", '<meta http-equiv="refresh" content="0; url=http://b.foo/x">'),
        (5, None, None), (6, "zzz", None), (7, "http://NET/", "x"), (8, "http://net?x/", "x"), (9, "http://u.com", None), (9, "http://u.com", None), (10, "http://badnet/", ""),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("b.foo", "/x", None, "block"), 3: ("q.org", "/fr/1", "org/fr/", "allow"), 4: ("q.org", "/de/1", None, "block"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("net", "/", "net/", "block"), 8: ("net", "", None, "allow"), 9: ("u.com", "", None, "allow"), 10: ("badnet", "/", None, "allow"),
    }
    assert url_filter.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

def test_urls_resolve_as_the_standard_says(spark):
    """Planted redirects against urljoin and union-find, by the operator and by its SQL."""
    rng = random.Random(9)
    hosts = ["net", "a.example.net", "q.org", "b.foo", "h.org", "bad.net", "shop.example.com", "c.foo", "d.foo", "e.foo", "f.foo"]
    paths = ["", "/", "/x", "/p/q", "/de/1", "/fr/1", "/en/2", "/p/r?u=http://bad.net/x", "/go?u=http://bad.net/x"]
    links = ["../fr9", "./x", "..", ".", "?a=1", "/a/../x", "/x", "x", "../../de/1", "#part", "mailto:a@b.net", "/go?u=http://bad.net/x", "//c.foo/x", "HTTP://D.foo", "http://e.foo/?b=1&amp;c=2", "", " /x ", "/a/./b//../c"]
    links += [f"http://{h}{p}" for h in hosts for p in paths]
    forms = ['<link rel="canonical" href="{}">', "<LINK rel='alternate canonical' href='{}'/>", '<link href="{}" title="a > b" rel=canonical>', '<meta http-equiv="refresh" content="0; url={}">', "<meta content='3;URL={}' http-equiv=Refresh>", '<!-- <link rel="canonical" href="{}"> -->', '<link rel="canonicals" href="{}">']
    rows, edges = [], []
    plain = lambda url: (lambda u: u.netloc.lower() + (u.path or "/") + (f"?{u.query}" if u.query else ""))(urllib.parse.urlsplit(urllib.parse.urljoin(url, urllib.parse.urlsplit(url).path or "/") + ("?" + urllib.parse.urlsplit(url).query if urllib.parse.urlsplit(url).query else "")))
    for i in range(400):
        url = f"http://{rng.choice(hosts)}{rng.choice(paths)}"
        said = [(rng.choice(forms), rng.choice(links)) for _ in range(rng.choice((0, 0, 1, 1, 2)))]
        rows.append((i, url, "<p>refresh canonical</p>" + "x".join(f.format(x) for f, x in said)))
        for f, x in said:
            x = x.strip().split("#")[0].replace("&amp;", "&")
            if x and "<!--" not in f and "canonicals" not in f and not x.startswith("mailto"):
                edges.append((plain(url), plain(urllib.parse.urljoin(url, x))))
    rows += [(1000, None, '<link rel="canonical" href="http://bad.net/">'), (1001, "zz", '<link rel="canonical" href="http://bad.net/">'), (1002, "http://k.foo/", None), (1003, "http://l.foo", '<link rel="canonical" href="http&#58;//bad&#x2e;net/1">' + " " * 300_000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)

    def own(node):
        host, _, path = node.partition("/")
        path = "/" + path.split("?")[0]
        for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
            name, _, start = rule.partition("/")
            if (host == name or host.endswith(f".{name}")) and path.startswith(f"/{start}"):
                return verdict

    bad = {find(x) for x in list(root) if own(x) == "block"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_pages(pages).collect()}
    for i, url, _ in rows[:400]:
        host, path = urllib.parse.urlsplit(url).netloc, urllib.parse.urlsplit(url).path
        first = own(host + path) if path else None
        assert got[i] == (first or ("block" if find(plain(url)) in bad else "allow")), (i, url, rows[i])
    assert [got[i] for i in range(1000, 1004)] == ["allow", "allow", "allow", "block"]
    con = duckdb.connect()
    con.register("pages", pages.where("page_id < 1003").toPandas())
    assert {r[0]: r[4] for r in con.execute(ORACLE_SQL["op8_url_filter"]).fetchall()} == {i: v for i, v in got.items() if i < 1003}


def test_written_tables_leave_the_settings_as_they_were(spark):
    names = (storage.CLEANUP, storage.PARALLEL_FIRST)
    before = [spark.conf.get(n) for n in names]
    df, path = storage.kept(spark.range(100).repartition(3, "id"), "numbers", narrow=True)
    assert df.count() == 100 and [spark.conf.get(n) for n in names] == before
    storage.remove(spark, path)
    with pytest.raises(Exception):
        df.count()


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200, i) for i in range(201, 260)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 1)]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] is not None for n in e}


# 9


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; more</h1><p><b>One\n two.<br><p>Ti.</p></article><footer>&copy; us</footer>", "Head & more\n\nOne two.\n\nTi."),
        ("<article>x<script>var a='</p>';</script> y<!-- no --><aside>side</aside><div class='ad'>buy</div><p>z</p></article>", "x y\n\nz"),
        ("<main><p>keep</p><div id=comments><p>said</p></div><form><p>mail</p></form></main>", "keep"),
        ("<article><p>a &lt;b&gt; &#233;&nbsp;c</p>", "a <b> é c"),
        ("<article><p hidden>no</p><p>yes</p><p class=cookie-notice>no</p><p>also</p></article>", "yes\n\nalso"),
        (None, ""), ("", ""), ("<", ""), ("<script>x", ""),
    ],
)
def test_pages(html, text):
    assert html_extract.main_text(html) == text


def test_pages_without_containers():
    good = "This is the text of the page and it has a lot of the words that are in every text. " * 4
    page = f"<div class=menu><a href=1>Home</a></div><h2>A title</h2><div>{good}</div><div>Short.</div><div>{good}</div><ul><li><a href=2>Next page of the list</a></ul>"
    assert html_extract.main_text(page).split("\n\n") == ["A title", good.strip(), "Short.", good.strip()]


def test_containers_are_evidence_only():
    good = "This is the text of the page and it has a lot of the words that are in every text. " * 4
    advert = "Buy phones today! Best price deals, free shipping, order online, huge discounts, limited stock."
    text = lambda html: html_extract.main_text(html).split("\n\n")
    two = f"<p>{good}</p><p>{good}</p>"
    assert text(f"<article>{two}<div>{advert}</div>{two}</article>") == [good.strip()] * 4
    card = "<article><h3><a href=1>Another page of this site</a></h3><p>It is the first of the lines that stand on the other page of this site.</p></article>"
    assert text(f"<article>{two}</article>{card}{card}{card}") == [good.strip()] * 2
    for before, after in (("<form>", "</form>"), ("<div class=overflow-hidden>", "</div>"), ("<div class='page has-sidebar'>", "</div>"), ("<div class=widget>", "</div>")):
        assert text(f"<nav><a href=1>Home</a></nav>{before}<article>{two}</article>{after}<footer>us</footer>") == [good.strip()] * 2
        assert text(f"<nav><a href=1>Home</a></nav>{before}{two}{after}<footer>us</footer>") == [good.strip()] * 2
    assert text(f"<article>{two}</article><div id=comments><p>{good}</p></div><p hidden>{good}</p>") == [good.strip()] * 2


def test_both_passes_decide():
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).to_pylist()
    by_first, by_second = Counter(), Counter()
    for r in rows:
        blocks = html_extract.blocks_of(r["html"] or "")
        first = html_extract.first_labels(blocks)
        for x, y in zip(html_extract.standing(blocks, first), html_extract.labels_of(blocks), strict=True):
            (by_first if x in ("good", "bad", "out") else by_second)[y] += 1
    assert by_first[True] and by_first[False] and by_second[True]


def test_second_pass_against_brute_force():
    rng = random.Random(6)
    sentence = "It is the text of a page and it has what is in the texts. "
    kinds = [sentence * 6, sentence * 2, "Short one.", "Buy phones today! Best price deals, free shipping, order online, huge discounts, limited stock."]
    for _ in range(300):
        page = "".join(f"<{t}>{rng.choice(kinds)}</{t}>" if rng.random() < 0.8 else "<p><a href=1>A link to other pages</a></p>" for t in rng.choices(["p", "h2", "div"], k=rng.randint(1, 12)))
        blocks = html_extract.blocks_of(page)
        first = html_extract.standing(blocks, html_extract.first_labels(blocks))
        want = []
        for i, x in enumerate(first):
            sides = []  # label and distance of the nearest decided block on each side; the page's edges are bad
            for step in (-1, 1):
                at = next((k for k in range(i + step, -1 if step < 0 else len(first), step) if first[k] in ("good", "bad")), None)
                sides.append(("bad", len(first)) if at is None else (first[at], abs(at - i)))
            (a, da), (b, db) = sides
            if x in ("good", "bad", "out"):
                want.append(x == "good")
            elif a == b:
                want.append(a == "good")
            elif x == "near" or (blocks[i].tag.startswith("h") and b == "good"):
                want.append(True)
            else:
                want.append(da != db and (a if da < db else b) == "good")
        assert html_extract.labels_of(blocks) == want, page


def test_pages_in_a_language_without_listed_stop_words():
    good = "Tämä sivu kertoo pitkästä matkasta pohjoiseen jossa lunta riittää vielä toukokuussa asti kaikille hiihtäjille. " * 3
    page = f"<div><a href=1>Etusivu</a> <a href=2>Uutiset</a></div><h1>Matka</h1><div>{good}</div><p>Loppu.</p><div>{good}</div><p><a href=3>Seuraava sivu tästä</a></p>"
    assert html_extract.main_text(page).split("\n\n") == ["Matka", good.strip(), "Loppu.", good.strip()]


@pytest.mark.parametrize("size", [0, 1_990, 2_010, 300_000])
def test_attributes_of_any_length(size):
    good = "This is the text of the page and it has a lot of the words that are in every text. " * 4
    for quote in "\"'":
        page = f"<article><p data-x={quote}{'a > b <i> ' * (size // 10)}{quote}>{good}</p></article>"
        assert html_extract.main_text(page) == good.strip()


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article>é</article>", "t")] * 2 + [(2, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_extract.extract(df).collect())) == [(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


# 10


def classes(rows, width=4, percent=85):
    sets = {}
    for i, t, *_ in rows:
        w = [x.encode().lower() for x in words_of(t)]
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(spark, docs, none):
    rng = random.Random(8)
    rows = [r[:2] for r in corpus()]
    first = [f"w{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))
    for k in range(60):  # a chain of near copies, and texts that share a long passage only
        w = list(first)
        for j in range(k % 30):
            w[(j * 37) % 120] = f"x{j}"
        rows.append((1000 + k, " ".join(w)))
        rows.append((2000 + k, passage + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(df, width, percent).collect()}
        assert got == classes(rows, width, percent)
    kept = {r["doc_id"] for r in jaccard.deduplicate(docs).collect()}
    assert kept == {i for i, (_, c) in classes(corpus()).items() if c == i}
    assert jaccard.components(none).count() == 0


def test_jaccard_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (None, "a b c d e"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.components(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3)], key=str)
    assert sorted(jaccard.deduplicate(df).collect(), key=str) == sorted([(1, "a b c d e"), (None, "a b c d e"), (3, None)], key=str)


def test_jaccard_rows_that_repeat_an_id_with_another_text(spark):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    near = x.replace("x39", "z")
    df = spark.createDataFrame([(1, x, 7.5, 1), (1, y, 1.5, 2), (2, x, 2.5, 3), (1, near, 3.5, 4), (5, None, 4.5, 5), (5, None, 4.5, 5)], "doc_id long, text string, h double, `a.b` int")
    got = sorted(map(tuple, jaccard.components(df).collect()))
    assert got == [(1, 37, 1), (1, 37, 1), (1, 37, 1), (2, 37, 1), (5, 0, 5), (5, 0, 5)]
    kept = sorted(map(tuple, jaccard.deduplicate(df).collect()), key=str)
    assert len(kept) == 3 and (1, y, 1.5, 2) in kept and (5, None, 4.5, 5) in kept and sum(r[1] in (x, near) for r in kept) == 1


def test_jaccard_with_many_texts_that_share_most_and_link_little(spark):
    """Every text differs from the shared one in a fifth; each has a partner that it links with."""
    rng, rows = random.Random(5), []
    base = [f"b{i}" for i in range(100)]
    for k in range(150):
        w = list(base)
        for j in rng.sample(range(100), 4):
            w[j] = f"n{k}x{j}"
        rows.append((k, " ".join(w)))
        if k % 2:
            w[rng.randrange(100)] = f"m{k}"
        rows.append((1000 + k, " ".join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(df).collect()}
    assert got == classes(rows)
