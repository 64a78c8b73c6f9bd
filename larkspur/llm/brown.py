"""Language-model scoring with Brown classes.

Exchange clustering over all words. It starts from the ``head`` most frequent words, which are exchanged one by one
on exact pair counts; every other word joins the class that its neighbours in the head make most likely. Then rounds
of exchange move words of any frequency, each against the table of class pairs, by the word's own counts with the
classes before and after it in the whole corpus. A round that lowers the likelihood is undone and repeated with
half of the words. P(word | word before) = P(class | class before) P(word | class); transitions are smoothed by the
classes' shares, emissions give up ``discount`` counts a word to the unseen. A spelling model, bytes by their shares
in training words and an end, shares this mass out to all words that training texts lack, so that probabilities of
the next token sum to one over the known words, the end and every other word.

The corpus is read once and kept as chunks: a chunk has its own short word list, and its documents as numbers
in it. Words are dealt by hash into buckets, which add up what the chunks counted; chunks and buckets exchange packed
arrays. Only the pair counts of the head (``head`` squared at most) and class tables reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import kept, remove

CHUNK = 8_000_000
BUCKET = 200_000  # words that the chunks list, in a bucket


def _pack(x: np.ndarray, kind=np.int32) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x, dtype=kind).tobytes(), 3)


def _unpack(b: bytes, kind=np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype=kind)


def _pack_rising(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=0))


def _unpack_rising(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=np.int64)


def _chunk(number: int, ids: list, train: list, texts: list) -> dict:
    lists = [t.encode("utf-8", "replace").lower().split() for t in texts]
    place: dict[bytes, int] = {}
    tokens = np.fromiter((place.setdefault(w, len(place)) for ws in lists for w in ws), dtype=np.int32, count=sum(map(len, lists)))
    lens = np.array([len(x) for x in lists], dtype=np.int32)
    n = np.bincount(tokens[np.repeat(np.array(train, dtype=bool), lens)], minlength=len(place))
    order = np.argsort(np.fromiter(map(zlib.crc32, place), dtype=np.uint32, count=len(place)), kind="stable")
    spell = np.bincount(np.frombuffer(b"".join(place), np.uint8), weights=np.repeat(n, list(map(len, place))), minlength=256)
    spell = np.append(spell, n.sum()).astype(np.int64)
    return {"chunk": number, "spell": spell, "size": len(place), "order": _pack(order), "words": zstandard.compress(b" ".join(place), 3), "n": _pack(n), "tokens": _pack(tokens), "lens": _pack(lens), "ids": ids, "train": train}


def chunks_of(docs: DataFrame, id_col: str, train) -> DataFrame:
    """A row for each stretch of documents of about ``CHUNK`` characters in a partition."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), train.alias("train"), F.coalesce("text", F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = TaskContext.get().partitionId() << 24, ([], [], []), 0
        for f in frames:
            for row in zip(f["id"], f["train"], f["text"], strict=True):
                for kept, value in zip(held, row, strict=True):
                    kept.append(value)
                size += len(row[2])
                if size >= CHUNK or len(held[0]) >= 100_000:
                    yield pd.DataFrame([_chunk(number, *held)])
                    number, held, size = number + 1, ([], [], []), 0
        if held[0]:
            yield pd.DataFrame([_chunk(number, *held)])

    return rows.mapInPandas(run, "chunk long, spell array<long>, size long, order binary, words binary, n binary, tokens binary, lens binary, ids array<string>, train array<boolean>")


@dataclass
class Spelling:
    """Log10 shares of bytes, and of a word's end, in training words."""

    byte: np.ndarray
    end: float

    def logs(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of each word among all words that aren't empty."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not len(lens):
            return np.zeros(0)
        each = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        return np.add.reduceat(each, np.cumsum(lens) - lens) + self.end - np.log10(1 - 10**self.end)


def spelling_of(chunks: DataFrame) -> Spelling:
    """Learned from all training words, as often as they stand: 257 numbers, each half a count up."""
    n = np.full(257, 0.5)
    n[[9, 10, 11, 12, 13, 32]] = 0
    for r in chunks.select(F.posexplode("spell")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        n[r["pos"]] += r["n"]
    logs = np.log10(np.maximum(n / n.sum(), 1e-300))
    return Spelling(logs[:256], float(logs[256]))


def _words(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split(b" ") if len(blob) > 9 or zstandard.decompress(blob) else []


def _map(df: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work`` on each row as a dict; it yields Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from work(row)

    return df.select(columns).mapInArrow(run, schema)


def number_words(chunks: DataFrame, buckets: int, head: int, spelling: Spelling) -> DataFrame:
    """Words by bucket: for each chunk the numbers and total training counts of its words there, in the chunk's ``order``.

    A row with chunk -1 is the bucket's own: counts and a byte of the hash for each of its words, its ``head`` most
    frequent ones, and the probability that spelling gives to its training words. Numbers follow the hash.
    """
    sent = chunks.sparkSession.sparkContext.broadcast(spelling)

    def work(row: dict) -> Iterator[pa.RecordBatch]:
        words, n, order = _words(row["words"]), _unpack(row["n"]), _unpack(row["order"])
        of = np.fromiter((zlib.crc32(words[i]) * buckets >> 32 for i in order), dtype=np.int64, count=len(order))
        at = np.searchsorted(of, np.arange(buckets + 1))
        full = [(b, order[at[b] : at[b + 1]]) for b in range(buckets) if at[b] < at[b + 1]]
        yield pa.record_batch(
            [pa.array([b for b, _ in full], pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), pa.array([zstandard.compress(b" ".join([words[i] for i in o]), 3) for _, o in full], pa.binary()), pa.array([_pack(n[o]) for _, o in full], pa.binary())],
            ["bucket", "chunk", "words", "n"],
        )

    def add_up(f: pd.DataFrame) -> pd.DataFrame:
        place: dict[bytes, int] = {}
        first = [np.fromiter((place.setdefault(w, len(place)) for w in _words(b)), dtype=np.int64) for b in f["words"]]
        words = list(place)
        hashes = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        total = np.zeros(len(words), dtype=np.int64)
        for ids, n in zip(first, f["n"], strict=True):
            total[rank[ids]] += _unpack(n)
        often = np.flatnonzero(total >= (np.partition(total, -head)[-head] if len(total) > head else 1))
        top = sorted(((-int(total[i]), words[order[i]]) for i in often if total[i]))[:head]
        spelt = float((10 ** sent.value.logs([words[order[i]] for i in np.flatnonzero(total)])).sum())
        out = [(f["bucket"].iloc[0], -1, _pack(np.zeros(0)), _pack(total, np.int64), _pack(hashes[order] & 255, np.uint8), [{"word": w, "n": -n} for n, w in top], spelt)]
        out += [(f["bucket"].iloc[0], c, _pack_rising(rank[ids]), _pack(total[rank[ids]], np.int64), b"", [], 0.0) for c, ids in zip(f["chunk"], first, strict=True)]
        return pd.DataFrame(out, columns=["bucket", "chunk", "ids", "n", "draw", "top", "spelt"])

    listed = _map(chunks, ["chunk", "words", "n", "order"], work, "bucket int, chunk long, words binary, n binary")
    return listed.groupBy("bucket").applyInPandas(add_up, "bucket int, chunk long, ids binary, n binary, draw binary, top array<struct<word: binary, n: long>>, spelt double")


def bucket_sums(numbers: DataFrame, values: DataFrame | None, work, schema: str):
    """``work`` on the buckets' own rows, with the classes of ``values`` beside them where given."""
    own = numbers.where("chunk = -1")
    return _map(own if values is None else own.join(values.where("chunk = -1").select("bucket", "of"), "bucket"), ["n"] + ["of"] * (values is not None), work, schema)


def _stream(tokens: np.ndarray, lens: np.ndarray, train: list[bool], end: int) -> np.ndarray:
    """Tokens of the training documents, ``end`` before the first and after each."""
    use = np.array(train, dtype=bool)
    kept = tokens[np.repeat(use, lens)]
    return np.concatenate(([end], np.insert(kept, np.cumsum(lens[use]), end))).astype(np.int64)


def pair_counts(chunks: DataFrame, head: dict[bytes, int]) -> np.ndarray:
    """How often head words (and the end, the last number) follow each other in training texts."""
    size = len(head) + 1
    sent = chunks.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for row in b.to_pylist():
                of = np.array([sent.value.get(w, -1) for w in _words(row["words"])] + [size - 1], dtype=np.int64)
                s = of[_stream(_unpack(row["tokens"]), _unpack(row["lens"]), row["train"], -1)]
                code = (s[:-1] * size + s[1:])[(s[:-1] >= 0) & (s[1:] >= 0)]
                new, n = np.unique(code, return_counts=True)
                codes, of = np.unique(np.concatenate((codes, new)), return_inverse=True)
                counts = np.bincount(of, weights=np.concatenate((counts, n)), minlength=len(codes)).astype(np.int64)
        yield pa.record_batch([pa.array(codes), pa.array(counts)], ["code", "n"])

    found = chunks.select("words", "tokens", "lens", "train").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(size * size, dtype=np.float32)
    for b in found.select(F.col("code").cast("int"), F.col("n").cast("float")).toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Classes of all words but the last (the end, which has a class of its own, the number ``classes``).

    Starts by frequency; each word in turn moves to the class for which the likelihood of the pairs under the
    class bigram is largest, until no word moves.
    """
    size = len(pairs)
    of = np.append(np.arange(size - 1) % classes, classes)
    k = classes + 1
    member = np.zeros((size, k))
    member[np.arange(size), of] = 1
    table = member.T @ (pairs @ member)
    out_n, in_n = pairs.sum(axis=1, dtype=np.float64), pairs.sum(axis=0, dtype=np.float64)
    out_c, in_c = member.T @ out_n, member.T @ in_n
    transposed = np.ascontiguousarray(pairs.T)
    diagonal = np.arange(k)
    for _ in range(sweeps):
        moved = 0
        for w in range(size - 1):
            if out_n[w] == in_n[w] == 0:
                continue
            old, self_ = of[w], float(pairs[w, w])
            right = np.bincount(of, weights=pairs[w], minlength=k)
            left = np.bincount(of, weights=transposed[w], minlength=k)
            right[old] -= self_
            left[old] -= self_
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= self_
            out_c[old] -= out_n[w]
            in_c[old] -= in_n[w]
            plain = _xlogx(table)
            to_row, to_column = _xlogx(table + right[None, :]) - plain, _xlogx(table + left[:, None]) - plain
            corner = table[diagonal, diagonal]
            gain = to_row.sum(axis=1) - to_row[diagonal, diagonal] + to_column.sum(axis=0) - to_column[diagonal, diagonal]
            gain += _xlogx(corner + right + left + self_) - _xlogx(corner)
            gain -= _xlogx(out_c + out_n[w]) - _xlogx(out_c) + _xlogx(in_c + in_n[w]) - _xlogx(in_c)
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += right
            table[:, new] += left
            table[new, new] += self_
            out_c[new] += out_n[w]
            in_c[new] += in_n[w]
            of[w] = new
            moved += new != old
        if moved <= size // 500:
            break
    return of


@dataclass
class Classes:
    """Classes of the head words; log transition shares among classes (the end's is the last)."""

    head: dict[bytes, int]
    follow: np.ndarray
    share: np.ndarray
    classes: int


STATE = "bucket int, chunk long, ids binary, of binary, draw binary"
VOTES = "bucket int, chunk long, ids binary, of binary, draw binary, codes binary, times binary, pairs array<long>"


def neighbour_counts(chunks: DataFrame, state: DataFrame, classes: int, first: Classes | None = None) -> DataFrame:
    """What each chunk counts of its words' neighbours: by word and class before, class after, and the word itself.

    Beside them, with bucket -1, pairs of classes. ``first`` has the classes before any round, where words outside
    the head have none (one more class); afterwards ``state`` has them.
    """
    k, sent = classes + 2, chunks.sparkSession.sparkContext.broadcast(first)
    wide = 2 * k + 1

    def count(f: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        out = []
        slices = slices.sort_values("bucket")
        for row in f.itertuples():
            order, lens = _unpack(row.order), _unpack(row.lens)
            size = len(order)
            of = np.full(size + 1, k - 1, dtype=np.int64)
            of[size] = classes
            if sent.value is not None:
                for i, w in enumerate(_words(row.words)):
                    of[i] = sent.value.head.get(w, k - 1)
            elif size:
                of[order] = np.concatenate([_unpack(b, np.int8) for b in slices["of"]])
            rank = np.empty(size + 1, dtype=np.int64)
            rank[order], rank[size] = np.arange(size), size
            s = _stream(_unpack(row.tokens), lens, row.train, size)
            a, b = s[:-1], s[1:]
            out.append((-1, row.chunk, b"", b"", b"", b"", b"", np.bincount(of[a] * k + of[b], minlength=k * k)))
            same = a == b
            after = rank[a] * wide + np.where(same, 2 * k, k + of[b])
            before = (rank[b] * wide + of[a])[~same]
            n = np.bincount(np.concatenate((after, before)), minlength=(size + 1) * wide)[: size * wide]
            codes = np.flatnonzero(n)
            times, at, start = n[codes], codes // wide, 0
            del n, after, before
            for bucket, packed in zip(slices["bucket"], slices["ids"], strict=True):
                ids = _unpack_rising(packed)
                lo, hi = np.searchsorted(at, (start, start + len(ids)))
                mine = ids[at[lo:hi] - start] * wide + codes[lo:hi] % wide
                out.append((bucket, row.chunk, packed, _pack(of[order[start : start + len(ids)]], np.int8), b"", _pack_rising(mine), _pack(times[lo:hi]), None))
                start += len(ids)
        return pd.DataFrame(out, columns=[c.split()[0] for c in VOTES.split(", ")])

    columns = ["chunk", "order", "tokens", "lens", "train"] + ["words"] * (first is not None)
    by_chunk = chunks.select(columns).groupBy("chunk").cogroup(state.where("chunk >= 0").select("bucket", "chunk", "ids", *(["of"] if first is None else [])).groupBy("chunk"))
    own = state.where("chunk = -1").select("bucket", "chunk", "ids", "of" if first is None else F.lit(b"").alias("of"), "draw")
    own = own.select("*", F.lit(b"").alias("codes"), F.lit(b"").alias("times"), F.lit(None).cast("array<long>").alias("pairs"))
    return by_chunk.applyInPandas(count, VOTES).unionByName(own)


def class_pairs(votes: DataFrame, classes: int) -> np.ndarray:
    """The table of class pairs (words by class, the end) of all chunks."""
    out = np.zeros((classes + 2) ** 2)
    for r in votes.where("bucket = -1").select(F.posexplode("pairs")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[r["pos"]] = r["n"]
    return out.reshape(classes + 2, classes + 2)


def likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def best_classes(before: np.ndarray, after: np.ndarray, same: np.ndarray, of: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """For each word the class to which it would move alone: the exchange step of ``exchange`` for many words at once.

    Only the cells that a word's own counts touch are looked at: most words have few neighbours.
    """
    new = of.copy()
    k, table = len(table), table.astype(float)
    plain, diagonal = _xlogx(table), np.diagonal(table)
    out_c, in_c = table.sum(axis=1), table.sum(axis=0)
    for at in range(0, len(of), 2048):
        left, right, self_, old = before[at : at + 2048].astype(float), after[at : at + 2048].astype(float), same[at : at + 2048].astype(float), of[at : at + 2048]
        i = np.arange(len(old))
        corner, x = np.repeat(diagonal[None], len(old), axis=0), left + right + self_[:, None]
        corner[i, old] -= x[i, old]
        gain = _xlogx(corner + x) - _xlogx(corner)
        for total, held in ((out_c, right.sum(axis=1) + self_), (in_c, left.sum(axis=1) + self_)):
            rest = np.repeat(total[None], len(old), axis=0)
            rest[i, old] -= held
            gain -= _xlogx(rest + held[:, None]) - _xlogx(rest)
        for counts, others, cells, logs in ((right, left, table, plain), (left, right, table.T, plain.T)):
            word, to = np.nonzero(counts)
            n, own, each = counts[word, to], old[word], np.arange(len(word))
            if not len(word):
                continue
            a, base = cells[:, to].T, logs[:, to].T  # by class: the cell that the word's n pairs with class ``to`` would join
            inside = to == own  # this column holds the word's other pairs still
            a[inside] -= others[word[inside]]
            base[inside] = _xlogx(a[inside])
            more = _xlogx(a + n[:, None]) - base
            more[each, own] = logs[own, to] - _xlogx(cells[own, to] - n)
            more[each, to] = 0  # the corner has it
            some, first = np.unique(word, return_index=True)
            gain[some] += np.add.reduceat(more, first, axis=0)
        best = gain[:, :classes].argmax(axis=1)
        new[at : at + 2048] = np.where(gain[i, best] > gain[i, old] + 1e-9, best, old)
    return new


def reclassed(votes: DataFrame, classes: int, table: np.ndarray, first: Classes | None = None, low: int = 0, high: int = 256) -> DataFrame:
    """New classes for the words of every bucket, and so for its chunks. Words whose hash byte is in [low, high) move."""
    k, sent = classes + 2, votes.sparkSession.sparkContext.broadcast((table, first))
    wide = 2 * k + 1

    def move(f: pd.DataFrame) -> pd.DataFrame:
        table, first = sent.value
        own, rest = f[f["chunk"] < 0].iloc[0], f[f["chunk"] >= 0]
        draw = _unpack(own["draw"], np.uint8)
        size = len(draw)
        n = np.zeros(size * wide, dtype=np.int64)
        old = np.full(size, k - 1, dtype=np.int64)
        for r in rest.itertuples():
            n[_unpack_rising(r.codes)] += _unpack(r.times)
            if first is not None:
                old[_unpack_rising(r.ids)] = _unpack(r.of, np.int8)
        n = n.reshape(size, wide)
        if first is not None:
            before, after = n[:, :k], n[:, k : 2 * k]
            score = before[:, : classes + 1] @ first.follow[:, :classes] + (before[:, k - 1] + n[:, 2 * k])[:, None] * first.share[:classes] + after[:, : classes + 1] @ first.follow.T[:, :classes]
            new = np.where(old == k - 1, score.argmax(axis=1), old)
        else:
            old = _unpack(own["of"], np.int8).astype(np.int64)
            new = old.copy()
            may = np.flatnonzero((draw >= low) & (draw < high) & (n.any(axis=1)))
            both = np.ascontiguousarray(np.concatenate((n[may], old[may, None]), axis=1).astype(np.int32))
            _, at, kind = np.unique(both.view(np.dtype((np.void, both.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
            x = both[at]
            new[may] = best_classes(x[:, : classes + 1], x[:, k : k + classes + 1], x[:, 2 * k], x[:, -1].astype(np.int64), table[: classes + 1, : classes + 1], classes)[kind]
        out = [(own["bucket"], -1, own["ids"], _pack(new, np.int8), own["draw"])]
        out += [(r.bucket, r.chunk, r.ids, _pack(new[_unpack_rising(r.ids)], np.int8), b"") for r in rest.itertuples()]
        return pd.DataFrame(out, columns=["bucket", "chunk", "ids", "of", "draw"])

    return votes.where("bucket >= 0").drop("pairs").groupBy("bucket").applyInPandas(move, STATE)


def exchange_all(chunks: DataFrame, numbers: DataFrame, first: Classes, rounds: int) -> tuple[DataFrame, str]:
    """Classes of all words, by bucket and chunk, and their path: exchange in rounds after the head's.

    A round moves the words in a range of hash bytes. Rounds go on after number ``rounds`` until every word had its turn.
    """
    classes = first.classes
    votes, votes_path = kept(neighbour_counts(chunks, numbers, classes, first), "votes")
    state, path = kept(reclassed(votes, classes, np.zeros((1, 1)), first), "classes")
    remove(chunks.sparkSession, votes_path)
    if not rounds:
        return state, path
    votes, votes_path = kept(neighbour_counts(chunks, state, classes), "votes")
    table, low, width, done = class_pairs(votes, classes), 0, 128, 0
    while done < rounds or low < 256:
        high = low % 256 + width
        new, new_path = kept(reclassed(votes, classes, table, None, low % 256, high), "classes")
        new_votes, new_votes_path = kept(neighbour_counts(chunks, new, classes), "votes")
        new_table = class_pairs(new_votes, classes)
        gain = likelihood(new_table) - likelihood(table)
        if gain >= 0:
            (path, new_path), (votes_path, new_votes_path) = (new_path, path), (new_votes_path, votes_path)
            state, votes, table = new, new_votes, new_table
        remove(chunks.sparkSession, new_path)
        remove(chunks.sparkSession, new_votes_path)
        done += 1
        if gain >= 0 or width == 1:
            low += width
        else:
            width //= 2
    remove(chunks.sparkSession, votes_path)
    return state, path


@dataclass
class Emission:
    """What scoring a document needs: counts of classes and their words, totals and the discount; ``known`` is the
    probability that spelling gives to all training words."""

    count: np.ndarray
    kinds: np.ndarray
    total: int
    distinct: int
    ends: int
    discount: float
    spelling: Spelling
    known: float


def document_sums(chunks: DataFrame, numbers: DataFrame, state: DataFrame, classes: int, emission: Emission) -> DataFrame:
    """A row for each document: counts, base score, log emissions and its class transitions as code and count."""
    sent = chunks.sparkSession.sparkContext.broadcast(emission)
    known = numbers.where("chunk >= 0").select("bucket", "chunk", "n").join(state.select("bucket", "chunk", "of"), ["bucket", "chunk"])
    schema = "id string, held boolean, n_tokens long, n_known long, base_score double, emitted double, codes array<int>, times array<int>"

    def score(f: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        e, k, out = sent.value, classes + 2, []  # word classes, end, unknown
        places = places.sort_values("bucket")
        for row in f.itertuples():
            order = _unpack(row.order)
            n = np.zeros(len(order) + 1, dtype=np.int64)
            of = np.full(len(order) + 1, k - 1, dtype=np.int64)
            n[-1], of[-1] = e.ends, k - 2
            if len(order):
                n[order] = np.concatenate([_unpack(b, np.int64) for b in places["n"]])
                of[order] = np.where(n[order] > 0, np.concatenate([_unpack(b, np.int8) for b in places["of"]]), k - 1)
            base = np.log10((n + 0.5) / (e.total + 0.5 * (e.distinct + 1)))
            emit = np.zeros(len(n))
            seen = (n > 0) & (of < k - 2)
            emit[seen] = np.log10((n[seen] - e.discount) / e.count[of[seen]])
            if e.total:
                words, new = _words(row.words), np.flatnonzero(n[:-1] == 0)
                emit[new] = e.spelling.logs([words[i] for i in new]) - np.log10(max(1 - e.known, 1e-12))
            tokens, lens = _unpack(row.tokens).astype(np.int64), _unpack(row.lens).astype(np.int64)
            s = np.insert(tokens, np.cumsum(lens), len(order))
            first = np.cumsum(lens + 1) - (lens + 1)
            c = of[s]
            before = np.concatenate(([k - 2], c[:-1]))
            code = before * k + c
            doc = np.repeat(np.arange(len(lens)), lens + 1)
            both, times = np.unique(doc * (k * k) + code, return_counts=True)
            cut = np.searchsorted(both, np.arange(len(lens) + 1) * (k * k))
            codes = (both % (k * k)).astype(np.int32)
            sums = [np.add.reduceat(x[s], first) for x in ((n > 0).astype(np.int64), base, emit)] if len(lens) else [[], [], []]
            out.append(pd.DataFrame({
                "id": list(row.ids), "held": [not t for t in row.train], "n_tokens": lens + 1, "n_known": sums[0], "base_score": sums[1], "emitted": sums[2],
                "codes": [codes[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], "times": [times[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)],
            }))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return chunks.select("chunk", "order", "words", "tokens", "lens", "ids", "train").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(score, schema)


def transitions(seen: np.ndarray, count: np.ndarray, kinds: np.ndarray, ends: int, discount: float, alpha: float) -> np.ndarray:
    """Log10 probabilities of the class after each class: word classes, the end, and unseen words (the last), which get
    what the emissions of the classes give up. ``seen`` are the counts without a column for unseen words."""
    share = np.append(count, ends) / (count.sum() + ends)
    follow = (seen + alpha * share) / (seen.sum(axis=1, keepdims=True) + alpha)
    given = np.divide(discount * kinds, count, out=np.zeros(len(count)), where=count > 0)
    return np.log10(np.maximum(np.column_stack((follow, follow[:, : len(count)] @ given)), 1e-30))


def score(docs: DataFrame, train, id_col: str = "doc_id", classes: int = 32, head: int = 2048, alpha: float = 5.0, rounds: int = 4) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` for every row; the model learns from rows where ``train``.

    Null texts are empty: one token, the end. A null id is scored and teaches nothing. Repeated rows count as
    often as they stand. Without any training text every token has probability 1. Ties in frequency go to
    the smaller word.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    chunks, chunk_path = kept(chunks_of(docs, id_col, F.coalesce(train, F.lit(False)) & F.col(id_col).isNotNull()), "chunks")
    buckets = 16 + int(chunks.agg(F.sum("size")).first()[0] or 0) // BUCKET
    spelling = spelling_of(chunks)
    numbers, number_path = kept(number_words(chunks, buckets, head, spelling), "numbers")
    spelt = numbers.where("chunk = -1").agg(F.sum("spelt")).first()[0] or 0.0
    ends = docs.where(F.coalesce(train, F.lit(False)) & F.col(id_col).isNotNull()).count()

    def kinds_of(row: dict) -> Iterator[pa.RecordBatch]:
        n = _unpack(row["n"], np.int64)
        yield pa.record_batch([pa.array([int(x)], pa.int64()) for x in (n.sum(), (n > 0).sum(), (n == 1).sum(), (n == 2).sum())], ["a", "b", "c", "d"])

    stats = bucket_sums(numbers, None, kinds_of, "a long, b long, c long, d long").agg(F.sum("a"), F.sum("b"), F.sum("c"), F.sum("d")).first()
    spoken, distinct, once, twice = (x or 0 for x in stats)
    total, distinct = spoken + ends, distinct + (ends > 0)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    top = [(bytes(r["word"]), r["n"]) for r in numbers.select(F.inline("top")).orderBy(F.desc("n"), "word").limit(head).collect()]
    pairs = pair_counts(chunks, {w: i for i, (w, _) in enumerate(top)})
    of = exchange(pairs, classes)
    member = np.zeros((len(of), classes + 1))
    member[np.arange(len(of)), of] = 1
    seen = member.T @ (pairs @ member)
    del pairs
    share = member.T @ np.array([n for _, n in top] + [ends], dtype=float) + 1e-3
    share /= share.sum()
    follow = np.log((seen + alpha * share) / (seen.sum(axis=1, keepdims=True) + alpha))
    model = Classes({w: int(c) for (w, _), c in zip(top, of, strict=False)}, follow, np.log(share), classes)
    state, state_path = exchange_all(chunks, numbers, model, rounds)
    count, kinds = np.zeros(classes), np.zeros(classes)

    def by_class(row: dict) -> Iterator[pa.RecordBatch]:
        n, of = _unpack(row["n"], np.int64), _unpack(row["of"], np.int8)
        both = [np.bincount(of, weights=x, minlength=classes).astype(np.int64) for x in (n, n > 0)]
        yield pa.record_batch([pa.array(np.arange(classes, dtype=np.int32)), *map(pa.array, both)], ["class", "n", "k"])

    for r in bucket_sums(numbers, state, by_class, "class int, n long, k long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect():
        count[r["class"]], kinds[r["class"]] = r["n"], r["k"]
    sums, _ = kept(document_sums(chunks, numbers, state, classes, Emission(count, kinds, total, distinct, ends, discount, spelling, spelt)), "sums")
    for path in (chunk_path, number_path, state_path):
        remove(spark, path)
    k = classes + 2
    seen = np.zeros(k * k)
    learnt = sums.where(~F.col("held")).select(F.explode(F.arrays_zip("codes", "times")).alias("x")).groupBy("x.codes").agg(F.sum("x.times").alias("n"))
    for r in learnt.collect():  # a row for each pair of classes
        seen[r["codes"]] = r["n"]
    seen = seen.reshape(k, k)[:, : k - 1]
    logs = transitions(seen, count, kinds, ends, discount, alpha) if total else np.zeros((k, k))
    table = F.array(*[F.lit(float(x)) for x in logs.ravel()])
    moves = F.aggregate(F.arrays_zip("codes", "times"), F.lit(0.0), lambda a, x: a + F.get(F.col("logs"), x["codes"]) * x["times"])
    out = sums.withColumn("logs", table).select(
        F.col("id").cast(kind).alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("emitted") + moves).alias("score")
    )
    return out


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``; a fifth of the ids is held out."""
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    out = score(docs.select("doc_id", "text"), part != 1)
    return out.withColumn("held_out", F.coalesce(part == 1, F.lit(False)))
