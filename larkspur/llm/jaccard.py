"""Exact n-gram Jaccard join with multiple global orders.

Two sets with similarity t or more share a token among the first n - ceil(t n) + 1 of each set, whatever
order all tokens are put into. Candidates must do so under three orders: by the rarest word of a shingle, by
the rarity of all its words, and by a plain hash. Word counts come from all documents, in a table of fixed size.
The prefix of the first order is longer by a twentieth of the set, of which linked sets then share a twentieth.

Equal sets are one class from the start. A shingle that no other candidate holds can't be shared, so the number of
the others bounds every overlap of a set: (100 + p) min(s, s') >= p (n + n') must hold for a link. Within a prefix
token's documents no pairs are listed: each is compared with the most central member, the one with the least share of
shingles of its own, which joins most of a group of near copies in one step. Members that the bound still lets link
with another component fall into families that share tokens. A family is dealt into blocks of bounded size; blocks
meet in tasks that find candidates by inverted lists under the three orders and return links that join components.
Links are verified on the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.components import connected_components
from larkspur.llm.line_rules import SPACES
from larkspur.llm.names import col, fresh
from larkspur.llm.storage import kept, remove, stage
from larkspur.llm.workers import hand_back

COUNTERS = 1 << 18
BUCKETS = 1 << 20
PART = 2_000_000
BLOCK = 500_000  # shingles in a block of a family
M64 = np.uint64
MIX = [M64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _lower(x):
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often the words of each counter stand in all texts: ``COUNTERS`` numbers, whatever the input's size."""
    words = docs.select(F.explode(F.split(_lower(F.col("text")), SPACES)).alias("w"))
    counts = words.select(F.pmod(F.xxhash64("w"), F.lit(COUNTERS)).cast("int").alias("c")).groupBy("c").count().toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[counts["c"].to_numpy()] = counts["count"].to_numpy()
    return out


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> M64(31))) * MIX[k]
    return x ^ (x >> M64(29))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def extra(n: int) -> int:
    """By how much the first prefix of a set of ``n`` is longer than it must be, plus one."""
    return (n + 19) // 20


def hashed_sets(texts: list[str], width: int, rarity: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The shingle set of each text as ascending hashes, with the least and the summed rarity of each shingle's words."""
    lists = [t.encode("utf-8", "replace").lower().split() for t in texts]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in lists for w in ws), dtype=np.int64, count=sum(map(len, lists)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in number), dtype=np.uint64, count=len(number))
    rare = np.zeros(len(hashes), dtype=np.uint64) if rarity is None else rarity[(hashes % M64(COUNTERS)).astype(np.int64)].astype(np.uint64)
    at, none = 0, np.zeros(0, dtype=np.uint64)
    for ws in lists:
        own = ids[at : at + len(ws)]
        at += len(ws)
        if not len(own):
            yield none, none, none
            continue
        size = min(width, len(own))
        places = len(own) - size + 1
        h, r = hashes[own], rare[own]
        s, least, total = np.full(places, size, dtype=np.uint64), r[:places], np.zeros(places, dtype=np.uint64)
        for k in range(size):
            part = slice(k, places + k)
            s = _mixed(s * MIX[5] + h[part], k % 5)
            if rarity is not None:
                least = np.minimum(least, r[part])
                total = total + r[part]
        if rarity is None:
            yield np.unique(s), none, none
        else:
            s, first = np.unique(s, return_index=True)
            yield s, least[first], total[first]


def signatures_of(texts: list[str], rarity: np.ndarray, width: int, percent: int) -> Iterator[tuple[int, bytes | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Set size, digest of the set and prefixes under the three orders, for each text."""
    none = np.zeros(0, dtype=np.int64)
    for s, least, total in hashed_sets(texts, width, rarity):
        n = len(s)
        if not n:
            yield 0, None, none, none, none
            continue
        prefixes = []
        for k, key in enumerate(((least << M64(56)) | (_mixed(s, 5) >> M64(8)), (total << M64(48)) | (_mixed(s, 6) >> M64(16)), _mixed(s, 7))):
            p = prefix_length(n, percent) + (0 if k else extra(n) - 1)
            prefixes.append(s[np.argpartition(key, p - 1)[:p]] if p < n else s)
        one, two, three = prefixes
        yield n, xxhash.xxh128_digest(s.tobytes()), one.view(np.int64), (two & M64(0x7FFFFFFF)).astype(np.int64), (three & M64(0x7FFFFFFF)).astype(np.int64)


def _parts(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A frame's rows in stretches of about ``PART`` characters of ``text``."""
    part = (f["text"].str.len().cumsum() // PART).to_numpy()
    for k in np.unique(part):
        yield f[part == k]


def _lean(make: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``make``; the worker keeps neither memory that tasks before have freed nor what this one frees."""

    def lean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hand_back()
        yield from make(frames)
        hand_back()

    return lean


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def rarity_of(docs: DataFrame) -> np.ndarray:
    """A byte for each counter, small where its words are rare."""
    return np.minimum(np.log2(word_counts(docs) + 1) * 2, 120).astype(np.uint8)


def signatures(docs: DataFrame, id_col: str, width: int, percent: int, sent) -> DataFrame:
    """``(id, h, n, digest, p1, p2, p3)`` of every row, ``h`` a hash of its text; null texts count as empty and have no digest."""
    texts = docs.select(col(id_col).alias("id"), _hash(F.col("text")).alias("h"), F.coalesce("text", F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g in _parts(f):
                n, digest, one, two, three = zip(*signatures_of(list(g["text"]), sent.value, width, percent), strict=True)
                yield pd.DataFrame({"id": g["id"].to_numpy(), "h": g["h"].to_numpy(), "n": n, "digest": digest, "p1": one, "p2": two, "p3": three})

    kind = docs.schema[id_col].dataType.simpleString()
    return texts.mapInPandas(_lean(run), f"id {kind}, h long, n long, digest binary, p1 array<long>, p2 array<int>, p3 array<int>")


def _similar(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def shingle_set(text: str, width: int) -> set:
    words = text.encode("utf-8", "replace").lower().split()
    return {tuple(words)} if 0 < len(words) < width else set(zip(*[words[k:] for k in range(width)]))


def only(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``rows`` whose key is among ``ids`` (a column ``id``).

    Most others go before the shuffle: their keys fall into none of ``BUCKETS`` buckets that ids fall into. That
    table has ``BUCKETS`` rows at most, 8 MB, so it may be broadcast.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    used = ids.select(bucket("id").alias("_bucket")).distinct()
    return rows.join(F.broadcast(used), bucket(key) == F.col("_bucket"), "left_semi").join(ids.withColumnRenamed("id", key), key, "left_semi")


def texts_of(docs: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """``(k, text)`` for ``wanted`` rows (k, id, h): one text for each ``k``."""
    rows = docs.select(col(id_col).alias("id"), _hash(F.col("text")).alias("h"), "text")
    rows = only(rows, "id", wanted.select("id").distinct())
    return rows.join(wanted, ["id", "h"]).select("k", "text").dropDuplicates(["k"])


def own_shingles(texts: DataFrame, width: int) -> DataFrame:
    """``(k, u)``: how many shingles of each text no other one holds; rows without any are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g in _parts(f):
                yield pd.DataFrame({"k": g["k"].to_numpy(), "s": [s.view(np.int64) for s, _, _ in hashed_sets(list(g["text"]), width)]})

    held = texts.mapInPandas(_lean(run), "k long, s array<long>").select("k", F.explode("s").alias("s"))
    alone = held.groupBy("s").agg(F.count("*").alias("times"), F.min("k").alias("k")).where("times = 1")
    return alone.groupBy("k").agg(F.count("*").alias("u"))


def verified(pairs: DataFrame, orders: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar. The second and third orders come first, then the texts."""
    ends = lambda p: p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()
    short, short_path = kept(only(orders, "k", ends(pairs)), "prefixes")
    near = pairs.join(short.toDF("a", "a2", "a3"), "a").join(short.toDF("b", "b2", "b3"), "b")
    near, near_path = kept(near.where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b"), "candidates")
    some = only(texts, "k", ends(near))
    both = near.join(some.toDF("b", "tb"), "b").join(some.toDF("a", "ta"), "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for f in frames:
            keep = []
            for a, ta, tb in zip(f["a"], f["ta"], f["tb"], strict=True):
                if a not in known:
                    if len(known) >= 32:
                        known.clear()
                    known[a] = shingle_set(ta, width)
                keep.append(_similar(known[a], shingle_set(tb, width), percent))
            yield f.loc[keep, ["a", "b"]]

    links = stage(both.select("a", "b", "ta", "tb").mapInPandas(_lean(run), T.StructType([pairs.schema["a"], pairs.schema["b"]])), "links")
    remove(pairs.sparkSession, short_path)
    remove(pairs.sparkSession, near_path)
    return links


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """Rows of ``tokens`` whose token another row has too."""
    often = tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    return tokens.join(often, "token", "left_semi").select(*tokens.columns)


def open_members(placed: DataFrame, percent: int) -> DataFrame:
    """Members (token, k, n, w, c) that the bound lets link with a member of another component of their token.

    ``w`` is (100 + p) s - p n; two members may link if w >= p n' and w' >= p n. Against the largest ``w`` and the
    least ``n`` of all other components a member is judged without meeting them one by one.
    """
    by = placed.groupBy("token", "c").agg(F.max("w").alias("w"), F.min("n").alias("n"))
    top = by.groupBy("token").agg(F.max(F.struct("w", "c")).alias("hi"), F.min(F.struct("n", "c")).alias("lo"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    rest = by.join(top, "token").groupBy("token").agg(
        F.first("hi").alias("hi"), F.first("lo").alias("lo"), F.max(F.when(F.col("c") != F.col("hi.c"), F.col("w"))).alias("w2"), F.min(F.when(F.col("c") != F.col("lo.c"), F.col("n"))).alias("n2")
    )
    w = F.when(F.col("c") == F.col("hi.c"), F.col("w2")).otherwise(F.col("hi.w"))
    n = F.when(F.col("c") == F.col("lo.c"), F.col("n2")).otherwise(F.col("lo.n"))
    return placed.join(rest, "token").where((w >= percent * F.col("n")) & (F.col("w") >= percent * n)).select("token", "k", "n", "w", "c")


def _enough(members: DataFrame, percent: int) -> DataFrame:
    """Rows of members that share as many tokens as a link takes: ``extra`` of the smallest set that may link."""
    need = F.floor((F.floor((percent * F.col("n") + 99) / 100) + 19) / 20)
    some = members.groupBy("k", "n").agg(F.count("*").alias("m")).where(F.col("m") >= need).select("k")
    return members.join(some, "k", "left_semi").select(*members.columns)


def families(members: DataFrame) -> DataFrame:
    """``(k, family)`` of members (token, k): those that share tokens, directly or by others, are one family."""
    lead = members.groupBy("token").agg(F.min("k").alias("v"))
    return connected_components(members.join(lead, "token").select(F.col("k").alias("u"), "v"))


class _Lists:
    """Inverted lists: which of some rows hold each token."""

    def __init__(self, rows: list[np.ndarray]):
        held = np.concatenate(rows)
        token, self.code = np.unique(held, return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        order = np.argsort(self.code, kind="stable")
        self.size, self.owner = len(rows), owner[order]
        self.start = np.searchsorted(self.code[order], np.arange(len(token) + 1))
        self.at = np.cumsum([0, *map(len, rows)])

    def overlaps(self, row: int) -> np.ndarray:
        """How many tokens each row shares with one of them."""
        codes = self.code[self.at[row] : self.at[row + 1]]
        first, many = self.start[codes], self.start[codes + 1] - self.start[codes]
        places = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        return np.bincount(self.owner[places], minlength=self.size)


def block_links(f: pd.DataFrame, rarity: np.ndarray, width: int, percent: int) -> list[tuple[int, int]]:
    """Links between rows (k, n, w, c, part, text) of different components ``c``, as many as it takes to join them.

    Rows of the same part meet only if all rows are of one. Candidates share a token under each order and may link by ``w``.
    """
    texts, keys = list(f["text"]), f["k"].to_numpy()
    prefixes = list(zip(*(x[2:] for x in signatures_of(texts, rarity, width, percent)), strict=True))
    orders = [_Lists(list(p)) for p in prefixes]
    whole = _Lists([x for x, _, _ in hashed_sets(texts, width)])
    n, w, part = f["n"].to_numpy(), f["w"].to_numpy(), f["part"].to_numpy()
    _, c = np.unique(f["c"].to_numpy(), return_inverse=True)
    alone = len(set(part.tolist())) == 1
    links = []
    for a in range(len(f)):
        may = (np.arange(len(f)) > a) & (c != c[a]) & (w >= percent * n[a]) & (w[a] >= percent * n) & (alone | (part != part[a]))
        for order in orders:
            if may.any():
                may &= order.overlaps(a) > 0
        if not may.any():
            continue
        both = whole.overlaps(a)
        for b in np.flatnonzero(may & (100 * both >= percent * (n + n[a] - both))):
            if c[a] != c[b] and _similar(shingle_set(texts[a], width), shingle_set(texts[b], width), percent):
                links.append((int(keys[a]), int(keys[b])))
                c[c == c[b]] = c[a]
    return links


def links_in_families(rows: DataFrame, texts: DataFrame, rarity, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members (k, n, w, c, family) of different components, block against block."""
    total = rows.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where("m > 1").drop("m")
    dealt = rows.join(total, "family").withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "k", "n", "w", "c")
    with_text = dealt.join(texts, "k").select("family", "i", "j", "part", "k", "n", "w", "c", "text")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(f, rarity.value, width, percent) if f["c"].nunique() > 1 else [], columns=["a", "b"], dtype="int64")

    return with_text.groupBy("family", "i", "j").applyInPandas(run, "a long, b long")


def links_between(members: DataFrame, orders: DataFrame, texts: DataFrame, rarity, width: int, percent: int) -> DataFrame:
    """``(node, component)`` of classes ``k`` that are linked; ``members`` are (token, k, n, w)."""
    own = (100 * F.col("n") - F.col("w")) / F.col("n")  # grows with the share of shingles of its own
    central = members.groupBy("token").agg(F.min(F.struct(own.alias("own"), F.xxhash64("k").alias("draw"), "k", "n", "w")).alias("v"))
    central = central.select("token", F.col("v.k").alias("a"), F.col("v.n").alias("an"), F.col("v.w").alias("aw"))
    may = (F.col("k") != F.col("a")) & (F.col("w") >= percent * F.col("an")) & (F.col("aw") >= percent * F.col("n"))
    pairs = stage(members.join(central, "token").where(may).select(F.least("a", "k").alias("a"), F.greatest("a", "k").alias("b")).distinct(), "pairs", narrow=True)
    links = verified(pairs, orders, texts, width, percent)
    parts = connected_components(links, "a", "b")
    placed = members.join(parts.toDF("k", "c"), "k", "left").withColumn("c", F.coalesce("c", "k"))
    placed = stage(placed.select("token", "k", "n", "w", "c"), "placed", narrow=True)
    left = stage(_enough(open_members(placed, percent), percent), "open", narrow=True)
    rows = left.select("k", "n", "w", "c").distinct().join(families(left).toDF("k", "family"), "k")
    new = stage(links_in_families(rows, texts, rarity, width, percent), "links")
    return parts if new.isEmpty() else connected_components(links.unionByName(new), "a", "b")


def classes_of(docs: DataFrame, width: int, percent: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows (id, h, n, digest), and classes of equal sets: digest, and ``head``, the struct (id, h) of the
    first row (by id, then h) of all that are linked with the class."""
    spark = docs.sparkSession
    rarity = spark.sparkContext.broadcast(rarity_of(docs))
    sig = stage(signatures(docs, id_col, width, percent, rarity).withColumn("row", F.monotonically_increasing_id()), "signatures")
    named = sig.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    # equal sets have equal prefixes, so the first one of a class goes along
    classes = named.groupBy("digest").agg(F.min(F.struct("id", "h", "row")).alias("first"), F.first("n").alias("n"), F.first("p1").alias("p1"))
    classes = stage(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    common, common_path = kept(shared_tokens(classes.select("k", "n", F.explode("p1").alias("token"))), "common", narrow=True)
    common = _enough(common, percent)
    wanted = classes.select("k", "first.*", "n").join(common.select("k").distinct(), "k", "left_semi")
    wanted, wanted_path = kept(wanted, "wanted", narrow=True)
    orders = only(sig.select("row", "p2", "p3"), "row", wanted.select(F.col("row").alias("id")))
    orders, orders_path = kept(orders.join(wanted.select("row", "k"), "row").select("k", "p2", "p3"), "orders")
    texts, texts_path = kept(texts_of(docs, id_col, wanted.select("k", "id", "h")), "texts")
    sizes = wanted.join(own_shingles(texts, width), "k", "left").select("k", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"))
    sizes = stage(sizes, "sizes", narrow=True)
    members = common.join(sizes, "k").where(100 * F.col("s") >= percent * F.col("n"))
    members = members.select("token", "k", "n", ((100 + percent) * F.col("s") - percent * F.col("n")).alias("w"))
    members, members_path = kept(_enough(shared_tokens(members), percent), "members", narrow=True)
    parts = links_between(members, orders, texts, rarity, width, percent)
    heads = classes.join(parts.toDF("k", "c"), "k", "left").select("digest", F.struct("first.id", "first.h").alias("first"), F.coalesce("c", "k").alias("c"))
    linked = heads.groupBy("c").agg(F.min("first").alias("head"))
    heads = stage(heads.join(linked, "c").select("digest", "head"), "heads", narrow=True)
    for path in (orders_path, common_path, wanted_path, texts_path, members_path):
        remove(spark, path)
    return sig.select("id", "h", "n", "digest"), heads


def components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs`` (id, text and any other columns).

    Documents whose shingle sets have a Jaccard similarity of ``percent`` or more are linked; a component is
    named by its smallest id. Texts that are null or without words have no shingles and are their own
    component; rows with a null id link nothing and have a null component. Repeated rows get equal results. Rows
    that repeat an id with another text are documents of their own, each judged by its text, whose components
    the id may name alike. Texts of any length are taken whole.
    """
    sig, heads = classes_of(docs, width, percent, id_col)
    out = sig.join(heads, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("head.id", "id")).alias("component_id"))


def deduplicate(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id") -> DataFrame:
    """One document of each component, that with the smallest id, with all columns of ``docs``.

    Rows without an id stay, whatever their text. Of rows that repeat an id and its text one stays; of rows that
    repeat an id with other texts each is judged by its own text. Documents without words are like nothing and stay.
    """
    sig, heads = classes_of(docs, width, percent, id_col)
    found = stage(sig.join(heads, "digest", "left").select("id", "h", "head"), "found")
    drop = found.where((F.col("head.id") != F.col("id")) | (F.col("head.h") != F.col("h"))).select("id", "h").distinct()
    i, h = fresh("drop_id", docs.columns), fresh("drop_h", docs.columns)
    same = (col(id_col) == F.col(i)) & (_hash(col("text")) == F.col(h))
    rest = docs.join(drop.toDF(i, h), same, "left_anti").select(*map(col, docs.columns))
    if found.where(F.col("id").isNotNull()).groupBy("id", "h").count().where("count > 1").isEmpty():
        return rest
    once = rest.where(col(id_col).isNotNull()).withColumn(h, _hash(col("text"))).dropDuplicates([id_col, h]).select(*map(col, docs.columns))
    return once.unionByName(rest.where(col(id_col).isNull()))
