"""Mixing sources to target weights over fixed-length token blocks, in SQL functions only.

The words of each source form one stream of documents, cut into blocks of ``block`` words. Output shards of
``shard`` slots draw multinomial source counts; slot ``j`` of a source, over all shards, takes the block at
place ``j mod n`` of that source's pseudorandom index permutation, a new permutation for each epoch. Slots
and blocks meet by (source, block index), so that one source with a third of all rows spreads over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.line_rules import WORD, words
from larkspur.llm.names import col, fresh
from larkspur.llm.storage import stage

WEIGHTS = (3.0, 1.0, 2.0)
CELLS = 1024


@dataclass
class Mix:
    """``sources``: a row a source; ``units``: a row a document with its place in the stream; ``slots``: a row
    for each drawn block (shard, source_no, ordinal, epoch, block)."""

    sources: DataFrame
    units: DataFrame
    slots: DataFrame
    block: int


def source_table(units: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Weights and targets of sources; one row for each distinct source, nulls last.

    Targets split ``share`` times all words by weight; those above ``cap`` times the source stop there and
    the excess goes to the others by weight. With sources in order of the words that a unit of weight may
    take at most, the first k are capped, where k is the least for which the others stay under their caps.
    """
    per = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    per = per.withColumn("source_no", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)).cast("int")))
    per = per.withColumns({"most": cap * F.col("source_size"), "ratio": cap * F.col("source_size") / F.col("weight")})
    rising = Window.orderBy("ratio", "source_no")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {"capped": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "lighter": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "total": share * F.sum("source_size").over(whole), "heavy": F.sum("weight").over(whole)}
    )
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("heavy") - F.col("lighter")))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(whole)["level"])
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return per.select("source", "source_no", "n_docs", "source_size", "weight", target.alias("target"))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, into: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, per ``keys``, in order of (bucket, order).

    Rows of one key meet only within a bucket; the buckets' own totals are summed in a second, small step.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    totals = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0).cast("long")))
    return rows.join(totals.drop("_sum"), [*keys, bucket]).withColumn(into, F.col("_start") + F.col("_in")).drop("_start", "_in")


def permuted(i: Column, n: Column, key: Column, rounds: int = 12) -> Column:
    """The place of ``i`` in a pseudorandom permutation of 0 to n - 1: a swap-or-not shuffle keyed by ``key``.

    Each round pairs x with (k - x) mod n and swaps the pair or not by a hash of its larger member, which is
    one to one for any n.
    """
    start = F.struct(i.cast("long").alias("x"), n.cast("long").alias("n"), key.alias("key"))

    def step(a: Column, r: Column) -> Column:
        pair = F.pmod(F.pmod(F.xxhash64(a["key"], r), a["n"]) - a["x"], a["n"])
        swap = F.xxhash64(a["key"], r, F.greatest(a["x"], pair)) % 2 != 0
        return F.struct(F.when(swap, pair).otherwise(a["x"]).alias("x"), a["n"].alias("n"), a["key"].alias("key"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda a: a["x"])


def ticket(id_col: str, seed: int) -> Column:
    """Names a document by its id and text and deals its place in the stream."""
    return F.xxhash64(col(id_col), F.coalesce(col("text"), F.lit("")), F.lit(seed))


def row_hash(docs: DataFrame, seed: int) -> Column:
    """A second hash, over all columns that can be hashed: with the ticket it names a row, but for equal rows."""
    hashed = [col(f.name) for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(F.lit(seed + 1), *hashed)


def _blocks(size: Column, block: int) -> Column:
    return F.ceil(size / F.lit(float(block))).cast("long")


def mix(docs: DataFrame, block: int = 64, shard: int = 4096, seed: int = 20, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", bucket_docs: int = 4096) -> Mix:
    """Plans the mix of all rows of ``docs`` (id, text, source).

    A null text has no words and takes no part; a null source is a source of its own, the last. Repeated
    rows are documents of their own. A block is taken ``cap`` times at most, once an epoch. All draws are
    hashes of ``seed`` and positions, so reruns agree. Documents of one ticket keep an order by size. Columns of
    any other name are not read but for ``row``, which tells rows apart. An empty table gives an empty plan.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    units = stage(docs.select(col(id_col).alias("id"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), ticket(id_col, seed).alias("ticket"), row_hash(docs, seed).alias("row")), "sizes")
    sources = stage(source_table(units, weights, share, cap).coalesce(1), "sources")
    placed = units.join(sources, units["source"].eqNullSafe(sources["source"])).select(units["*"], "source_no", "n_docs", "source_size", "target")
    placed = placed.withColumn("bucket", F.pmod("ticket", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_docs).cast("long"))))
    units = stage(running_total(placed, ["source_no"], "bucket", ["ticket", "row"], "size", "start").drop("bucket", "n_docs"), "streams")

    n = _blocks(F.col("source_size"), block)
    plan = sources.where("source_size > 0").withColumns({"n_blocks": n, "wanted": F.round(F.col("target") * n / F.col("source_size")).cast("long")})
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plan = plan.withColumn("high", F.sum("wanted").over(Window.orderBy("source_no")) / F.sum("wanted").over(whole))
    plan = stage(plan.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source_no")), F.lit(0.0))), "plan")
    total = plan.agg(F.sum("wanted")).first()[0] or 0
    # inverse of the cumulated shares by equi-join: a draw falls into a cell, a cell meets the sources that reach into it
    cells = plan.where("wanted > 0").select("source_no", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.lit(CELLS - 1), F.floor(F.col("high") * CELLS).cast("int")))).alias("cell"))
    cells = stage(cells.coalesce(1), "cells")
    draws = spark.range(0, total).select(F.floor(F.col("id") / shard).alias("shard"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).alias("u"))
    draws = draws.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int")).join(cells, "cell").where("u >= low and u < high")
    counts = draws.groupBy("shard", "source_no").agg(F.count("*").alias("drawn"))
    counts = stage(running_total(counts.withColumn("span", F.floor(F.col("shard") / 1024)), ["source_no"], "span", ["shard"], "drawn", "first").drop("span"), "draws")
    # what a source drew beyond its target goes, what it drew short fills a last shard
    short = plan.join(counts.groupBy("source_no").agg(F.sum("drawn").alias("got")), "source_no", "left")
    short = short.select(F.lit(-1).cast("long").alias("shard"), "source_no", F.coalesce("got", F.lit(0)).alias("first"), (F.col("wanted") - F.coalesce("got", F.lit(0))).alias("drawn")).where("drawn > 0")
    short = short.select("shard", "source_no", "first", "drawn")
    runs = counts.select("shard", "source_no", "first", "drawn").unionByName(short).join(plan.select("source_no", "wanted", "n_blocks"), "source_no")
    runs = runs.withColumn("last", F.least(F.col("first") + F.col("drawn"), "wanted")).where("last > first")
    # a run longer than a shard (the last one may be) is cut, so that no row grows with the input
    runs = runs.withColumn("from", F.explode(F.sequence("first", F.col("last") - 1, F.lit(shard).cast("long"))))
    # few small rows become many slots: they are dealt out before, else a task or two would make them all
    runs = runs.repartition(int(min(max(total // 1_000_000, 2 * spark.sparkContext.defaultParallelism), total // shard + 1)), "source_no", "from")
    slots = runs.select("shard", "source_no", "n_blocks", F.explode(F.sequence("from", F.least(F.col("from") + shard, "last") - 1)).alias("ordinal"))
    slots = slots.withColumn("epoch", F.floor(F.col("ordinal") / F.col("n_blocks")))
    slots = slots.withColumn("block", permuted(F.col("ordinal") % F.col("n_blocks"), F.col("n_blocks"), F.xxhash64(F.lit(seed), "source_no", "epoch")))
    return Mix(sources, units, slots.select("shard", "source_no", "ordinal", "epoch", "block"), block)


def pieces(m: Mix) -> DataFrame:
    """The part of a document in each block that it reaches into: ``start`` names the document within its
    source, words ``at`` to ``at + length - 1`` (from 0) are those in ``block``.

    Spark takes the size of exploded rows to be that of the rows before, here and for slots, so a join of the two
    would broadcast a table of any size: pieces are to be joined by sorting.
    """
    first, last = F.floor(F.col("start") / m.block), F.floor((F.col("start") + F.col("size") - 1) / m.block)
    cut = m.units.where("size > 0").select("source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * m.block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * m.block)
    return cut.select("source_no", "start", "block", (low - F.col("start")).alias("at"), (high - low).alias("length")).hint("merge")


def taken(m: Mix, id_col: str = "doc_id") -> DataFrame:
    """A row for each row of the documents: id, size, source_size, target and the words that the mix takes of it.

    Rows with a null text have size 0 and nothing taken; repeated rows stand apart, each with its own share.
    """
    times = m.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    words_of = pieces(m).join(times, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("length") * F.col("times")).alias("taken"))
    full = m.units.where("size > 0").join(words_of, ["source_no", "start"], "left")
    columns = [F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"]
    return full.select(columns).unionByName(m.units.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix as documents: a row for each document and epoch that takes words of it, with those words.

    A document taken whole keeps its text as it is; otherwise the taken words are joined by spaces. Columns
    are those of ``docs``, of whatever names; ``n_chars``, if there is one, is counted anew. Documents without
    words go. Repeated rows are documents of their own.
    """
    m = mix(docs, id_col=id_col, **options)
    parts = pieces(m).join(m.slots.select("source_no", "block", "epoch"), ["source_no", "block"])
    parts = parts.groupBy("source_no", "start", "epoch").agg(F.sum("length").alias("n"), F.array_sort(F.collect_list(F.struct("at", "length"))).alias("parts"))
    drawn = parts.join(m.units.where("size > 0").select("source_no", "start", "ticket", "row", "size"), ["source_no", "start"])
    seed = options.get("seed", 20)
    names = {x: fresh(x, docs.columns) for x in ("ticket", "row", "parts", "n", "size")}
    drawn = drawn.select(*[F.col(k).alias(v) for k, v in names.items()])
    n, size, taken_parts = (F.col(names[k]) for k in ("n", "size", "parts"))
    keys = [names["ticket"], names["row"]]
    rows = docs.withColumns(dict(zip(keys, (ticket(id_col, seed), row_hash(docs, seed)), strict=True))).dropDuplicates(keys)
    joined = rows.join(drawn, keys)
    some = F.array_join(F.flatten(F.transform(taken_parts, lambda p: F.slice(words(col("text")), (p["at"] + 1).cast("int"), p["length"].cast("int")))), " ")
    text = F.when(n == size, col("text")).otherwise(some)
    out = joined.select(*[text.alias(c) if c == "text" else col(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out

