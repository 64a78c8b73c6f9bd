"""Registered queries of single parts: tokenizers, filters, language packs, engine calls, streams; most with SQL over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.errors import BadRequest
from larkspur.functions import languages, scripts, text
from larkspur.queries import ORACLE_SQL, QUERIES, SPARSE_SQL, WORDS_SQL, _shared, _tokens, _tokens_sql, add, events, ids, lines, orders, parts, search, sparse, tree
from larkspur.streaming.ingest import session_counts, windowed_counts

__all__ = ["ORACLE_SQL", "QUERIES"]

_split = text.whitespace_tokens
_SPLIT_SQL = "string_split(p_name, ' ')"


def _with(c, more: str):
    return F.concat(c, F.lit(more))


# tokenizers and filters

for _name, _chain, _sql in (
    ("x_whitespace", lambda c: _split(_with(c, " a-b  c")), f"list_concat({_SPLIT_SQL}, ['a-b', 'c'])"),
    ("x_character", lambda c: text.character_tokens(_with(c, " 12ab34"), "[a-z]"), "regexp_extract_all(concat(p_name, ' 12ab34'), '[a-z]+')"),
    ("x_regexp_tokens", lambda c: text.regexp_tokens(c, "[aeiou]"), "regexp_extract_all(p_name, '[aeiou]')"),
    ("x_exception", lambda c: text.exception_tokens(_with(c, " C++ c.x 3"), (r"C\+\+",)), f"list_concat({_SPLIT_SQL}, ['C++', 'c.x', '3'])"),
    ("x_letter", lambda c: text.letter_tokens(_with(c, " A1b")), f"list_concat({_SPLIT_SQL}, ['A', 'b'])"),
    ("x_regexp_char", lambda c: _split(text.regexp_char(c, "[aeiou]", "_")), "string_split(regexp_replace(p_name, '[aeiou]', '_', 'g'), ' ')"),
    ("x_zero_width", lambda c: _split(text.zero_width_non_joiner(_with(c, "‌x"))), f"list_append({_SPLIT_SQL}, 'x')"),
    ("x_apostrophe", lambda c: text.apostrophe(_split(_with(c, "'nin x"))), f"list_append({_SPLIT_SQL}, 'x')"),
    ("x_keyword_marker", lambda c: text.stemmer("en", ("rings",))(F.array(F.lit("rings"), F.lit("running"))), "['rings', 'run']"),
    ("x_normal_form", lambda c: text.normal_form("NFKC")(F.array(F.concat(F.lit("ﬁ"), c))), "['fi' || p_name]"),
    ("x_camel_case", lambda c: text.camel_case(F.array(F.lit("parseHTMLText42"))), "['parse', 'HTML', 'Text', '42']"),
    ("x_compound", lambda c: text.dictionary_compound(_split(F.concat(F.lit("snowboard"), F.lit(" "), c)), ("snow", "board")), f"list_concat(['snowboard', 'snow', 'board'], {_SPLIT_SQL})"),
    ("x_shingle_originals", lambda c: text.shingles(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2, 3, originals=True), "['a', 'a b', 'a b c', 'b', 'b c', 'c']"),
    ("x_edge_ngram_back", lambda c: text.edge_ngrams(F.array(F.lit("ring")), 1, 2, back=True), "['g', 'ng']"),
    ("x_porter_words", lambda c: text.stemmer("en")(F.split(F.lit("caresses ponies cats agreed plastered motoring hopping relational conditional triplicate hopefulness"), " ")),
     "['caress', 'poni', 'cat', 'agre', 'plaster', 'motor', 'hop', 'relat', 'condit', 'triplic', 'hope']"),
    ("x_fold_words", lambda c: _split(text.ascii_fold(F.lit("Éclair naïve straße Œuvre ægir łódź smörgås"))), "['Eclair', 'naive', 'strasse', 'OEuvre', 'aegir', 'lodz', 'smorgas']"),
    ("x_arabic", lambda c: F.array(scripts.arabic(F.lit("أُمّة إلى آخِر"))), "['امه الي اخر']"),
    ("x_persian", lambda c: F.array(scripts.persian(F.lit("کتابهای خانۀ"))), "['كتابهاي خانه']"),
    ("x_sorani", lambda c: F.transform(F.split(F.lit("رووي كه"), " "), scripts.sorani), "['ڕووی', 'کە']"),
    ("x_hindi", lambda c: F.array(scripts.hindi(F.lit("हिन्दी फ़िल्में आइए"))), "['हिंदि फिलमें अइए']"),
    ("x_width", lambda c: F.array(scripts.width(F.lit("Ｔｅｓｔ１２ ｶﾞｷﾞﾊﾟ ｱｲ"))), "['Test12 ガギパ アイ']"),
    ("l_cjk", lambda c: text.ANALYZERS["cjk"](_with(F.lit("日本語 "), "Abc")), "['日本', '本語', 'abc']"),
):
    add(_name, _tokens(_chain), _tokens_sql(_sql))

# language packs and stop lists: stop words of each language go, in any case; numbers stay

COMMON = {
    "ar": "في من على", "bg": "и на за", "ca": "amb per els", "ckb": "لە بە و", "cs": "jako nebo proto", "da": "og ikke det", "de": "und nicht ich", "el": "και του της", "en": "and you have", "es": "que los pero",
    "eu": "eta dira", "fa": "که از این", "fi": "ja että olla", "fr": "les avec nous", "ga": "agus an na", "gl": "que pero unha", "hi": "और यह वह", "hu": "és nem hogy", "hy": "և որ մեջ", "id": "yang dan dengan",
    "it": "che non sono", "nl": "het niet een", "no": "og ikke det", "pt": "que não para", "ro": "este pentru sau", "ru": "и что не", "sv": "och inte det", "tr": "ve bir çok",
}


def _pack(lang: str) -> Callable:
    said = f"{COMMON[lang]} {COMMON[lang].upper() if lang not in ('tr', 'el', 'hy') else ''} "
    return lambda spark, d: parts(spark, d).select("p_partkey", F.array_join(text.ANALYZERS[lang](F.concat(F.lit(said), F.col("p_partkey").cast("string"))), "|").alias("tokens"))


for _lang in COMMON:
    if _lang in languages.STOP:
        add(f"l_{_lang}", _pack(_lang), "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS tokens FROM part")

# clauses, metrics, buckets

EV = "SELECT CAST(event_id AS VARCHAR) AS _id FROM events"
add("q_boost", ids(events, {"bool": {"should": [{"term": {"event_type": {"value": "click", "boost": 3}}}, {"match": {"event_type": {"query": "view", "boost": 0.5}}}]}}), f"{EV} WHERE event_type IN ('click', 'view')")
add("m_quantiles_exact", tree(lines, {"m": {"quantiles": {"field": "l_quantity"}}}), "SELECT array_to_string([CAST(CAST(round(x, 3) AS DECIMAL(20,3)) AS VARCHAR) FOR x IN quantile_cont(l_quantity, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])], '|') AS m FROM lineitem")
add("b_percentiles_exact", tree(orders, {"b": {"terms": {"field": "o_orderpriority"}, "aggs": {"p": {"percentiles": {"field": "o_totalprice", "percents": [0, 10, 50, 99.5, 100]}}, "s": {"sum": {"field": "o_totalprice"}}}}}, "b"), """
SELECT o_orderpriority AS b, count(*) AS doc_count, array_to_string([CAST(CAST(round(x, 3) AS DECIMAL(20,3)) AS VARCHAR) FOR x IN quantile_cont(o_totalprice, [0, 0.1, 0.5, 0.995, 1])], '|') AS p, round(sum(o_totalprice), 3) AS s FROM orders GROUP BY 1""")  # fmt: skip


def _words(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).withColumn("words", F.split(F.lower("p_name"), " "))


add("m_cardinality_values", tree(_words, {"m": {"cardinality": {"field": "words"}}}), f"SELECT count(DISTINCT w) AS m FROM (SELECT unnest({WORDS_SQL}) AS w FROM part)")
add("b_cardinality_values", tree(_words, {"b": {"terms": {"field": "p_brand"}, "aggs": {"m": {"cardinality": {"field": "words"}}}}}, "b"), f"""
SELECT p_brand AS b, count(DISTINCT p_partkey) AS doc_count, count(DISTINCT w) AS m FROM (SELECT p_partkey, p_brand, unnest({WORDS_SQL}) AS w FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")  # fmt: skip
add("m_sum_where", tree(events, {"m": {"sum": {"field": "value", "where": {"term": {"event_type": "click"}}}}}), "SELECT round(sum(value) FILTER (event_type = 'click'), 3) AS m FROM events")
add("m_avg_missing", tree(sparse, {"m": {"avg": {"field": "value", "missing": 0}}}), f"SELECT round(avg(coalesce(value, 0)), 3) AS m FROM {SPARSE_SQL}")
add("b_histogram_missing", tree(sparse, {"b": {"histogram": {"field": "value", "interval": 50, "min_doc_count": 1, "missing": -10}}}, "b"), f"SELECT floor(coalesce(value, -10) / 50) * 50 AS b, count(*) AS doc_count FROM {SPARSE_SQL} GROUP BY 1")
add("b_terms_min_doc_count", tree(lines, {"b": {"terms": {"field": "l_suppkey", "size": 1000, "min_doc_count": 60}}}, "b"), "SELECT l_suppkey AS b, count(*) AS doc_count FROM lineitem GROUP BY 1 HAVING count(*) >= 60 ORDER BY 2 DESC, 1 LIMIT 1000")

# scores


def _scores(body: dict, **options) -> Callable:
    return lambda spark, d: search(parts(spark, d), {"query": body}, **options).scored().select("_id", F.round("_score", 6).alias("score"))


def _bm25(words: dict[str, float], idf: str = "ln(1 + (n - {n} + 0.5) / ({n} + 0.5))", every: bool = False) -> str:
    """BM25 of the sum of words with boosts."""
    names = {w: f"w{i}" for i, w in enumerate(words)}
    weight = {w: f"{boost} * " + idf.format(n=f"n_{names[w]}") for w, boost in words.items()}
    return f"""WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS _id, {WORDS_SQL} AS w FROM part),
s AS (SELECT count(*) AS n, avg(len(w)) AS a, {", ".join(f"sum(CAST(list_contains(w, '{w}') AS INT)) AS n_{x}" for w, x in names.items())} FROM d),
x AS (SELECT _id, len(w) AS dl, a, n, {", ".join(f"n_{x}, len([t FOR t IN w IF t = '{w}']) AS f_{x}" for w, x in names.items())} FROM d, s)
SELECT _id, round({" + ".join(f"CASE WHEN f_{x} > 0 THEN {weight[w]} - ({weight[w]}) / (1 + f_{x} / (1.2 * (0.25 + 0.75 * dl / a))) ELSE 0 END" for w, x in names.items())}, 6) AS score
FROM x WHERE {(" AND " if every else " OR ").join(f"f_{x} > 0" for x in names.values())}"""


add("t_idf_reference", _scores({"match": {"p_name": "ring"}}, idf="reference"), _bm25({"ring": 1.0}, "ln(1 + (n - {n}) + 0.5 / ({n} + 0.5))"))
add("t_composite_sum", _scores({"bool": {"must": [{"term": {"p_name": "small"}}, {"term": {"p_name": "ring"}}]}}), _bm25({"small": 1.0, "ring": 1.0}, every=True))
add("t_score_should", _scores({"bool": {"should": [{"term": {"p_name": "small"}}, {"term": {"p_name": "ring"}}, {"term": {"p_name": "blue"}}]}}), _bm25({"small": 1.0, "ring": 1.0, "blue": 1.0}))
add("t_constant_score", _scores({"match_all": {}}), "SELECT CAST(p_partkey AS VARCHAR) AS _id, CAST(1.0 AS DOUBLE) AS score FROM part")

# engine calls


def _recent(spark: SparkSession, d: str) -> DataFrame:
    """The scan window: of an event each hour back from now, those of the last twelve hours."""
    engine = Engine(spark)
    engine.register("log", spark.range(48).select(F.col("id").cast("string").alias("_id"), (F.current_timestamp() - F.make_dt_interval(hours=F.col("id").cast("int"), mins=F.lit(30))).alias("@timestamp")))
    return engine.query("log", {}, hours=12).matching().select("_id")


add("s_scan_window", _recent, "SELECT CAST(i AS VARCHAR) AS _id FROM range(12) t(i)")


def _virtual(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("events", events(spark, d))
    engine.add_virtual_field("events", "tenant", "north")
    return engine.query("events", {"query": {"bool": {"filter": [{"term": {"tenant": "north"}}, {"range": {"value": {"lt": 5}}}]}}}).matching().select("_id", "tenant")


add("s_virtual_field", _virtual, "SELECT CAST(event_id AS VARCHAR) AS _id, 'north' AS tenant FROM events WHERE value < 5")


def _refused(spark: SparkSession, d: str) -> DataFrame:
    """What the engine refuses: a range on an unknown field, too many documents, an unknown kind of aggregation, a wrong line."""
    engine = Engine(spark)
    engine.register("events", events(spark, d))
    calls = {
        "range": lambda: engine.query("events", {"query": {"range": {"nothing": {"gt": 1}}}}),
        "doc_num_limit": lambda: engine.query("events", {}, doc_num_limit=10),
        "aggregation": lambda: engine.query("events", {"aggs": {"a": {"nothing": {"field": "value"}}}}).aggregations(),
        "bulk": lambda: engine.bulk('{"create": {"_index": "x"}}\nnot json'),
        "sort": lambda: engine.query("events", {"sort": ["nothing"]}).hits(),
        "fine": lambda: engine.query("events", {}, doc_num_limit=1 << 40),
    }
    out = []
    for name, call in calls.items():
        try:
            call()
            out.append((name, False))
        except BadRequest:
            out.append((name, True))
    return spark.createDataFrame(out, "call string, refused boolean")


add("s_refused", _refused, "SELECT * FROM (VALUES ('range', true), ('doc_num_limit', true), ('aggregation', true), ('bulk', true), ('sort', true), ('fine', false)) t(call, refused)")


def _templates(spark: SparkSession, d: str) -> DataFrame:
    """An index made by ingestion takes the mapping of the fitting template of highest priority."""
    engine = Engine(spark, _shared(spark))
    for name, pattern, priority, kind in (("all", "*", 0, "text"), ("logs", "log-*", 5, "keyword"), ("other", "metric-*", 9, "long")):
        engine.catalog.put_template(name, {"index_patterns": [pattern], "priority": priority, "template": {"mappings": {"properties": {"v": {"type": kind}}}}})
    for index in ("log-1", "plain", "metric-7"):
        engine.create_index(index)
    return spark.createDataFrame([(i.name, i.mapping.properties["v"].type) for i in engine.catalog.resolve("*")], "name string, kind string")


add("s_templates", _templates, "SELECT * FROM (VALUES ('log-1', 'keyword'), ('plain', 'text'), ('metric-7', 'long')) t(name, kind)")


def _response(spark: SparkSession, d: str) -> DataFrame:
    """Names, totals and counts in a response with typed keys."""
    engine = Engine(spark)
    engine.register("events", events(spark, d))
    body = {"size": 1, "query": {"term": {"event_type": "click"}}, "aggs": {"by": {"terms": {"field": "event_type"}, "aggs": {"m": {"max": {"field": "value"}}}}, "a": {"min": {"field": "value"}}}}
    found = engine.search("events", body, typed_keys=True, exact=True)
    bucket = found["aggregations"]["sterms#by"]["buckets"][0]
    return spark.createDataFrame([(found["hits"]["total"]["value"], bucket["key"], bucket["doc_count"], round(bucket["max#m"]["value"], 3), round(found["aggregations"]["min#a"]["value"], 3), len(found["hits"]["hits"]))], "total long, key string, n long, most double, least double, hits long")


add("s_response", _response, "SELECT count(*) AS total, 'click' AS key, count(*) AS n, round(max(value), 3) AS most, round(min(value), 3) AS least, 1 AS hits FROM events WHERE event_type = 'click'")


def _backup(spark: SparkSession, d: str) -> DataFrame:
    root = _shared(spark)
    engine = Engine(spark, root)
    engine.register("events", events(spark, d))
    engine.backup("events", f"{root}/copy")
    return spark.read.parquet(f"{root}/copy").groupBy("_index", "event_type").agg(F.count("*").alias("n"))


add("s_backup", _backup, "SELECT 'events' AS _index, event_type, count(*) AS n FROM events GROUP BY 2")


def _multi(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("events", events(spark, d))
    found = engine.multi_search([("events", {"size": 0, "query": {"term": {"event_type": x}}}) for x in ("click", "view")])
    return spark.createDataFrame([(i, r["hits"]["total"]["value"], len(r["hits"]["hits"])) for i, r in enumerate(found)], "i long, total long, hits long")


add("s_multi_search", _multi, "SELECT CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS i, count(*) AS total, 0 AS hits FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")

# streams


def _counted(count: Callable[[DataFrame], DataFrame]) -> Callable:
    """All events as files, read as a stream, counted by event time; the last state of the counts."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        root = _shared(spark)
        events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").repartition(3).write.parquet(f"{root}/in")
        stream = spark.readStream.schema("ts timestamp, user_id long, event_type string").parquet(f"{root}/in")
        sink = lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")
        count(stream).writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{root}/out")

    return run


_hours = _counted(lambda s: windowed_counts(s, "ts", ["event_type"], "1 hour"))
_visits = _counted(lambda s: session_counts(s, "ts", "user_id", "30 minutes"))
add("i_window_counts", lambda spark, d: _hours(spark, d).select(F.unix_millis("window.start").alias("start"), "event_type", "doc_count"), "SELECT epoch_ms(date_trunc('hour', ts)) AS start, event_type, count(*) AS doc_count FROM events GROUP BY 1, 2")
add("i_session_counts", lambda spark, d: _visits(spark, d).select(F.unix_micros("session.start").alias("start"), "user_id", "doc_count"), """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS doc_count FROM s GROUP BY user_id, n""")  # fmt: skip
