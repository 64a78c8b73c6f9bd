"""Registered queries over the standard tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.engine import Engine
from larkspur.functions import geo, text
from larkspur.operators.aggs import Aggregator, Node
from larkspur.operators.highlight import highlight
from larkspur.operators.search import Search
from larkspur.plans.mapping import Mapping, of_schema
from larkspur.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.withColumns({"_id": F.col("event_id").cast("string"), "@timestamp": F.col("ts")})


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value is missing for some users."""
    return events(spark, sf_dir).withColumn("value", F.when(F.col("user_id") % 7 != 0, F.col("value")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("_id", F.col("p_partkey").cast("string"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("_id", F.col("o_orderkey").cast("string"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers at invented coordinates."""
    df = table(spark, sf_dir, "customer")
    at = F.struct(((F.col("c_custkey") * 37 % 179) - 89).cast("double").alias("lat"), ((F.col("c_custkey") * 53 % 359) - 179).cast("double").alias("lon"))
    return df.withColumns({"_id": F.col("c_custkey").cast("string"), "at": at})


PLACES_SQL = "(SELECT *, CAST(c_custkey AS VARCHAR) AS _id, CAST(c_custkey * 37 % 179 - 89 AS DOUBLE) AS lat, CAST(c_custkey * 53 % 359 - 179 AS DOUBLE) AS lon FROM customer)"
SPARSE_SQL = "(SELECT * EXCLUDE (value), CASE WHEN user_id % 7 <> 0 THEN value END AS value FROM events)"


def search(df: DataFrame, body: dict, words: tuple[str, ...] = ("p_name",), **options) -> Search:
    return Search(df, of_schema(df.schema, words), body, **options)


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def shown(node: Node) -> DataFrame:
    """A node's rows with times as epoch milliseconds and rounded numbers."""
    out = []
    for f in node.rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_millis(c.cast("timestamp"))
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 3)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: F.round(x, 3).cast("decimal(20,3)").cast("string")), "|")
        out.append(c.alias(f.name))
    return node.rows.select(*out)


def at(nodes: list[Node], *path: str) -> Node:
    node = next(n for n in nodes if n.name == path[0])
    return at(node.children, *path[1:]) if len(path) > 1 else node


def tree(source, body: dict, *path: str, query: dict | None = None, exact: bool = True, key_mode: str = "instant") -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = search(source(spark, sf_dir), {"query": query} if query else {})
        return shown(at(Aggregator(s.matching(), s.mapping, exact, key_mode).run(body), *(path or ("",))))

    return run


def ids(source, query: dict) -> Callable:
    return lambda spark, d: search(source(spark, d), {"query": query}).matching().select("_id")


EV = "SELECT CAST(event_id AS VARCHAR) AS _id FROM events"
PT = "SELECT CAST(p_partkey AS VARCHAR) AS _id FROM part"
WORDS_SQL = "string_split(lower(p_name), ' ')"

# clauses

for _name, _query, _where in (
    ("q_match_all", {"match_all": {}}, "TRUE"),
    ("q_term_keyword", {"term": {"event_type": "click"}}, "event_type = 'click'"),
    ("q_term_numeric", {"term": {"user_id": {"value": 7}}}, "user_id = 7"),
    ("q_terms", {"terms": {"event_type": ["click", "error"]}}, "event_type IN ('click', 'error')"),
    ("q_terms_numeric", {"terms": {"user_id": [1, 5, 9]}}, "user_id IN (1, 5, 9)"),
    ("q_range_numeric", {"range": {"value": {"gte": 10, "lt": 50}}}, "value >= 10 AND value < 50"),
    ("q_range_from_to", {"range": {"value": {"from": 10, "to": 50, "include_lower": False, "include_upper": True}}}, "value > 10 AND value <= 50"),
    ("q_range_two_fields", {"range": {"value": {"gt": 20}, "user_id": {"lte": 30}}}, "value > 20 AND user_id <= 30"),
    ("q_range_date", {"range": {"@timestamp": {"gte": "2024-01-05T00:00:00Z", "lt": "2024-01-10 12:00:00"}}}, "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10 12:00:00'"),
    ("q_range_date_epoch", {"range": {"@timestamp": {"gte": 1704844800000}}}, "ts >= TIMESTAMP '2024-01-10'"),
    ("q_range_keyword", {"range": {"event_type": {"gte": "e", "lt": "q"}}}, "event_type >= 'e' AND event_type < 'q'"),
    ("q_ids", {"ids": {"values": ["3", "17", "99999999"]}}, "event_id IN (3, 17)"),
    ("q_exists", {"exists": {"field": "value"}}, "value IS NOT NULL"),
    ("q_bool_filter", {"bool": {"filter": [{"term": {"event_type": "error"}}, {"range": {"value": {"gt": 100}}}]}}, "event_type = 'error' AND value > 100"),
    ("q_bool_must_not", {"bool": {"must_not": [{"terms": {"event_type": ["click", "view"]}}]}}, "event_type NOT IN ('click', 'view')"),
    ("q_bool_min_should", {"bool": {"should": [{"term": {"event_type": "click"}}, {"range": {"value": {"gt": 50}}}, {"range": {"user_id": {"lt": 20}}}], "minimum_should_match": 2}},
     "CAST(event_type = 'click' AS INT) + CAST(value > 50 AS INT) + CAST(user_id < 20 AS INT) >= 2"),
    ("q_bool_should_optional", {"bool": {"must": [{"term": {"event_type": "click"}}], "should": [{"range": {"value": {"gt": 1000}}}]}}, "event_type = 'click'"),
    ("q_bool_nested", {"bool": {"should": [{"bool": {"must": [{"term": {"event_type": "view"}}], "must_not": [{"range": {"value": {"lt": 30}}}]}}, {"term": {"user_id": 3}}]}},
     "(event_type = 'view' AND NOT value < 30) OR user_id = 3"),
    ("q_match_keyword", {"match": {"event_type": "purchase"}}, "event_type = 'purchase'"),
    ("q_match_none", {"match_none": {}}, "FALSE"),
    ("q_prefix", {"prefix": {"event_type": "p"}}, "event_type LIKE 'p%'"),
    ("q_wildcard", {"wildcard": {"event_type": "?i*"}}, "event_type LIKE '_i%'"),
    ("q_regexp", {"regexp": {"event_type": "(click|v.*w)"}}, "regexp_full_match(event_type, '(click|v.*w)')"),
    ("q_fuzzy_keyword", {"fuzzy": {"event_type": {"value": "ciwe", "fuzziness": 2}}}, "damerau_levenshtein(event_type, 'ciwe') <= 2"),
    ("q_query_string", {"query_string": {"query": "event_type:click AND value:[10 TO 40} -user_id:3"}}, "event_type = 'click' AND value >= 10 AND value < 40 AND user_id <> 3"),
    ("q_query_string_or", {"query_string": {"query": "(event_type:er* OR event_type:/v.*/) AND value:>=20"}}, "(event_type LIKE 'er%' OR event_type LIKE 'v%') AND value >= 20"),
):
    add(_name, ids(events, _query), f"{EV} WHERE {_where}")

for _name, _query, _where in (
    ("t_match_or", {"match": {"p_name": "Red ring"}}, f"list_has_any({WORDS_SQL}, ['red', 'ring'])"),
    ("t_match_and", {"match": {"p_name": {"query": "red ring", "operator": "and"}}}, f"list_has_all({WORDS_SQL}, ['red', 'ring'])"),
    ("t_term", {"term": {"p_name": "widget"}}, f"list_contains({WORDS_SQL}, 'widget')"),
    ("t_terms", {"terms": {"p_name": ["widget", "bolt"]}}, f"list_has_any({WORDS_SQL}, ['widget', 'bolt'])"),
    ("t_range", {"range": {"p_name": {"gte": "s", "lt": "t"}}}, f"len([x FOR x IN {WORDS_SQL} IF x >= 's' AND x < 't']) > 0"),
    ("t_fuzzy", {"match": {"p_name": {"query": "rign", "fuzziness": 1}}}, f"len([x FOR x IN {WORDS_SQL} IF damerau_levenshtein(x, 'rign') <= 1]) > 0"),
    ("t_fuzzy_prefix", {"match": {"p_name": {"query": "smlal", "fuzziness": 2, "prefix_length": 2}}}, f"len([x FOR x IN {WORDS_SQL} IF starts_with(x, 'sm') AND damerau_levenshtein(x, 'smlal') <= 2]) > 0"),
    ("t_phrase", {"match_phrase": {"p_name": "small ring"}}, "concat(' ', lower(p_name), ' ') LIKE '% small ring %'"),
    ("t_phrase_slop", {"match_phrase": {"p_name": {"query": "ring small", "slop": 2}}}, f"len([x FOR x IN range(1, len({WORDS_SQL}) + 1) IF {WORDS_SQL}[x] = 'ring' AND len([y FOR y IN range(1, len({WORDS_SQL}) + 1) IF {WORDS_SQL}[y] = 'small' AND abs(y - x - 1) <= 2]) > 0]) > 0"),
    ("t_multi_phrase", {"multi_phrase": {"p_name": [["small", "red"], ["ring", "widget"]]}}, "regexp_matches(concat(' ', lower(p_name), ' '), ' (small|red) (ring|widget) ')"),
    ("t_prefix", {"prefix": {"p_name": "wi"}}, f"len([x FOR x IN {WORDS_SQL} IF starts_with(x, 'wi')]) > 0"),
    ("t_wildcard", {"wildcard": {"p_name": "r*g"}}, f"len([x FOR x IN {WORDS_SQL} IF regexp_full_match(x, 'r.*g')]) > 0"),
    ("t_query_string", {"query_string": {"query": '+p_name:"small ring" OR p_name:blue^2'}}, "concat(' ', lower(p_name), ' ') LIKE '% small ring %'"),
):
    add(_name, ids(parts, _query), f"{PT} WHERE {_where}")


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    found = search(parts(spark, d), {"query": {"match": {"p_name": "small ring"}}, "size": 10}).hits()
    return found.select("_id", F.round("_score", 6).alias("score"))


add("t_bm25_top10", _bm25, f"""
WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS _id, {WORDS_SQL} AS w FROM part),
s AS (SELECT count(*) AS n, avg(len(w)) AS a, sum(CAST(list_contains(w, 'small') AS INT)) AS n1, sum(CAST(list_contains(w, 'ring') AS INT)) AS n2 FROM d),
x AS (SELECT _id, len(w) AS dl, a, len([t FOR t IN w IF t = 'small']) AS f1, len([t FOR t IN w IF t = 'ring']) AS f2,
  ln(1 + (n - n1 + 0.5) / (n1 + 0.5)) AS w1, ln(1 + (n - n2 + 0.5) / (n2 + 0.5)) AS w2 FROM d, s),
y AS (SELECT _id, CASE WHEN f1 > 0 THEN w1 - w1 / (1 + f1 / (1.2 * (0.25 + 0.75 * dl / a))) ELSE 0 END
  + CASE WHEN f2 > 0 THEN w2 - w2 / (1 + f2 / (1.2 * (0.25 + 0.75 * dl / a))) ELSE 0 END AS s FROM x WHERE f1 + f2 > 0)
SELECT _id, round(s, 6) AS score FROM y ORDER BY round(s, 9) DESC, _id LIMIT 10""")

# sort, paging, names


def _hits(source, body: dict, *columns: str) -> Callable:
    return lambda spark, d: search(source(spark, d), body).hits().select(*columns)


add("s_sort_multi", _hits(events, {"sort": [{"event_type": {"order": "asc"}}, {"value": {"order": "desc"}}], "size": 50}, "_id", "event_type", "value"),
    "SELECT CAST(event_id AS VARCHAR) AS _id, event_type, value FROM events ORDER BY event_type, value DESC, CAST(event_id AS VARCHAR) LIMIT 50")
add("s_missing_last", _hits(sparse, {"query": {"range": {"user_id": {"lt": 15}}}, "sort": [{"value": {"order": "desc"}}], "size": 5000}, "_id", "value"),
    f"SELECT CAST(event_id AS VARCHAR) AS _id, value FROM {SPARSE_SQL} WHERE user_id < 15 ORDER BY value DESC NULLS LAST, CAST(event_id AS VARCHAR) LIMIT 5000")
add("s_missing_first", _hits(sparse, {"sort": [{"value": {"order": "desc", "missing": "_first"}}], "size": 30}, "_id", "value"),
    f"SELECT CAST(event_id AS VARCHAR) AS _id, value FROM {SPARSE_SQL} ORDER BY value DESC NULLS FIRST, CAST(event_id AS VARCHAR) LIMIT 30")
add("s_paging", _hits(events, {"query": {"term": {"event_type": "view"}}, "sort": [{"@timestamp": {"order": "desc"}}], "from": 20, "size": 15}, "_id"),
    f"{EV} WHERE event_type = 'view' ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 15 OFFSET 20")
add("s_search_after", _hits(events, {"sort": ["-value"], "search_after": [100.0], "size": 25}, "_id", "value"),
    "SELECT CAST(event_id AS VARCHAR) AS _id, value FROM events WHERE value < 100 OR value IS NULL ORDER BY value DESC NULLS LAST, CAST(event_id AS VARCHAR) LIMIT 25")
add("s_default_order", _hits(parts, {"query": {"match_all": {}}, "size": 12}, "_id", "_score"), 'SELECT CAST(p_partkey AS VARCHAR) AS _id, CAST(1.0 AS DOUBLE) AS "_score" FROM part ORDER BY 1 LIMIT 12')
add("s_total", lambda spark, d: search(events(spark, d), {"query": {"range": {"value": {"gt": 30}}}}).matching().agg(F.count("*").alias("total")), "SELECT count(*) AS total FROM events WHERE value > 30")


def _names(spark: SparkSession, d: str) -> Engine:
    engine, df = Engine(spark), events(spark, d)
    for kind in ("click", "error", "view"):
        engine.register(f"events-{kind}", df.where(F.col("event_type") == kind))
    engine.catalog.add_alias("seen", "events-click,events-view")
    return engine


def _by_index(expression: str) -> Callable:
    return lambda spark, d: _names(spark, d).query(expression, {"query": {"range": {"value": {"gte": 20}}}}).matching().groupBy("_index").agg(F.count("*").alias("n"))


add("s_multi_index", _by_index("events-*"), "SELECT 'events-' || event_type AS _index, count(*) AS n FROM events WHERE value >= 20 AND event_type IN ('click', 'error', 'view') GROUP BY 1")
add("s_alias", _by_index("seen"), "SELECT 'events-' || event_type AS _index, count(*) AS n FROM events WHERE value >= 20 AND event_type IN ('click', 'view') GROUP BY 1")

# metrics

for _name, _body, _sql in (
    ("m_count", {"m": {"count": {"field": "l_quantity"}}}, "count(*) AS m"),
    ("m_value_count", {"m": {"value_count": {"field": "l_quantity"}}}, "count(*) AS m"),
    ("m_sum", {"m": {"sum": {"field": "l_quantity"}}}, "round(sum(l_quantity), 3) AS m"),
    ("m_min", {"m": {"min": {"field": "l_extendedprice"}}}, "round(min(l_extendedprice), 3) AS m"),
    ("m_max", {"m": {"max": {"field": "l_extendedprice"}}}, "round(max(l_extendedprice), 3) AS m"),
    ("m_avg", {"m": {"avg": {"field": "l_quantity"}}}, "round(avg(l_quantity), 3) AS m"),
    ("m_weighted_avg", {"m": {"weighted_avg": {"value": {"field": "l_extendedprice"}, "weight": {"field": "l_quantity"}}}}, "round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) AS m"),
    ("m_cardinality_exact", {"m": {"cardinality": {"field": "l_partkey"}}}, "count(DISTINCT l_partkey) AS m"),
    ("m_percentiles_exact", {"m": {"percentiles": {"field": "l_extendedprice", "percents": [1, 5, 25, 50, 75, 95, 99]}}},
     "array_to_string([CAST(CAST(round(x, 3) AS DECIMAL(20,3)) AS VARCHAR) FOR x IN quantile_cont(l_extendedprice, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])], '|') AS m"),
):
    add(_name, tree(lines, _body), f"SELECT {_sql} FROM lineitem")
add("m_with_query", tree(lines, {"a": {"avg": {"field": "l_discount"}}, "n": {"count": {}}}, query={"term": {"l_returnflag": "R"}}), "SELECT round(avg(l_discount), 3) AS a, count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
add("m_empty", tree(lines, {"a": {"avg": {"field": "l_tax"}}, "s": {"sum": {"field": "l_tax"}}, "h": {"max": {"field": "l_tax"}}}, query={"term": {"l_returnflag": "?"}}), "SELECT CAST(NULL AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS h")

# buckets

add("b_terms", tree(events, {"b": {"terms": {"field": "event_type"}, "aggs": {"v": {"avg": {"field": "value"}}}}}, "b"), "SELECT event_type AS b, count(*) AS doc_count, round(avg(value), 3) AS v FROM events GROUP BY 1")
add("b_terms_size", tree(parts, {"b": {"terms": {"field": "p_brand", "size": 5}}}, "b"), "SELECT p_brand AS b, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
add("b_histogram", tree(lines, {"b": {"histogram": {"field": "l_quantity", "interval": 10, "min_doc_count": 1}}}, "b"), "SELECT floor(l_quantity / 10) * 10 AS b, count(*) AS doc_count FROM lineitem GROUP BY 1")
add("b_histogram_offset", tree(lines, {"b": {"histogram": {"field": "l_quantity", "interval": 10, "offset": 3, "min_doc_count": 1}}}, "b"), "SELECT floor((l_quantity - 3) / 10) * 10 + 3 AS b, count(*) AS doc_count FROM lineitem GROUP BY 1")
add("b_histogram_hard_bounds", tree(events, {"b": {"histogram": {"field": "value", "interval": 20, "min_doc_count": 1, "hard_bounds": {"min": 40, "max": 200}}}}, "b"),
    "SELECT floor(value / 20) * 20 AS b, count(*) AS doc_count FROM events WHERE value BETWEEN 40 AND 200 GROUP BY 1")
add("b_histogram_zero_fill", tree(events, {"b": {"histogram": {"field": "value", "interval": 5, "extended_bounds": {"min": -20, "max": 600}}}}, "b"), """
WITH c AS (SELECT floor(value / 5) AS k, count(*) AS n FROM events GROUP BY 1), r AS (SELECT CAST(least(min(k), -4) AS BIGINT) AS a, CAST(greatest(max(k), 120) AS BIGINT) AS z FROM c)
SELECT CAST(g.k * 5 AS DOUBLE) AS b, CAST(coalesce(n, 0) AS BIGINT) AS doc_count FROM (SELECT unnest(generate_series(a, z)) AS k FROM r) g LEFT JOIN c ON c.k = g.k""")  # fmt: skip
add("b_range", tree(events, {"b": {"range": {"field": "value", "ranges": [{"to": 10}, {"from": 10, "to": 100}, {"from": 100}, {"from": 10000}]}}}, "b"), """
SELECT k AS b, count(event_id) AS doc_count FROM (VALUES ('[*,10.0)', -1e18, 10), ('[10.0,100.0)', 10, 100), ('[100.0,*)', 100, 1e18), ('[10000.0,*)', 10000, 1e18)) r(k, a, z) LEFT JOIN events ON value >= a AND value < z GROUP BY 1""")  # fmt: skip
add("b_range_overlap", tree(events, {"b": {"range": {"field": "value", "ranges": [{"key": "low", "from": 0, "to": 50}, {"key": "mid", "from": 25, "to": 75}]}, "aggs": {"s": {"sum": {"field": "value"}}}}}, "b"), """
SELECT k AS b, count(*) AS doc_count, round(sum(value), 3) AS s FROM (VALUES ('low', 0, 50), ('mid', 25, 75)) r(k, a, z) JOIN events ON value >= a AND value < z GROUP BY 1""")  # fmt: skip
add("b_range_same_key", tree(events, {"b": {"range": {"field": "value", "ranges": [{"key": "x", "to": 20}, {"key": "x", "to": 20}, {"key": "x", "from": 50}]}, "aggs": {"s": {"max": {"field": "value"}}}}}, "b"), """
SELECT 'x' AS b, count(*) AS doc_count, round(max(value), 3) AS s FROM (VALUES (0, -1e18, 20), (1, -1e18, 20), (2, 50, 1e18)) r(i, a, z) JOIN events ON value >= a AND value < z GROUP BY i""")  # fmt: skip
add("n_dotted_names", tree(events, {"my.type": {"terms": {"field": "event_type"}, "aggs": {"per.day": {"date_histogram": {"field": "@timestamp", "calendar_interval": "day"}, "aggs": {"a.b": {"max": {"field": "value"}}}}}}}, "my.type", "per.day"), """
WITH c AS (SELECT event_type AS t, date_trunc('day', ts) AS d, count(*) AS n, round(max(value), 3) AS m FROM events GROUP BY 1, 2),
g AS (SELECT t, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM c GROUP BY 1)
SELECT g.t AS "my.type", epoch_ms(g.d) AS "per.day", CAST(coalesce(n, 0) AS BIGINT) AS doc_count, m AS "a.b" FROM g LEFT JOIN c ON c.t = g.t AND c.d = g.d""")  # fmt: skip
add("b_date_range", tree(events, {"b": {"date_range": {"field": "@timestamp", "ranges": [{"key": "first", "to": "2024-01-08"}, {"key": "then", "from": "2024-01-08", "to": "2024-01-20T06:00:00Z"}]}}}, "b"), """
SELECT CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 'first' ELSE 'then' END AS b, count(*) AS doc_count FROM events WHERE ts < TIMESTAMP '2024-01-20 06:00:00' GROUP BY 1""")  # fmt: skip
add("b_filter", tree(events, {"b": {"filter": {"bool": {"must": [{"term": {"event_type": "click"}}], "must_not": [{"range": {"value": {"lte": 20}}}]}}, "aggs": {"m": {"max": {"field": "value"}}}}}, "b"),
    "SELECT 'filter' AS b, count(*) AS doc_count, round(max(value), 3) AS m FROM events WHERE event_type = 'click' AND value > 20")

# date histograms


def _dh(source, field: str, spec: dict, **more) -> Callable:
    return tree(source, {"b": {"date_histogram": {"field": field, "min_doc_count": 1, **spec}}}, "b", **more)


def _trunc(unit: str, of: str, column: str) -> str:
    return f"SELECT epoch_ms(date_trunc('{unit}', {column})) AS b, count(*) AS doc_count FROM {of} GROUP BY 1"


add("b_dh_fixed_1h", _dh(events, "@timestamp", {"fixed_interval": "1h"}), _trunc("hour", "events", "ts"))
add("b_dh_fixed_90m", _dh(events, "@timestamp", {"fixed_interval": "1h30m"}), "SELECT CAST(floor(epoch_ms(ts) / 5400000) * 5400000 AS BIGINT) AS b, count(*) AS doc_count FROM events GROUP BY 1")
for _unit in ("minute", "hour", "day"):
    add(f"b_dh_{_unit}", _dh(events, "@timestamp", {"calendar_interval": _unit}), _trunc(_unit, "events", "ts"))
for _unit in ("month", "quarter", "year"):
    add(f"b_dh_{_unit}", _dh(orders, "o_orderdate", {"calendar_interval": _unit}), _trunc(_unit, "orders", "o_orderdate"))
add("b_dh_week", _dh(orders, "o_orderdate", {"calendar_interval": "1w"}), "SELECT epoch_ms(date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY) AS b, count(*) AS doc_count FROM orders GROUP BY 1")
add("b_dh_tz", _dh(events, "@timestamp", {"calendar_interval": "day", "time_zone": "+0800"}), "SELECT epoch_ms(date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR) AS b, count(*) AS doc_count FROM events GROUP BY 1")
add("b_dh_tz_wall", _dh(events, "@timestamp", {"calendar_interval": "day", "time_zone": "+08:00"}, key_mode="wall"), "SELECT epoch_ms(date_trunc('day', ts + INTERVAL 8 HOUR)) AS b, count(*) AS doc_count FROM events GROUP BY 1")
add("b_dh_extended", _dh(events, "@timestamp", {"calendar_interval": "day", "min_doc_count": 0, "extended_bounds": {"min": "2023-12-25", "max": "2024-02-05"}}), """
SELECT epoch_ms(g.d) AS b, count(event_id) AS doc_count FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS d) g LEFT JOIN events ON date_trunc('day', ts) = g.d GROUP BY 1""")  # fmt: skip
add("b_dh_hard_bounds", _dh(events, "@timestamp", {"calendar_interval": "day", "hard_bounds": {"min": "2024-01-03", "max": "2024-01-09"}}),
    "SELECT epoch_ms(date_trunc('day', ts)) AS b, count(*) AS doc_count FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09' GROUP BY 1")

# nested trees

add("n_terms_terms", tree(orders, {"a": {"terms": {"field": "o_orderstatus"}, "aggs": {"b": {"terms": {"field": "o_orderpriority", "size": 2}, "aggs": {"s": {"sum": {"field": "o_totalprice"}}}}}}}, "a", "b"), """
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS doc_count, round(sum(o_totalprice), 3) AS s FROM orders GROUP BY 1, 2)
SELECT a, b, doc_count, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY doc_count DESC, b) AS r FROM c) WHERE r <= 2""")  # fmt: skip
add("n_terms_dh_avg", tree(events, {"t": {"terms": {"field": "event_type", "size": 3}, "aggs": {"d": {"date_histogram": {"field": "@timestamp", "calendar_interval": "1d", "min_doc_count": 1}, "aggs": {"v": {"avg": {"field": "value"}}}}}}}, "t", "d"), """
WITH k AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
SELECT event_type AS t, epoch_ms(date_trunc('day', ts)) AS d, count(*) AS doc_count, round(avg(value), 3) AS v FROM events WHERE event_type IN (FROM k) GROUP BY 1, 2""")  # fmt: skip
add("n_range_metrics", tree(events, {"r": {"range": {"field": "value", "ranges": [{"key": "a", "to": 40}, {"key": "b", "from": 20}]}, "aggs": {"t": {"terms": {"field": "event_type"}, "aggs": {"m": {"min": {"field": "user_id"}}}}}}}, "r", "t"), """
SELECT k AS r, event_type AS t, count(*) AS doc_count, CAST(min(user_id) AS DOUBLE) AS m FROM (VALUES ('a', -1e18, 40), ('b', 20, 1e18)) x(k, lo, hi) JOIN events ON value >= lo AND value < hi GROUP BY 1, 2""")  # fmt: skip
add("n_filter_sum", tree(events, {"f": {"filter": {"range": {"value": {"gte": 50}}}, "aggs": {"t": {"terms": {"field": "user_id", "size": 7}, "aggs": {"s": {"sum": {"field": "value"}}}}}}}, "f", "t"),
    "SELECT 'filter' AS f, user_id AS t, count(*) AS doc_count, round(sum(value), 3) AS s FROM events WHERE value >= 50 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 7")
add("n_histogram_terms", tree(lines, {"h": {"histogram": {"field": "l_quantity", "interval": 25, "min_doc_count": 1}, "aggs": {"t": {"terms": {"field": "l_returnflag"}, "aggs": {"d": {"cardinality": {"field": "l_suppkey"}}}}}}}, "h", "t"),
    "SELECT floor(l_quantity / 25) * 25 AS h, l_returnflag AS t, count(*) AS doc_count, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1, 2")
add("n_dh_fill_per_parent", tree(events, {"t": {"terms": {"field": "event_type"}, "aggs": {"d": {"date_histogram": {"field": "@timestamp", "fixed_interval": "6h"}}}}}, "t", "d"), """
WITH c AS (SELECT event_type AS t, CAST(floor(epoch_ms(ts) / 21600000) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT t, unnest(generate_series(min(k), max(k))) AS k FROM c GROUP BY 1)
SELECT g.t, g.k * 21600000 AS d, CAST(coalesce(n, 0) AS BIGINT) AS doc_count FROM g LEFT JOIN c ON c.t = g.t AND c.k = g.k""")  # fmt: skip

# sketches: rows only

add("a_cardinality_hll", tree(lines, {"m": {"cardinality": {"field": "l_partkey"}}}, exact=False))
add("a_percentiles_approx", tree(lines, {"m": {"percentiles": {"field": "l_extendedprice", "percents": [5, 50, 95]}}}, exact=False))

# analysis


def _tokens(chain: Callable, column: str = "p_name") -> Callable:
    return lambda spark, d: parts(spark, d).select("p_partkey", F.array_join(chain(F.col(column)), "|").alias("tokens"))


def _tokens_sql(expression: str) -> str:
    return f"SELECT p_partkey, coalesce(array_to_string({expression}, '|'), '') AS tokens FROM part"


_split = text.whitespace_tokens
for _name, _chain, _sql in (
    ("x_keyword", text.keyword, "[p_name]"),
    ("x_simple", lambda c: text.simple(F.concat(c, F.lit(" No.7 X"))), "regexp_extract_all(lower(concat(p_name, ' No.7 X')), '[a-z]+')"),
    ("x_standard", lambda c: text.standard(F.concat(c, F.lit(" A-1, can't 3.5"))), "list_concat(string_split(lower(p_name), ' '), ['a', '1', 'can''t', '3.5'])"),
    ("x_stop", lambda c: text.stop(_split(F.concat(c, F.lit(" is the best"))), ("is", "the")), "list_append(string_split(p_name, ' '), 'best')"),
    ("x_length", lambda c: text.length(_split(c), 5, 6), "[x FOR x IN string_split(p_name, ' ') IF length(x) BETWEEN 5 AND 6]"),
    ("x_truncate", lambda c: text.truncate(_split(c), 3), "[left(x, 3) FOR x IN string_split(p_name, ' ')]"),
    ("x_unique", lambda c: text.unique(_split(F.concat(c, F.lit(" "), c))), "string_split(p_name, ' ')"),
    ("x_reverse", lambda c: text.reverse(_split(c)), "[reverse(x) FOR x IN string_split(p_name, ' ')]"),
    ("x_ngram", lambda c: text.ngrams(_split(c), 3, 3), "flatten([[x[i : i + 2] FOR i IN range(1, length(x) - 1)] FOR x IN string_split(p_name, ' ')])"),
    ("x_edge_ngram", lambda c: text.edge_ngrams(_split(c), 1, 3), "flatten([[left(x, i) FOR i IN range(1, 4) IF i <= length(x)] FOR x IN string_split(p_name, ' ')])"),
    ("x_shingle", lambda c: text.shingles(_split(F.concat(c, F.lit(" end"))), 2, 2), "[concat(string_split(concat(p_name, ' end'), ' ')[i], ' ', string_split(concat(p_name, ' end'), ' ')[i + 1]) FOR i IN range(1, len(string_split(concat(p_name, ' end'), ' ')))]"),
    ("x_html_strip", lambda c: _split(text.html_strip(F.concat(F.lit("<b class=x>"), c, F.lit("</b>")))), "string_split(p_name, ' ')"),
    ("x_possessive", lambda c: text.possessive(_split(F.concat(c, F.lit("'s")))), "string_split(p_name, ' ')"),
    ("x_elision", lambda c: text.elision(_split(F.concat(F.lit("l'"), c)), ("l", "d")), "string_split(p_name, ' ')"),
    ("x_web", lambda c: text.web(F.concat(c, F.lit(" the #tag a@b.example"))), "list_concat(string_split(lower(p_name), ' '), ['#tag', 'a@b.example'])"),
):
    add(_name, _tokens(_chain), _tokens_sql(_sql))
for _name, _chain in (("x_porter", text.ANALYZERS["en"]), ("x_german", text.ANALYZERS["de"]), ("x_fold", lambda c: F.array(text.ascii_fold(F.concat(c, F.lit(" éß")))))):
    add(_name, _tokens(_chain))
add("x_term_frequency", lambda spark, d: parts(spark, d).select(F.explode(text.standard(F.col("p_name"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")),
    f"SELECT term, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS term FROM part) GROUP BY 1")
add("x_highlight", lambda spark, d: parts(spark, d).select("p_partkey", F.get(highlight(F.col("p_name"), ["ring"]), F.lit(0)).alias("marked")),
    r"SELECT p_partkey, regexp_replace(p_name, '\bring\b', '<mark>ring</mark>', 'g') AS marked FROM part")

# places

add("x_geo_box", ids(places, {"geo_bounding_box": {"at": {"top_left": {"lat": 40, "lon": -20}, "bottom_right": {"lat": -10, "lon": 60}}}}), f"SELECT _id FROM {PLACES_SQL} WHERE lat BETWEEN -10 AND 40 AND lon BETWEEN -20 AND 60")
add("x_geo_box_dateline", ids(places, {"geo_bounding_box": {"at": {"top_left": {"lat": 80, "lon": 150}, "bottom_right": {"lat": -80, "lon": -150}}}}), f"SELECT _id FROM {PLACES_SQL} WHERE lat BETWEEN -80 AND 80 AND (lon >= 150 OR lon <= -150)")
add("x_geo_distance", ids(places, {"geo_distance": {"distance": "2500km", "at": {"lat": 48.0, "lon": 11.0}}}),
    f"SELECT _id FROM {PLACES_SQL} WHERE 2 * 6371000 * asin(sqrt(pow(sin(radians(48 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48)) * pow(sin(radians(11 - lon) / 2), 2))) <= 2500000")
add("x_geo_polygon", ids(places, {"geo_polygon": {"at": {"points": [{"lat": 0.5, "lon": 0.5}, {"lat": 0.5, "lon": 60.5}, {"lat": 50.5, "lon": 0.5}]}}}),
    f"SELECT _id FROM {PLACES_SQL} WHERE lat > 0.5 AND lon > 0.5 AND (lat - 0.5) / 50 + (lon - 0.5) / 60 < 1")
add("x_geo_sort", lambda spark, d: places(spark, d).select("_id", F.round(geo.haversine(F.col("at.lat"), F.col("at.lon"), F.lit(0.0), F.lit(0.0)) / 1000, 3).alias("km")).orderBy("km", "_id").limit(20),
    f"SELECT _id, round(2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(-lat) / 2), 2) + cos(radians(lat)) * pow(sin(radians(-lon) / 2), 2)))), 3) AS km FROM {PLACES_SQL} ORDER BY km, _id LIMIT 20")

# ingestion


def _shared(spark: SparkSession) -> str:
    """A folder for small demonstration indexes: the shared checkpoint folder, or on one machine a local one."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or f"file://{tempfile.mkdtemp()}"
    return f"{base.rstrip('/')}/{spark.range(1).select(F.expr('uuid()')).first()[0]}"


BULK = "\n".join(json.dumps(x) for i in range(6) for x in ({"create": {"_index": f"log-{i % 2}", "_id": str(i % 5)}}, {"@timestamp": f"2024-03-0{1 + i % 3}T00:00:00Z", "message": f"Line {i} of the log", "size": i * 10}))


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark, _shared(spark))
    engine.bulk(BULK)
    df, _ = engine.frame("log-*")
    return df.select("_index", "_id", "message", F.col("size").cast("long").alias("size"))


def _last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Nine documents of one id in a batch, then an update and a deletion by id."""
    engine = Engine(spark, _shared(spark))
    engine.ingest("log", [{"_id": "a", "v": i, "@timestamp": "2024-01-01T00:00:00Z"} for i in range(9)] + [{"_id": x, "v": 0, "@timestamp": "2024-01-02T00:00:00Z"} for x in "bcd"])
    engine.update("log", [{"_id": "b", "v": 5, "@timestamp": "2024-01-03T00:00:00Z"}, {"_id": "b", "v": 6, "@timestamp": "2024-01-03T00:00:00Z"}, {"_id": "e", "v": 7, "@timestamp": "2024-01-03T00:00:00Z"}])
    engine.delete("log", ["c"])
    return engine.frame("log")[0].select("_id", F.col("v").cast("long").alias("v"))


add("i_last_wins", _last_wins, "SELECT * FROM (VALUES ('a', 8), ('b', 6), ('d', 0), ('e', 7)) t(_id, v)")
add("i_bulk", _bulk, """SELECT * FROM (VALUES ('log-0', '0', 'Line 0 of the log', 0), ('log-0', '2', 'Line 2 of the log', 20), ('log-0', '4', 'Line 4 of the log', 40),
('log-1', '1', 'Line 1 of the log', 10), ('log-1', '3', 'Line 3 of the log', 30), ('log-1', '0', 'Line 5 of the log', 50)) t("_index", "_id", message, size)""")  # fmt: skip


def _dynamic(spark: SparkSession, d: str) -> DataFrame:
    mapping = Mapping.parse({"dynamic_templates": [{"codes": {"match": "*_code", "mapping": {"type": "keyword"}}}]})
    ingest.build(spark, [{"a_code": "x", "note": "some words", "n": 3, "ok": True, "at": "2024-01-01T00:00:00Z", "r": 1.5}], mapping)
    return spark.createDataFrame([(k, p.type) for k, p in mapping.properties.items()], "field string, kind string")


add("i_dynamic_mapping", _dynamic, "SELECT * FROM (VALUES ('_id', 'keyword'), ('@timestamp', 'date'), ('a_code', 'keyword'), ('note', 'text'), ('n', 'long'), ('ok', 'boolean'), ('at', 'date'), ('r', 'float')) t(field, kind)")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    root = _shared(spark)
    rows = events(spark, d).select("_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"), "event_type", "value")
    rows.repartition(3).write.json(f"{root}/in")
    engine = Engine(spark, f"{root}/index")
    engine.create_index("events", {"mappings": {"properties": {"event_type": {"type": "keyword"}, "value": {"type": "double"}}}})
    engine.ingest_stream("events", f"{root}/in", f"{root}/checkpoint").awaitTermination()
    return engine.query("events", {"query": {"bool": {"filter": [{"term": {"event_type": "error"}}, {"range": {"value": {"gte": 10}}}]}}}).matching().select("_id", "event_type", "value")


add("i_stream_availablenow", _stream, "SELECT CAST(event_id AS VARCHAR) AS _id, event_type, value FROM events WHERE event_type = 'error' AND value >= 10")


# the flagship

FLAGSHIP = {
    "query": {"bool": {"filter": [{"range": {"@timestamp": {"gte": "2024-01-03T00:00:00Z", "lt": "2024-01-25T00:00:00Z"}}}, {"terms": {"event_type": ["click", "error", "purchase"]}}]}},
    "aggs": {"type": {"terms": {"field": "event_type"}, "aggs": {"day": {"date_histogram": {"field": "@timestamp", "calendar_interval": "1d", "min_doc_count": 1}, "aggs": {"mean": {"avg": {"field": "value"}}, "top": {"max": {"field": "value"}}}}}}},
    "sort": [{"value": {"order": "desc"}}],
    "size": 10,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(at(search(events(spark, sf_dir), FLAGSHIP, exact=True).aggregations(), "type", "day"))


add("flagship", flagship, """SELECT event_type AS type, epoch_ms(date_trunc('day', ts)) AS day, count(*) AS doc_count, round(avg(value), 3) AS mean, round(max(value), 3) AS top FROM events
WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' AND event_type IN ('click', 'error', 'purchase') GROUP BY 1, 2""")  # fmt: skip
