"""Mapping, names, clauses, aggregation trees, ingestion and responses on small literals."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.errors import BadRequest, NotFound
from larkspur.functions import dates, geo, languages, text
from larkspur.operators.aggs import Aggregator
from larkspur.operators.highlight import fragments
from larkspur.operators.search import Search
from larkspur.plans import mapping as M
from larkspur.plans.catalog import Catalog
from larkspur.plans.query_string import parse
from larkspur.sources import ingest

DOCS = [
    {"_id": "1", "@timestamp": "2024-01-01T00:00:00Z", "name": "a", "desc": "The quick brown fox", "stars": 10, "lang": "go"},
    {"_id": "2", "@timestamp": "2024-01-02T10:00:00Z", "name": "b", "desc": "quick quick dog", "stars": 250, "lang": "C++"},
    {"_id": "3", "@timestamp": "2024-01-02T12:00:00Z", "name": "c", "desc": "a lazy dog sleeps, the fox too", "stars": 30, "lang": ""},
    {"_id": "4", "@timestamp": "2024-01-09T00:00:00Z", "name": "d", "desc": None, "stars": None, "lang": "go"},
]
PROPS = {"name": {"type": "keyword"}, "desc": {"type": "text"}, "stars": {"type": "integer"}, "lang": {"type": "keyword"}}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('index')}")
    e.create_index("repos", {"mappings": {"dynamic": "false", "properties": PROPS}})
    e.ingest("repos", DOCS)
    return e


def found(engine, query):
    return sorted(h["_id"] for h in engine.search("repos", {"query": query, "size": 100})["hits"]["hits"])


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ({}, "1234"),
        ({"match": {"desc": "QUICK fox"}}, "123"),
        ({"match": {"desc": {"query": "quick fox", "operator": "AND"}}}, "1"),
        ({"match": {"desc": {"query": "qiuck", "fuzziness": 1}}}, "12"),
        ({"match": {"desc": {"query": "qiuck", "fuzziness": 1, "prefix_length": 2}}}, ""),
        ({"match": {"desc": "..."}}, ""),
        ({"match_phrase": {"desc": "brown fox"}}, "1"),
        ({"match_phrase": {"desc": {"query": "quick fox", "slop": 1}}}, "1"),
        ({"match_phrase": {"desc": {"query": "quick quick", "slop": 0}}}, "2"),
        ({"match_phrase": {"desc": {"query": "fox fox", "slop": 9}}}, ""),
        ({"term": {"desc": "Quick"}}, ""),
        ({"term": {"lang": ""}}, "3"),
        ({"terms": {"lang": ["go", "C++"]}}, "124"),
        ({"terms": {"lang": []}}, ""),
        ({"range": {"stars": {"gt": 10, "lte": 250}}}, "23"),
        ({"range": {"@timestamp": {"gte": "2024-01-02", "lt": 1704240000}}}, "23"),
        ({"ids": {"values": ["2", "9"]}}, "2"),
        ({"bool": {"must_not": [{"range": {"stars": {"gte": 30}}}]}}, "14"),
        ({"bool": {"should": [{"term": {"lang": "go"}}, {"term": {"stars": 10}}], "minimum_should_match": 2}}, "1"),
        ({"bool": {"should": [{"term": {"lang": "go"}}], "minimum_should_match": 2}}, ""),
        ({"query_string": {"query": "desc:(fox OR dog) -lang:go"}}, "23"),
        ({"query_string": {"query": '"lazy dog"'}}, "3"),
        ({"query_string": {"query": "stars:[20 TO *]"}}, "23"),
        ({"term": {"nothing": 1}}, ""),
    ],
)
def test_clauses(engine, query, ids):
    assert "".join(found(engine, query)) == ids


def test_bad_requests(engine):
    for query in ({"range": {"nothing": {"gt": 1}}}, {"what": {}}, {"match_all": {}, "ids": {}}, {"match": {"desc": {"query": "x", "fuzziness": 3}}}, {"terms": {"lang": ["a", 1]}}):
        with pytest.raises(BadRequest):
            found(engine, query)
    with pytest.raises(NotFound):
        engine.search("missing", {})


def test_document_limits_of_any_width(engine):
    for most in (4, 2**31 - 2, 2**31 - 1, 1 << 40):
        assert engine.query("repos", {}, doc_num_limit=most).matching().count() == 4
    with pytest.raises(BadRequest):
        engine.query("repos", {}, doc_num_limit=3)


def test_scores_order_and_pages(engine):
    hits = engine.search("repos", {"query": {"match": {"desc": "quick"}}})["hits"]
    assert [h["_id"] for h in hits["hits"]] == ["2", "1"] and hits["max_score"] == hits["hits"][0]["_score"] > 0
    page = {"sort": [{"stars": {"order": "desc"}}], "from": 1, "size": 2}
    assert [h["_id"] for h in engine.search("repos", page)["hits"]["hits"]] == ["3", "1"]
    first = {"sort": [{"stars": {"order": "asc", "missing": "_first"}}]}
    assert [h["_id"] for h in engine.search("repos", first)["hits"]["hits"]] == ["4", "1", "3", "2"]
    assert engine.search("repos", {"size": 0})["hits"] == {"total": {"value": 4, "relation": "eq"}, "max_score": 0.0, "hits": []}
    assert engine.search("repos", {"size": 1, "query": {"ids": {"values": ["2"]}}})["hits"]["hits"][0]["_source"]["stars"] == 250


def test_aggregation_response(engine):
    body = {"size": 0, "aggs": {"l": {"terms": {"field": "lang", "size": 2}, "aggs": {"s": {"sum": {"field": "stars"}}, "d": {"date_histogram": {"field": "@timestamp", "calendar_interval": "week"}}}}, "m": {"max": {"field": "stars"}}}}
    out = engine.search("repos", body)["aggregations"]
    assert out["m"] == {"value": 250.0}
    assert [(b["key"], b["doc_count"], b["s"]["value"]) for b in out["l"]["buckets"]] == [("go", 2, 10.0), ("", 1, 30.0)]
    assert [b["doc_count"] for b in out["l"]["buckets"][0]["d"]["buckets"]] == [1, 1]
    assert "sterms#l" in engine.search("repos", body, typed_keys=True)["aggregations"]


def test_days_are_pruned(engine):
    df = engine.query("repos", {"query": {"range": {"@timestamp": {"gte": "2024-01-02", "lt": "2024-01-03"}}}}).matching()
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_day" in scan and df.count() == 2


def test_explanation_and_virtual_fields(engine, spark):
    row = engine.query("repos", {"query": {"match": {"desc": "dog"}}}).explain().where("_id = '2'").first()
    assert row["_explanation"][0]["n"] == 2 and abs(row["_explanation"][0]["score"] - row["_score"]) < 1e-12
    e = Engine(spark)
    e.register("t", spark.createDataFrame([("1", (10.0, 20.0), 1.0), ("2", (0.0, 0.0), None)], "_id string, at struct<lat: double, lon: double>, x double"))
    e.add_virtual_field("t", "kind", "k")
    near = {"query": {"term": {"kind": "k"}}, "sort": [{"_geo_distance": {"at": {"lat": 0, "lon": 1}, "order": "asc"}}]}
    assert [h["_id"] for h in e.multi_search([("t", near)])[0]["hits"]["hits"]] == ["2", "1"]
    aggs = {"a": {"avg": {"field": "x", "missing": 3.0}}, "w": {"sum": {"field": "x", "where": {"ids": {"values": ["1"]}}}}}
    out = e.search("t", {"size": 0, "aggs": aggs})["aggregations"]
    assert out["a"]["value"] == 2.0 and out["w"]["value"] == 1.0


def test_bounds_and_gaps(spark):
    df = spark.createDataFrame([(1.0,), (2.5,), (31.0,), (None,)], "x double")
    m = M.of_schema(df.schema)
    rows = lambda spec: sorted((r["h"], r["doc_count"]) for r in Aggregator(df, m).run({"h": {"histogram": {"field": "x", **spec}}})[0].rows.collect())
    assert rows({"interval": 10}) == [(0.0, 2), (10.0, 0), (20.0, 0), (30.0, 1)]
    assert rows({"interval": 10, "min_doc_count": 2}) == [(0.0, 2)]
    assert rows({"interval": 10, "extended_bounds": {"min": -5, "max": 44}})[0::5] == [(-10.0, 0), (40.0, 0)]
    for bad in ({"interval": 0}, {"interval": 5, "offset": 5}):
        with pytest.raises(BadRequest):
            rows(bad)


def test_arrays_count_distinct_values_once(spark):
    df = spark.createDataFrame([(["a", "b", "a"], [1, 1, 2]), (["b"], None)], "t array<string>, n array<int>")
    out = Aggregator(df, M.of_schema(df.schema)).run({"t": {"terms": {"field": "t"}}, "s": {"sum": {"field": "n"}}})
    assert out[0].rows.first()["s"] == 3.0 and [tuple(r) for r in out[1].rows.collect()] == [("b", 2), ("a", 1)]
    assert Search(df, M.of_schema(df.schema), {"query": {"term": {"t": "a"}}}).total() == 1


def evaluate(query, doc):
    (kind, body), = query.items()
    if kind == "term":
        (f, v), = body.items()
        return doc[f] == v
    if kind == "range":
        (f, b), = body.items()
        return doc[f] is not None and b["gte"] <= doc[f] < b["lt"]
    hit = lambda name: [evaluate(q, doc) for q in body.get(name, [])]
    need = body.get("minimum_should_match", 0 if body.get("must") or body.get("filter") else 1)
    should = not body.get("should") or sum(hit("should")) >= need
    return all(hit("must")) and all(hit("filter")) and not any(hit("must_not")) and should


def test_random_bool_trees(spark):
    rng = random.Random(3)
    docs = [{"_id": str(i), "k": rng.choice(["a", "b", None]), "n": rng.choice([None, *range(5)])} for i in range(60)]
    df = spark.createDataFrame([(d["_id"], d["k"], d["n"]) for d in docs], "_id string, k string, n int").cache()

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            low = rng.randrange(4)
            return rng.choice([{"term": {"k": rng.choice("abc")}}, {"range": {"n": {"gte": low, "lt": low + 2}}}])
        body = {g: [tree(depth - 1) for _ in range(rng.randrange(3))] for g in ("must", "filter", "should", "must_not")}
        body = {g: q for g, q in body.items() if q}
        if len(body.get("should", [])) == 2 and rng.random() < 0.5:
            body["minimum_should_match"] = 2
        return {"bool": body}

    for _ in range(25):
        q = tree(2)
        got = {r[0] for r in Search(df, M.of_schema(df.schema), {"query": q}).matching().select("_id").collect()}
        assert got == {d["_id"] for d in docs if evaluate(q, d)}, q


def test_mapping_rules():
    m = M.Mapping.parse({"properties": {"D": {"type": "dAtE"}}})
    assert m.properties["D"].type == "date"
    for bad in ({"properties": {"x": {"type": "string"}}}, {"properties": {"_id": {"type": "long"}}}, {"dynamic_templates": [{"t": {"match": "*"}}]}):
        with pytest.raises(BadRequest):
            M.Mapping.parse(bad)
    added = M.check_document(M.Mapping.parse({}), {"s": "words", "d": "2023-01-26T00:00:40.000Z", "i": 3, "f": 1.5, "b": True})
    assert {k: p.type for k, p in added.items()} == {"s": "text", "d": "date", "i": "long", "f": "float", "b": "boolean"}
    with pytest.raises(BadRequest):
        M.check_document(M.Mapping.parse({"dynamic": "strict"}), {"s": 1})
    assert M.check_document(M.Mapping.parse({"dynamic": "false"}), {"s": 1}) == {}
    for bad in ("", "A", "a b", "_a", "a*"):
        with pytest.raises(BadRequest):
            M.check_name(bad)
    assert M.check_settings({"index.number_of_shards": "3"})["number_of_shards"] == 3
    with pytest.raises(BadRequest):
        M.check_settings({"number_of_shards": 101})


def test_catalog(spark, tmp_path):
    c = Catalog()
    c.put_template("low", {"index_patterns": ["log-*"], "priority": 1, "template": {"mappings": {"properties": {"a": {"type": "text"}}}}})
    c.put_template("high", {"index_patterns": ["log-*"], "priority": 5, "template": {"mappings": {"properties": {"a": {"type": "keyword"}}}, "aliases": {"logs": {}}}})
    c.create_index("log-1", mappings={"properties": {"b": {"type": "long"}}})
    c.create_index("other")
    assert {k: p.type for k, p in c.indexes["log-1"].mapping.properties.items()} == {"a": "keyword", "b": "long", "_id": "keyword", "@timestamp": "date"}
    assert [i.name for i in c.resolve("logs,oth*")] == ["log-1", "other"]
    c.update_aliases([{"add": {"index": "other", "alias": "x"}}, {"remove": {"index": "log-*", "alias": "logs"}}])
    assert c.get_aliases() == {"other": ["x"]}
    c.save(spark, f"file://{tmp_path}/catalog.json")
    again = Catalog.load(spark, f"file://{tmp_path}/catalog.json")
    assert again.to_json() == c.to_json() and c.delete_index("log-*") == ["log-1"] and not c.exists("log-1")


def test_bulk(spark, tmp_path):
    body = '{"create":{"_index":"l","_id":"1"}}\n{"m":"x"}\n{"index":{}}\n{"m":"y"}\n'
    assert {k: len(v) for k, v in ingest.parse_bulk(body, "d").items()} == {"l": 1, "d": 1}
    for bad in ('{"delete":{"_index":"l"}}\n{}\n', '{"create":{}}\n{"a":1}\n', "{}\n", '{"create":{"_index":"a"}}\n[1]\n'):
        with pytest.raises(BadRequest):
            ingest.parse_bulk(bad)


def test_dates(spark):
    values = ["1704067200", "1704067200000", "1704067200000000", "1704067200000000000", "2024-01-01T08:00:00+08:00", "2024-01-01", "nope", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(dates.to_time(F.col("v"), "string").alias("t"))
    assert [r[0] for r in df.collect()] == [datetime(2024, 1, 1)] * 6 + [None] * 2
    assert dates.duration_micros("1h30m") == 5_400_000_000 and dates.zone("+0530") == "+05:30"
    with pytest.raises(ValueError):
        dates.duration_micros("soon")


def test_analysis(spark):
    def run(chain, value):
        return spark.range(1).select(chain(F.lit(value)).alias("t")).first()["t"]

    assert run(text.standard, "Can't stop: 3.5 A-1 漢字 x😀y") == ["can't", "stop", "3.5", "a", "1", "漢", "字", "x", "y"]
    assert run(text.web, "See https://a.example/x?y=1. @me #tag a@b.example the") == ["see", "https://a.example/x?y=1", "@me", "#tag", "a@b.example"]
    assert run(lambda c: text.ngrams(F.array(c), 1, 2), "abc") == ["a", "ab", "b", "bc", "c"]
    assert run(lambda c: text.edge_ngrams(F.array(c), 1, 2, True), "abc") == ["c", "bc"]
    assert run(lambda c: text.shingles(text.whitespace_tokens(c), 2, 3, originals=True), "a b c") == ["a", "a b", "a b c", "b", "b c", "c"]
    assert run(lambda c: text.camel_case(F.array(c)), "aBC12HTMLPage") == ["a", "BC", "12", "HTML", "Page"]
    assert run(lambda c: text.cjk_bigrams(c), "漢字仮 ab") == ["漢字", "字仮", "ab"]
    assert run(text.ANALYZERS["en"], "The dog's running quickly") == ["dog", "run", "quickli"]
    assert [languages.porter(w) for w in "caresses ponies relational hopping agreed sky rational controlling".split()] == ["caress", "poni", "relat", "hop", "agre", "sky", "ration", "control"]
    assert run(lambda c: F.array(text.ascii_fold(c)), "Straße Œuvre é") == ["Strasse OEuvre e"]


def test_query_string_grammar():
    assert parse("a:b", []) == {"match": {"a": {"query": "b", "analyzer": None}}}
    both = parse("x AND NOT y", ["f"])["bool"]
    assert len(both["must"]) == 1 and len(both["must_not"]) == 1
    assert parse("f:[1 TO 5}", [])["range"]["f"] == {"gte": 1.0, "lt": 5.0}
    assert parse("f:te*t", []) == {"wildcard": {"f": "te*t"}}
    with pytest.raises(BadRequest):
        parse('f:"open', [])


FULL_LISTS = {
    "ar": (119, "ومن كما إلي لها"),
    "bg": (190, "аз е могат пък"),
    "ca": (218, "abans eh meu semblants"),
    "ckb": (62, "ی ئەوان تێ لەلایەن"),
    "cs": (171, "u kterou tento které"),
    "da": (94, "have anden alt sit"),
    "de": (231, "allem diesen jeder seines"),
    "el": (75, "τησ ωσ ποιοσ αυτεσ"),
    "en": (174, "i them ought once"),
    "es": (308, "sí estéis habríamos fuera"),
    "eu": (98, "bati eurak hauek horrela"),
    "fa": (308, "انان اورد ديگران براي"),
    "fi": (229, "olen meidät tuona keneltä"),
    "fr": (164, "c serions eue eûtes"),
    "ga": (109, "aon dtí leis seisear"),
    "gl": (160, "aínda dela iso polo"),
    "hi": (225, "अत उस जब न"),
    "hu": (198, "akik egyik legalább ő"),
    "hy": (45, "էինք հետո նաև որոնք"),
    "id": (355, "adanya demikianlah lalu tersebut"),
    "it": (279, "allo quante sia facevi"),
    "nl": (101, "worden eens kunnen wil"),
    "no": (172, "ikkje både ho mykje"),
    "pt": (203, "à aquelas hajam será"),
    "ro": (230, "acei câte înaintea pot"),
    "ru": (159, "меня раз кажется них"),
    "sv": (114, "hennes mitt sådant sådana"),
    "tr": (209, "altmış dolayısıyla kırk seksen"),
}


def test_whole_stop_lists(spark):
    assert {k: len(v) for k, v in languages.STOP.items()} == {k: n for k, (n, _) in FULL_LISTS.items()}
    chains = spark.range(1).select(*[text.ANALYZERS[k](F.lit(f"{words} qqqq")).alias(k) for k, (_, words) in FULL_LISTS.items()]).first()
    assert {k: len(v) for k, v in chains.asDict().items()} == dict.fromkeys(FULL_LISTS, 1)
    more = {"web": "I my we you he she them", "en": "I'm ours yourselves", "fa": "که این برای", "ckb": "كه", "el": "της από"}
    row = spark.range(1).select(*[text.ANALYZERS[k](F.lit(v)).alias(k) for k, v in more.items()]).first()
    assert row.asDict() == {k: [] for k in more}


def test_geo():
    assert geo.metres("2 km") == 2000 and geo.metres(5) == 5
    south, west, north, east = geo.geohash_box("u4pruyd")
    assert south <= 57.64911 <= north and west <= 10.40744 <= east


def test_highlight():
    assert fragments("one two three", frozenset({"two"}), 200, 1, "html") == ["one <mark>two</mark> three"]
    long = "x " * 200 + "needle " + "y " * 200
    (part,) = fragments(long, frozenset({"needle"}), 50, 1, "html")
    assert "<mark>needle</mark>" in part and len(part) < 80


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"_id": str(i % 3), "name": f"n{i}"}) for i in range(5)] + ["{broken"]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    e = Engine(spark, f"file://{tmp_path}/index")
    e.create_index("s", {"mappings": {"properties": {"name": {"type": "keyword"}}}})
    e.ingest_stream("s", f"file://{tmp_path}/in", f"file://{tmp_path}/cp", f"file://{tmp_path}/dead").awaitTermination()
    df, _ = e.frame("s")
    assert {(r["_id"], r["name"]) for r in df.select("_id", "name").collect()} == {("0", "n3"), ("1", "n4"), ("2", "n2")}
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/dead").collect()] == ["{broken"]


def test_compaction_spreads_a_day_and_keeps_all_rows(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/i")
    for k in range(3):
        engine.ingest("log", [{"_id": f"{k}-{i}", "v": i, "@timestamp": f"2024-01-0{1 + i % 2}T00:00:00Z"} for i in range(10)])
    ingest.compact(spark, f"file://{tmp_path}/i/log", f"file://{tmp_path}/c", rows_per_file=6)
    got = spark.read.parquet(f"file://{tmp_path}/c")
    assert {(r["_id"], r["v"]) for r in got.collect()} == {(f"{k}-{i}", i) for k in range(3) for i in range(10)} and got.count() == 30
    assert max(r["count"] for r in got.groupBy(F.input_file_name()).count().collect()) <= 6
