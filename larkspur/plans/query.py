"""Query clauses compiled to a predicate Column and, if wanted, a score Column.

Predicates on plain columns reach the Parquet scan; those on text test the field's tokens, from the column
``<field>__tokens`` where the index has one and else from the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import BadRequest
from larkspur.functions import geo, text
from larkspur.functions.dates import to_time
from larkspur.plans import query_string
from larkspur.plans.mapping import Mapping, Property

K1, B = 1.2, 0.75


@dataclass
class Clause:
    """``score`` builds the score Column once statistics are known; ``terms`` are the (field, term) it needs."""

    predicate: Column
    score: Callable[[dict], Column]
    terms: list[tuple[str, str]] = field(default_factory=list)


def constant(predicate: Column, value: float = 1.0) -> Clause:
    return Clause(predicate, lambda stats: F.when(predicate, F.lit(value)).otherwise(F.lit(0.0)))


def never() -> Clause:
    return constant(F.lit(False), 0.0)


class Compiler:
    """Compiles queries for one DataFrame and mapping."""

    def __init__(self, df: DataFrame, mapping: Mapping, idf: str = "standard"):
        self.df, self.mapping, self.idf = df, mapping, idf
        self.columns = {f.name: f.dataType for f in df.schema.fields}

    # fields

    def prop(self, name: str) -> Property | None:
        return self.mapping.properties.get(name) if name in self.columns else None

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def many(self, name: str) -> bool:
        return isinstance(self.columns.get(name), T.ArrayType)

    def tokens(self, name: str, analyzer: str | None = None) -> Column:
        if f"{name}__tokens" in self.columns:
            return self.column(f"{name}__tokens")
        return text.analyzer(analyzer)(self.column(name))

    def any_value(self, name: str, test: Callable[[Column], Column]) -> Column:
        """Whether a value of the field passes; false for null."""
        c = self.column(name)
        return F.coalesce(F.exists(c, test) if self.many(name) else test(c), F.lit(False)) if self.many(name) else test(c)

    def text_fields(self) -> list[str]:
        return [n for n, p in self.mapping.properties.items() if p.family == "text" and n in self.columns]

    # leaves

    def _analyzed(self, value: str, analyzer: str | None) -> list[str]:
        spark = self.df.sparkSession
        return list(spark.range(1).select(text.analyzer(analyzer)(F.lit(str(value))).alias("t")).first()["t"])

    def _word_score(self, name: str, term: str, predicate: Column, boost: float = 1.0) -> Callable[[dict], Column]:
        """BM25 of one term; a keyword counts once and has length 1."""
        is_text = self.prop(name) is not None and self.prop(name).family == "text"

        def build(stats: dict) -> Column:
            s = stats.get((name, term), {"n": 0, "docs": 0, "avg": 1.0})
            n, docs, avg = s["n"], s["docs"], s["avg"] or 1.0
            x = (docs - n) + 0.5 / (n + 0.5) if self.idf == "reference" else (docs - n + 0.5) / (n + 0.5)
            weight = F.lit(boost) * F.log(F.lit(1.0 + x))
            tf = F.size(F.filter(self.tokens(name), lambda t: t == term)).cast("double") if is_text else F.lit(1.0)
            size = F.size(self.tokens(name)).cast("double") if is_text else F.lit(1.0)
            norm = 1.0 / (K1 * ((1 - B) + B * size / F.lit(float(avg))))
            return F.when(predicate, weight - weight / (1 + tf * norm)).otherwise(F.lit(0.0))

        return build

    def term(self, name: str, value, boost: float = 1.0) -> Clause:
        p = self.prop(name)
        if p is None:
            return never()
        if p.family == "text":
            predicate = F.coalesce(F.array_contains(self.tokens(name), str(value)), F.lit(False))
        elif p.family == "date":
            predicate = self.any_value(name, lambda c: c == self._instant(name, value))
        elif p.family == "bool":
            predicate = self.any_value(name, lambda c: c == F.lit(str(value).lower() == "true"))
        else:
            predicate = self.any_value(name, lambda c: c == F.lit(value))
        if p.family in ("text", "keyword"):
            return Clause(predicate, self._word_score(name, str(value), predicate, boost), [(name, str(value))])
        return constant(predicate, boost)

    def terms(self, name: str, values: list) -> Clause:
        p = self.prop(name)
        kinds = {isinstance(v, str) for v in values}
        if any(isinstance(v, bool) for v in values) and p is not None and p.family != "bool":
            raise BadRequest("terms: booleans on a field that is none")
        if len(kinds) > 1:
            raise BadRequest("terms: strings and numbers together")
        if p is None or not values:
            return never()
        if p.family == "text":
            return constant(F.coalesce(F.arrays_overlap(self.tokens(name), F.array(*[F.lit(str(v)) for v in values])), F.lit(False)))
        if p.family == "date":
            return constant(self.any_value(name, lambda c: reduce(lambda a, b: a | b, [c == self._instant(name, v) for v in values])))
        return constant(self.any_value(name, lambda c: c.isin(*values)))

    def _instant(self, name: str, value) -> Column:
        kind = "string" if isinstance(value, str) else "long"
        t = to_time(F.lit(value), kind)
        own = self.columns[name].elementType if self.many(name) else self.columns[name]
        return t.cast("timestamp_ntz") if isinstance(own, T.TimestampNTZType) else t

    def range(self, name: str, body: dict) -> Clause:
        p = self.prop(name)
        if p is None:
            raise BadRequest(f"range: no field {name}")
        bounds = {k: v for k, v in body.items() if k in ("gt", "gte", "lt", "lte") and v is not None}
        if body.get("from") is not None:
            bounds["gte" if body.get("include_lower", True) else "gt"] = body["from"]
        if body.get("to") is not None:
            bounds["lte" if body.get("include_upper", True) else "lt"] = body["to"]
        read = (lambda v: self._instant(name, v)) if p.family == "date" else F.lit
        compare = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
        test = lambda c: reduce(lambda a, b: a & b, [compare[k](c, read(v)) for k, v in bounds.items()], F.lit(True) if not bounds else c.isNotNull())
        if p.family == "text":
            return constant(F.coalesce(F.exists(self.tokens(name), test), F.lit(False)))
        predicate = self.any_value(name, test)
        if name == "@timestamp" and "_day" in self.columns and not self.many(name):
            for k, v in bounds.items():  # what follows for the day prunes partitions
                day = F.to_date(self._instant(name, v))
                predicate &= F.col("_day") >= day if k in ("gt", "gte") else F.col("_day") <= day
        return constant(predicate)

    def _each_term(self, name: str, test: Callable[[Column], Column]) -> Clause:
        p = self.prop(name)
        if p is None:
            return never()
        if p.family == "text":
            return constant(F.coalesce(F.exists(self.tokens(name), test), F.lit(False)))
        return constant(F.coalesce(self.any_value(name, lambda c: test(c.cast("string"))), F.lit(False)))

    def fuzzy(self, name: str, word: str, edits: int, prefix: int = 0, boost: float = 1.0) -> Clause:
        """Terms within ``edits`` edits, a swap of neighbours being one.

        A distance with swaps is the plain one to the word or to a word with swaps in it, so it needs no UDF.
        """
        if not 0 <= edits <= 2:
            raise BadRequest(f"fuzziness: {edits}")
        p = self.prop(name)
        if p is None:
            return never()
        swaps = lambda w: [w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1) if w[i] != w[i + 1]]
        once = swaps(word) if edits else []
        twice = [word[:i] + word[i + 1] + word[i] + word[i + 2 : j] + word[j + 1] + word[j] + word[j + 2 :] for i in range(len(word) - 1) for j in range(i + 2, len(word) - 1)] if edits == 2 else []

        def distance(t: Column) -> Column:
            plain = F.levenshtein(t, F.lit(word), edits)
            out = F.when(plain >= 0, plain)
            out = F.least(out, F.when(t.isin(*once), F.lit(1))) if once else out
            if edits == 2:
                for w in once:
                    d = F.levenshtein(t, F.lit(w), 1)
                    out = F.least(out, F.when(d >= 0, d + 1))
                out = F.least(out, F.when(t.isin(*twice), F.lit(2))) if twice else out
            return F.when(F.startswith(t, F.lit(word[:prefix])), out) if prefix else out

        if p.family == "text":
            close = F.filter(self.tokens(name), lambda t: distance(t).isNotNull())
            predicate = F.coalesce(F.size(close) > 0, F.lit(False))
            near = F.array_min(F.transform(close, lambda t: 1 - distance(t) / F.least(F.length(t), F.lit(len(word)))))
        else:
            c = self.column(name)
            predicate = F.coalesce(self.any_value(name, lambda x: distance(x).isNotNull()), F.lit(False))
            near = F.lit(1.0) if self.many(name) else 1 - distance(c) / F.least(F.length(c), F.lit(len(word)))
        return Clause(predicate, lambda stats: F.when(predicate, F.greatest(near, F.lit(0.0)) * boost).otherwise(F.lit(0.0)))

    def match(self, name: str, body) -> Clause:
        body = body if isinstance(body, dict) else {"query": body}
        p = self.prop(name)
        if p is None:
            return never()
        if p.family not in ("text", "keyword"):
            return self.term(name, body["query"])
        words = self._analyzed(body["query"], "keyword" if p.family == "keyword" else body.get("analyzer"))
        if not words:
            return never()
        edits = int(body.get("fuzziness") or 0)
        parts = [self.fuzzy(name, w, edits, int(body.get("prefix_length") or 0)) if edits else self.term(name, w) for w in dict.fromkeys(words)]
        return self._all(parts) if str(body.get("operator", "or")).lower() == "and" else self._any(parts)

    def phrase(self, name: str, slots: list[list[str]], slop: int = 0) -> Clause:
        """Words at consecutive places; each slot may hold several words; ``slop`` is the sum of all shifts."""
        p = self.prop(name)
        if p is None or not slots:
            return never()
        if p.family == "keyword":
            return self.term(name, " ".join(s[0] for s in slots))
        tokens = self.tokens(name)
        at = lambda words: F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(*words), i)), lambda i: i.isNotNull())
        if slop == 0:
            shifted = lambda k: F.transform(at(slots[k]), lambda i: i - k)
            starts = reduce(F.array_intersect, [shifted(k) for k in range(len(slots))])
            found = F.size(starts)
        else:
            # a place holds one word, so only slots that share words can meet at one; else states of one place and cost are one
            apart = len({w for s in slots for w in s}) == sum(len(set(s)) for s in slots)
            paths = F.transform(at(slots[0]), lambda i: F.struct(i.alias("at"), F.lit(0).alias("cost"), F.array(F.lit(-1) if apart else i).alias("used")))

            def step(places: Column) -> Callable[[Column], Column]:
                def go(s: Column) -> Column:
                    free = F.filter(places, lambda q: (F.abs(q - s["at"] - 1) + s["cost"] <= slop) & ~F.array_contains(s["used"], q))
                    return F.transform(free, lambda q: F.struct(q.alias("at"), (s["cost"] + F.abs(q - s["at"] - 1)).alias("cost"), (s["used"] if apart else F.concat(s["used"], F.array(q))).alias("used")))

                return go

            for words in slots[1:]:
                paths = F.array_distinct(F.flatten(F.transform(paths, step(at(words)))))
            found = F.size(paths)
        predicate = F.coalesce(found > 0, F.lit(False))
        words = [w[0] for w in slots]

        def build(stats: dict) -> Column:
            parts = [self._word_score(name, w, predicate)(stats) for w in words]
            return reduce(lambda a, b: a + b, parts)

        return Clause(predicate, build, [(name, w) for w in words])

    # combinations

    def _any(self, parts: list[Clause], least: int = 1) -> Clause:
        if not parts:
            return never()
        if least <= 1:
            predicate = reduce(lambda a, b: a | b, [p.predicate for p in parts])
        else:
            predicate = reduce(lambda a, b: a + b, [F.coalesce(p.predicate, F.lit(False)).cast("int") for p in parts]) >= least
        return Clause(predicate, lambda stats: reduce(lambda a, b: a + b, [p.score(stats) for p in parts]), [t for p in parts for t in p.terms])

    def _all(self, parts: list[Clause]) -> Clause:
        predicate = reduce(lambda a, b: a & b, [p.predicate for p in parts])
        return Clause(predicate, lambda stats: reduce(lambda a, b: a + b, [p.score(stats) for p in parts]), [t for p in parts for t in p.terms])

    def boolean(self, body: dict) -> Clause:
        groups = {k: [self.compile(q) for q in ([body[k]] if isinstance(body.get(k), dict) else body.get(k) or [])] for k in ("must", "filter", "should", "must_not")}
        must, filters, should, without = (groups[k] for k in ("must", "filter", "should", "must_not"))
        wanted = body.get("minimum_should_match")
        if isinstance(wanted, str) and wanted.endswith("%"):
            wanted = len(should) * int(wanted[:-1]) // 100
        least = int(wanted) if wanted is not None else (0 if must or filters else 1)
        if least > len(should) and (should or wanted is not None):
            return never()
        predicates = [c.predicate for c in must + filters]
        if should and least > 0:
            predicates.append(self._any(should, least).predicate)
        predicates += [~F.coalesce(c.predicate, F.lit(False)) for c in without]
        predicate = reduce(lambda a, b: a & b, predicates) if predicates else F.lit(True)
        scored = must + should

        def build(stats: dict) -> Column:
            if not scored:
                return F.when(predicate, F.lit(0.0 if filters else 1.0)).otherwise(F.lit(0.0))
            return F.when(predicate, reduce(lambda a, b: a + b, [F.coalesce(c.score(stats), F.lit(0.0)) for c in scored])).otherwise(F.lit(0.0))

        return Clause(predicate, build, [t for c in scored for t in c.terms])

    def compile(self, query: dict | None) -> Clause:
        """A query of one clause; an empty one matches all."""
        query = {k: v for k, v in (query or {}).items() if v is not None}
        if not query:
            return constant(F.lit(True))
        if len(query) > 1:
            raise BadRequest(f"one clause a query: {sorted(query)}")
        (kind, body), = query.items()
        if kind == "match_all":
            return constant(F.lit(True), float((body or {}).get("boost", 1.0)))
        if kind == "match_none":
            return never()
        if kind == "bool":
            return self.boolean(body)
        if kind == "boosted":
            inner = self.compile(body["query"])
            return Clause(inner.predicate, lambda stats: inner.score(stats) * body["boost"], inner.terms)
        if kind == "ids":
            return constant(self.column("_id").isin(*[str(v) for v in body.get("values", [])])) if "_id" in self.columns and body.get("values") else never()
        if kind == "exists":
            return constant(self.column(body["field"]).isNotNull()) if body["field"] in self.columns else never()
        if kind == "query_string":
            default = [body["default_field"]] if body.get("default_field") else body.get("fields") or self.text_fields()
            return self.compile(query_string.parse(body["query"], default or ["_all"], body.get("analyzer")))
        if kind in ("geo_bounding_box", "geo_distance", "geo_polygon"):
            return constant(F.coalesce(self._geo(kind, body), F.lit(False)))
        if not isinstance(body, dict) or not body:
            raise BadRequest(f"{kind}: no field")
        body = {k: v for k, v in body.items() if k != "boost"}
        if kind == "range":
            return self._all([self.range(f, b) for f, b in body.items()])
        if len(body) != 1:
            raise BadRequest(f"{kind}: one field")
        (name, value), = body.items()
        spec = value if isinstance(value, dict) else {"value": value, "query": value}
        if kind == "term":
            return self.term(name, spec["value"])
        if kind == "terms":
            return self.terms(name, value)
        if kind == "match":
            return self.match(name, value)
        if kind == "match_phrase":
            return self.phrase(name, [[w] for w in self._analyzed(spec["query"], spec.get("analyzer"))], int(spec.get("slop") or 0))
        if kind == "multi_phrase":
            return self.phrase(name, spec["terms"] if "terms" in spec else value, int(spec.get("slop") or 0))
        if kind == "prefix":
            return self._each_term(name, lambda t: F.startswith(t, F.lit(str(spec["value"]))))
        if kind == "wildcard":
            pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\\(.)", r"\1", str(spec["value"])))
            start = re.match(r"[^*?]*", str(spec["value"]))[0]
            return self._each_term(name, lambda t: F.startswith(t, F.lit(start)) & t.rlike(f"^(?s:{pattern})$"))
        if kind == "regexp":
            return self._each_term(name, lambda t: t.rlike(f"^(?:{spec['value']})$"))
        if kind == "fuzzy":
            return self.fuzzy(name, str(spec["value"]), int(spec.get("fuzziness", 1)), int(spec.get("prefix_length", 0)))
        raise BadRequest(f"unknown clause: {kind}")

    def _geo(self, kind: str, body: dict) -> Column:
        (name, spec), = ((k, v) for k, v in body.items() if k not in ("distance", "unit"))
        lat, lon = self.column(name)["lat"], self.column(name)["lon"]
        if name not in self.columns:
            return F.lit(False)
        if kind == "geo_bounding_box":
            a, b = spec["top_left"], spec["bottom_right"]
            return geo.in_box(lat, lon, a["lat"], a["lon"], b["lat"], b["lon"])
        if kind == "geo_distance":
            return geo.within(lat, lon, spec["lat"], spec["lon"], geo.metres(body["distance"]))
        return geo.in_polygon(lat, lon, [(p["lat"], p["lon"]) for p in spec["points"]])


def statistics(compiler: Compiler, terms: list[tuple[str, str]]) -> dict:
    """Documents with each term, documents with the field and mean length, in one aggregation."""
    if not terms:
        return {}
    asked = list(dict.fromkeys(terms))
    fields = list(dict.fromkeys(f for f, _ in asked))
    aggs = []
    for i, f in enumerate(fields):
        p = compiler.prop(f)
        size = F.size(compiler.tokens(f)) if p and p.family == "text" else F.lit(1)
        aggs += [F.count(compiler.column(f)).alias(f"d{i}"), F.avg(F.when(compiler.column(f).isNotNull(), size)).alias(f"a{i}")]
    aggs += [F.coalesce(F.sum(F.coalesce(compiler.term(f, t).predicate, F.lit(False)).cast("int")), F.lit(0)).alias(f"n{i}") for i, (f, t) in enumerate(asked)]
    row = compiler.df.agg(*aggs).first()
    return {(f, t): {"n": row[f"n{i}"], "docs": row[f"d{fields.index(f)}"], "avg": row[f"a{fields.index(f)}"]} for i, (f, t) in enumerate(asked)}
