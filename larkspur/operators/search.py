"""Search: filter, score, sort, page and aggregate; responses in the protocol's shape."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import BadRequest
from larkspur.functions import geo
from larkspur.operators.aggs import Aggregator, Node
from larkspur.plans.mapping import Mapping
from larkspur.plans.query import Compiler, statistics

TYPED = {"terms": "sterms", "count": "value_count", "range": "range", "percentiles": "tdigest_percentiles", "quantiles": "tdigest_percentiles"}


@dataclass
class Search:
    """A request over one resolved DataFrame. ``size`` 0 returns no hits."""

    df: DataFrame
    mapping: Mapping
    body: dict
    idf: str = "standard"
    exact: bool = False

    def __post_init__(self):
        self.compiler = Compiler(self.df, self.mapping, self.idf)
        self.clause = self.compiler.compile(self.body.get("query"))

    def matching(self) -> DataFrame:
        return self.df.where(self.clause.predicate)

    def scored(self) -> DataFrame:
        """Matching rows with ``_score``."""
        stats = statistics(self.compiler, self.clause.terms)
        return self.matching().withColumn("_score", self.clause.score(stats))

    def explain(self) -> DataFrame:
        """Scored rows with ``_explanation``: each scoring term's statistics and its own score."""
        stats = statistics(self.compiler, self.clause.terms)
        parts = [
            F.struct(F.lit(f).alias("field"), F.lit(t).alias("term"), F.lit(s["n"]).cast("long").alias("n"), F.lit(s["docs"]).cast("long").alias("docs"), F.lit(float(s["avg"] or 0)).alias("avg_length"), self.compiler.term(f, t).score(stats).alias("score"))
            for (f, t), s in stats.items()
        ]
        return self.scored().withColumn("_explanation", F.array(*parts) if parts else F.lit(None))

    def order(self) -> list[tuple[str, bool, bool]]:
        """(column, ascending, nulls first) of the sort; score and id by default. The id parts ties."""
        out = []
        given = self.body.get("sort") or []
        for entry in [given] if isinstance(given, (str, dict)) else given:
            if isinstance(entry, str):
                name = entry.lstrip("+-")
                out.append((name, not entry.startswith("-") and (name != "_score" or entry.startswith("+")), False))
                continue
            for name, spec in entry.items():
                if name == "_geo_distance":
                    out.append((self._distance_column(spec), spec.get("order", "asc") == "asc", False))
                    continue
                spec = {"order": spec} if isinstance(spec, str) else spec or {}
                how = spec.get("order", "desc" if name == "_score" else "asc")
                if how not in ("asc", "desc"):
                    raise BadRequest(f"sort order: {how}")
                out.append((name, how == "asc", spec.get("missing", "_last") == "_first"))
        out = out or [("_score", False, False)]
        for name, _, _ in out:
            if name not in self.df.columns and name != "_score":
                raise BadRequest(f"sort: no field {name}")
        if "_id" in self.df.columns and all(n != "_id" for n, _, _ in out):
            out.append(("_id", True, False))
        return out

    def _distance_column(self, spec: dict) -> str:
        """Adds the distance in metres from a point as a column to sort by."""
        (name, point), = ((k, v) for k, v in spec.items() if k not in ("order", "unit"))
        column = f"_distance_{name}"
        if column not in self.df.columns:
            c = F.col(f"`{name}`")
            self.df = self.df.withColumn(column, geo.haversine(c["lat"], c["lon"], F.lit(float(point["lat"])), F.lit(float(point["lon"]))))
        return column

    def _after(self, order: list[tuple[str, bool, bool]], values: list) -> Column:
        """Rows behind ``values`` in the sort, which hold no nulls."""
        tests = []
        for i, (name, up, first) in enumerate(order[: len(values)]):
            same = [F.col(f"`{n}`") == F.lit(v) for (n, _, _), v in zip(order[:i], values[:i], strict=False)]
            c = F.col(f"`{name}`")
            past = c > F.lit(values[i]) if up else c < F.lit(values[i])
            tests.append(reduce(lambda a, b: a & b, same, past if first else past | c.isNull()))
        return reduce(lambda a, b: a | b, tests)

    def hits(self) -> DataFrame:
        """The page of rows asked for, in order. Scores are computed only where they are used."""
        order = self.order()
        rows = self.scored() if any(n == "_score" for n, _, _ in order) or self.body.get("track_scores") else self.matching().withColumn("_score", F.lit(None).cast("double"))
        if self.body.get("search_after"):
            rows = rows.where(self._after(order, self.body["search_after"]))
        ways = {(True, True): "asc_nulls_first", (True, False): "asc_nulls_last", (False, True): "desc_nulls_first", (False, False): "desc_nulls_last"}
        rows = rows.orderBy(*[getattr(F.col(f"`{n}`"), ways[up, first])() for n, up, first in order])
        start, size = int(self.body.get("from") or 0), self.body.get("size", 10)
        return (rows.offset(start) if start else rows).limit(int(10 if size is None else size))

    def total(self) -> int:
        return self.matching().count()

    def aggregations(self) -> list[Node]:
        tree = self.body.get("aggs") or self.body.get("aggregations") or {}
        return Aggregator(self.matching(), self.mapping, self.exact).run(tree) if tree else []

    def response(self, typed_keys: bool = False) -> dict:
        began = time.time()
        nodes = self.aggregations()
        out = [r.asDict(recursive=True) for r in self.hits().collect()]
        scores = [r["_score"] for r in out if r["_score"] is not None]
        body = {
            "took": 0, "timed_out": False,
            "hits": {"total": {"value": self.total(), "relation": "eq"}, "max_score": max(scores, default=0.0), "hits": [_hit(r) for r in out]},
        }
        if nodes:
            body["aggregations"] = respond(nodes, typed_keys)
        body["took"] = round(1000 * (time.time() - began))
        return body


def _plain(v):
    if isinstance(v, datetime):
        return int(v.replace(tzinfo=v.tzinfo or UTC).timestamp() * 1000)
    if isinstance(v, float) and (math.isnan(v) or math.isinf(v)):
        return None
    return v


def _hit(row: dict) -> dict:
    source = row.get("_source")
    if source is None:
        source = {k: v for k, v in row.items() if not k.startswith("_") and not k.endswith("__tokens")}
    elif isinstance(source, str):
        source = json.loads(source)
    return {"_index": row.get("_index"), "_id": row.get("_id"), "_score": row.get("_score"), "_type": "_doc", "_source": source}


def _metric(kind: str, spec: dict, value) -> dict:
    if kind in ("percentiles", "quantiles"):
        return {"values": {f"{float(p):g}" if not float(p).is_integer() else f"{int(p)}": _plain(v) for p, v in zip(spec.get("percents") or [1, 5, 25, 50, 75, 95, 99], value or [None] * 99, strict=False)}}
    return {"value": _plain(value)}


def _title(name: str, kind: str, typed: bool) -> str:
    return f"{TYPED.get(kind, kind)}#{name}" if typed else name


def respond(nodes: list[Node], typed: bool = False, within: tuple = ()) -> dict:
    """The nested response; a node's rows are its kept buckets."""
    found = {id(n): [r.asDict() for r in n.rows.collect()] for n in _walk(nodes)}

    def level(nodes: list[Node], path: tuple) -> dict:
        out = {}
        for n in nodes:
            rows = found[id(n)]
            if n.kind == "metrics":
                for m, (kind, spec) in n.metrics.items():
                    out[_title(m, kind, typed)] = _metric(kind, spec, rows[0][m])
                continue
            own = [r for r in rows if tuple(r[k] for k in n.keys[:-1]) == path]
            buckets = []
            for r in sorted(own, key=lambda r: (-r["doc_count"], str(r[n.keys[-1]])) if n.kind == "terms" else (0, r[n.keys[-1]])):
                key = _plain(r[n.keys[-1]])
                b = {"key": key, "doc_count": r["doc_count"]} | {_title(m, k, typed): _metric(k, s, r[m]) for m, (k, s) in n.metrics.items()}
                buckets.append(b | level(n.children, path + (r[n.keys[-1]],)))
            if n.kind == "filter":
                out[_title(n.name, n.kind, typed)] = {k: v for k, v in (buckets[0] if buckets else {"doc_count": 0}).items() if k != "key"}
            else:
                keyed = n.spec.get("keyed")
                out[_title(n.name, n.kind, typed)] = {"buckets": {str(b["key"]): b for b in buckets} if keyed else buckets}
        return out

    return level(nodes, within)


def _walk(nodes: list[Node]):
    for n in nodes:
        yield n
        yield from _walk(n.children)
