"""Aggregation trees.

A bucket node is one ``groupBy`` over the keys of its ancestors and its own; the metrics below it are computed
in the same pass. Children see only rows of buckets that were kept. A branch never shares an explode with
another, so overlapping ranges and multi-valued fields don't multiply their siblings' rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import BadRequest
from larkspur.functions import dates
from larkspur.operators.percentiles import percentiles
from larkspur.plans.mapping import Mapping
from larkspur.plans.query import Compiler

MARK = "\u0001"
METRICS = ("count", "value_count", "sum", "min", "max", "avg", "weighted_avg", "cardinality", "percentiles", "quantiles")
BUCKETS = ("terms", "histogram", "date_histogram", "range", "date_range", "filter")


def q(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Node:
    """One node of the tree; ``rows`` has a column for each ancestor bucket, its own key, ``doc_count`` and its metrics."""

    name: str
    kind: str
    rows: DataFrame | None
    keys: list[str] = field(default_factory=list)
    metrics: dict[str, tuple[str, dict]] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    spec: dict = field(default_factory=dict)


def kind_of(node: dict) -> tuple[str, dict]:
    kinds = [k for k in node if k in METRICS + BUCKETS]
    if len(kinds) != 1:
        raise BadRequest(f"an aggregation has one kind: {sorted(node)}")
    return kinds[0], node[kinds[0]] or {}


def children_of(node: dict) -> dict:
    return node.get("aggs") or node.get("aggregations") or {}


class Aggregator:
    """Builds the nodes of a tree over one filtered DataFrame. ``exact`` replaces sketches by exact functions."""

    def __init__(self, df: DataFrame, mapping: Mapping, exact: bool = False, key_mode: str = "instant"):
        self.df, self.mapping, self.exact, self.key_mode = df, mapping, exact, key_mode
        self.numbered: set[str] = set()  # key columns of ranges that share a name: its place stands before it

    def _field(self, df: DataFrame, name: str, families: tuple[str, ...]) -> None:
        p = self.mapping.properties.get(name)
        if not name or name not in df.columns:
            raise BadRequest(f"aggregation: no field {name}")
        if p is not None and families and p.family not in families:
            raise BadRequest(f"aggregation: {name} is {p.type}")

    # metrics

    def metric(self, df: DataFrame, kind: str, spec: dict) -> Column:
        if kind in ("count", "value_count"):
            return F.count(F.lit(1)) if not spec.get("values_only") else F.count(F.col(f"`{spec['field']}`"))
        if kind == "weighted_avg":
            if not (spec.get("value") or {}).get("field") or not (spec.get("weight") or {}).get("field"):
                raise BadRequest("weighted_avg: value and weight name fields")
            for part in ("value", "weight"):
                self._field(df, spec[part]["field"], ("numeric",))
            v, w = F.col(f"`{spec['value']['field']}`").cast("double"), F.coalesce(F.col(f"`{spec['weight']['field']}`").cast("double"), F.lit(1.0))
            return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))
        self._field(df, spec.get("field"), () if kind == "cardinality" else ("numeric",))
        c = self._value(df, spec)
        array = isinstance(df.schema[spec["field"]].dataType, T.ArrayType)
        if kind == "cardinality":
            return F.count_distinct(c) if self.exact or spec.get("exact") else F.approx_count_distinct(c, spec.get("rsd", 0.01))
        if array:
            c = F.array_distinct(F.filter(c, lambda x: x.isNotNull()))
            total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
            simple = {"sum": F.coalesce(F.sum(total), F.lit(0.0)), "min": F.min(F.array_min(c)).cast("double"), "max": F.max(F.array_max(c)).cast("double"), "avg": F.try_divide(F.sum(total), F.sum(F.size(c)))}
            if kind in simple:
                return simple[kind]
            raise BadRequest(f"{kind}: {spec['field']} has several values")
        c = c.cast("double")
        if kind == "sum":
            return F.coalesce(F.sum(c), F.lit(0.0))
        if kind in ("min", "max", "avg"):
            return {"min": F.min, "max": F.max, "avg": F.avg}[kind](c)
        return F.percentile_approx(c, F.array(*[F.lit(s) for s in self._shares(kind, spec)]), int(100 * float(spec.get("compression") or 100)))

    def _shares(self, kind: str, spec: dict) -> list[float]:
        percents = spec.get("percents") or ([1, 5, 25, 50, 75, 95, 99] if kind == "quantiles" else None)
        if not percents or not all(0 <= p <= 100 for p in percents):
            raise BadRequest("percentiles: percents from 0 to 100")
        return [p / 100 for p in percents]

    def _value(self, df: DataFrame, spec: dict) -> Column:
        """The values of a metric: those of its field, of matching documents only, with what stands for missing ones."""
        c = F.col(f"`{spec['field']}`")
        if spec.get("where"):
            c = F.when(F.coalesce(Compiler(df, self.mapping).compile(spec["where"]).predicate, F.lit(False)), c)
        if spec.get("missing") is not None:
            c = F.coalesce(c, F.lit(spec["missing"]).cast(df.schema[spec["field"]].dataType))
        return c

    def _apart(self, df: DataFrame, keys: list[str], name: str, kind: str, spec: dict) -> DataFrame | None:
        """``keys`` and a metric that needs passes of its own, so that no task gathers all values of a group; else null."""
        if kind not in ("cardinality", "percentiles", "quantiles"):
            return None
        self._field(df, spec.get("field"), () if kind == "cardinality" else ("numeric",))
        array = isinstance(df.schema[spec["field"]].dataType, T.ArrayType)
        exact = self.exact or spec.get("exact")
        if kind == "cardinality":
            if not array:
                return None
            each = df.select(*map(q, keys), F.lit(1).alias("_one"), F.explode(self._value(df, spec)).alias("_v"))
            return each.groupBy(*map(q, keys), "_one").agg((F.count_distinct("_v") if exact else F.approx_count_distinct("_v", spec.get("rsd", 0.01))).alias(name)).drop("_one")
        return percentiles(df, keys, self._value(df, spec), self._shares(kind, spec), name) if exact and not array else None

    def _counted(self, df: DataFrame, keys: list[str], metrics: dict[str, tuple[str, dict]], count: str | None) -> DataFrame:
        """A row for each group with its metrics; those computed apart are joined by the keys."""
        apart = {n: x for n, (k, s) in metrics.items() if (x := self._apart(df, keys, n, k, s)) is not None}
        plain = [self.metric(df, k, s).alias(n) for n, (k, s) in metrics.items() if n not in apart]
        plain = ([F.count(F.lit(1)).alias(count)] if count else []) + plain
        rows = df.groupBy(*map(q, keys)).agg(*(plain or [F.count(F.lit(1)).alias("_rows")]))
        empty = {n for n in apart if metrics[n][0] == "cardinality"}
        for side in apart.values():
            one = F.lit(1).alias("_one")
            rows = rows.select("*", one).join(side.select("*", one), [*keys, "_one"], "left").drop("_one")
        out = [F.coalesce(q(n), F.lit(0).cast("long")).alias(n) if n in empty else q(n) for n in metrics]
        return rows.select(*map(q, keys), *([count] if count else []), *out)

    # buckets

    def bucket(self, df: DataFrame, kind: str, spec: dict, key: str) -> DataFrame:
        """``df`` with the bucket's key; rows outside any bucket go, rows in several are repeated."""
        if kind == "filter":
            return df.where(F.coalesce(Compiler(df, self.mapping).compile(spec).predicate, F.lit(False))).withColumn(key, F.lit("filter"))
        self._field(df, spec.get("field"), {"histogram": ("numeric",), "range": ("numeric",), "date_histogram": ("date",), "date_range": ("date",)}.get(kind, ("keyword", "numeric", "bool", "date", "text")))
        if isinstance(df.schema[spec["field"]].dataType, T.ArrayType):
            value = "_value"
            df = df.withColumn(value, F.explode(F.array_distinct(F.col(f"`{spec['field']}`"))))
        else:
            value = spec["field"]
        c = F.col(f"`{value}`")
        missing = spec.get("missing")
        if missing is not None:
            c = F.coalesce(c, F.lit(missing).cast(df.schema[value].dataType))
        if kind == "terms":
            return df.where(c.isNotNull()).withColumn(key, c)
        if kind == "histogram":
            step, offset = float(spec.get("interval") or 0), float(spec.get("offset") or 0)
            if step <= 0 or offset >= step:
                raise BadRequest("histogram: interval above 0, offset below it")
            hard = spec.get("hard_bounds") or {}
            if hard:
                df = df.where(reduce(lambda a, b: a & b, [t for t in (c >= hard["min"] if "min" in hard else None, c <= hard["max"] if "max" in hard else None) if t is not None]))
            return df.where(c.isNotNull()).withColumn(key, F.floor((c - offset) / step) * step + offset)
        if kind == "date_histogram":
            hard = spec.get("hard_bounds") or {}
            t = dates.to_time(c, df.schema[value].dataType.typeName())
            if "min" in hard:
                df = df.where(t >= self._time(hard["min"]))
            if "max" in hard:
                df = df.where(t <= self._time(hard["max"]))
            return df.where(c.isNotNull()).withColumn(key, self._start(t, spec))
        return df.withColumn(key, F.explode(self._ranges(c if kind == "range" else dates.to_time(c, df.schema[value].dataType.typeName()), kind, spec)))

    def _time(self, value) -> Column:
        return dates.to_time(F.lit(value), "string" if isinstance(value, str) else "long")

    def _interval(self, spec: dict) -> tuple[str | None, int | None]:
        """The calendar unit or the fixed length; the calendar wins."""
        text = spec.get("calendar_interval") or (spec.get("interval") if spec.get("interval") in dates.CALENDAR and not spec.get("fixed_interval") else None)
        if text:
            if text not in dates.CALENDAR:
                raise BadRequest(f"calendar interval: {text}")
            return dates.CALENDAR[text], None
        fixed = spec.get("fixed_interval") or spec.get("interval")
        if not fixed:
            raise BadRequest("date_histogram: no interval")
        return None, dates.duration_micros(fixed)

    def _start(self, t: Column, spec: dict) -> Column:
        unit, micros = self._interval(spec)
        tz = dates.zone(spec.get("time_zone"))
        start = dates.calendar_bucket(t, unit, tz) if unit else dates.fixed_bucket(t, micros, tz)
        return F.from_utc_timestamp(start, tz) if self.key_mode == "wall" and tz != "UTC" else start

    def _ranges(self, c: Column, kind: str, spec: dict) -> Column:
        """Keys of all ranges [from, to) that hold a value, as an array; nulls fall into none."""
        hits = []
        for key, (_, low, high) in zip(self.range_names(kind, spec), self.range_keys(kind, spec), strict=True):
            read = F.lit if kind == "range" else self._time
            test = c.isNotNull()
            if low is not None:
                test &= c >= read(low)
            if high is not None:
                test &= c < read(high)
            hits.append(F.when(test, F.lit(key)))
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    def range_keys(self, kind: str, spec: dict) -> list[tuple[str, object, object]]:
        out = []
        for r in spec.get("ranges") or []:
            low, high = r.get("from"), r.get("to")
            show = (lambda v: "*" if v is None else str(float(v))) if kind == "range" else (lambda v: "*" if v is None else str(v))
            out.append((r.get("key") or r.get("name") or f"[{show(low)},{show(high)})", low, high))
        if not out:
            raise BadRequest(f"{kind}: no ranges")
        return out

    def range_names(self, kind: str, spec: dict) -> list[str]:
        """Keys of all ranges, with their places where two have one name."""
        names = [k for k, _, _ in self.range_keys(kind, spec)]
        return names if len(set(names)) == len(names) else [f"{i}{MARK}{k}" for i, k in enumerate(names)]

    def _named(self, rows: DataFrame) -> DataFrame:
        """``rows`` with range keys as they are shown."""
        numbered = [c for c in rows.columns if c in self.numbered]
        return rows.withColumns({c: F.regexp_replace(q(c), f"^[0-9]+{MARK}", "") for c in numbered}) if numbered else rows

    def _fill(self, counted: DataFrame, parents: list[str], key: str, kind: str, spec: dict, metrics: list[str]) -> DataFrame:
        """Adds the empty buckets: those between a parent's first and last (widened by extended bounds), or all ranges."""
        spark = counted.sparkSession
        if kind in ("range", "date_range"):
            all_names = self.range_names(kind, spec)
            names = spark.createDataFrame([(k,) for k in all_names], T.StructType([T.StructField(key, T.StringType())]))
            if parents:
                grid = counted.select(*map(q, parents)).distinct().withColumn(key, F.explode(F.array(*[F.lit(k) for k in all_names])))
            else:
                grid = names
        else:
            wide = spec.get("extended_bounds") or {}
            if kind == "histogram":
                step, offset = float(spec["interval"]), float(spec.get("offset") or 0)
                place = F.round((q(key) - offset) / step).cast("long")
                edge = lambda v: F.floor((F.lit(float(v)) - offset) / step).cast("long")
                back = lambda i: i * step + offset
                low, high = F.min(place), F.max(place)
                if "min" in wide:
                    low = F.least(low, edge(wide["min"]))
                if "max" in wide:
                    high = F.greatest(high, edge(wide["max"]))
                grid = counted.groupBy(*map(q, parents)).agg(low.alias("_low"), high.alias("_high")).where("_low is not null").select(*map(q, parents), F.explode(F.transform(F.sequence("_low", "_high"), back)).alias(key))
            else:
                unit, micros = self._interval(spec)
                tz = dates.zone(spec.get("time_zone"))
                local = (lambda c: c) if tz == "UTC" or self.key_mode == "wall" else (lambda c: F.from_utc_timestamp(c, tz))
                world = (lambda c: c) if tz == "UTC" or self.key_mode == "wall" else (lambda c: F.to_utc_timestamp(c, tz))
                low, high = F.min(local(q(key))), F.max(local(q(key)))
                if "min" in wide:
                    low = F.least(low, local(self._start(self._time(wide["min"]), spec)))
                if "max" in wide:
                    high = F.greatest(high, local(self._start(self._time(wide["max"]), spec)))
                step = F.expr({"quarter": "interval 3 month"}.get(unit, f"interval 1 {unit}") if unit else f"make_dt_interval(0, 0, 0, {micros / 1e6:.6f})")
                grid = counted.groupBy(*map(q, parents)).agg(low.alias("_low"), high.alias("_high")).where("_low is not null").select(*map(q, parents), F.explode(F.transform(F.sequence("_low", "_high", step), world)).alias(key))
        full = grid.join(counted, [*parents, key], "left")
        return full.select(*map(q, [*parents, key]), F.coalesce("doc_count", F.lit(0).cast("long")).alias("doc_count"), *map(q, metrics))

    # trees

    def run(self, tree: dict, df: DataFrame | None = None, parents: list[str] | None = None) -> list[Node]:
        df, parents = self.df if df is None else df, parents or []
        out = []
        top = {n: kind_of(x) for n, x in tree.items() if kind_of(x)[0] in METRICS} if not parents else {}
        if top:
            rows = self._counted(df, [], top, None)
            out.append(Node("", "metrics", rows, [], top))
        for name, body in tree.items():
            kind, spec = kind_of(body)
            if kind in METRICS:
                continue
            key = name
            while key in df.columns or key in parents:
                key = f"_{key}"
            inner = self.bucket(df, kind, spec, key)
            if kind in ("range", "date_range") and self.range_names(kind, spec)[0] != self.range_keys(kind, spec)[0][0]:
                self.numbered.add(key)
            below = children_of(body)
            metrics = {n: kind_of(x) for n, x in below.items() if kind_of(x)[0] in METRICS}
            counted = self._counted(inner, [*parents, key], metrics, "doc_count")
            counted = self._keep(counted, parents, key, kind, spec, list(metrics))
            nested = {n: x for n, x in below.items() if kind_of(x)[0] in BUCKETS}
            node = Node(name, kind, self._named(counted), [*parents, key], metrics, [], spec)
            if nested:
                if kind == "terms":
                    inner = inner.join(counted.select(*map(q, [*parents, key])), [*parents, key], "left_semi")
                node.children = self.run(nested, inner, [*parents, key])
            out.append(node)
        return out

    def _keep(self, counted: DataFrame, parents: list[str], key: str, kind: str, spec: dict, metrics: list[str]) -> DataFrame:
        if kind == "terms":
            size = int(spec.get("size") or 10)
            least = int(spec.get("min_doc_count") or 1)
            counted = counted.where(F.col("doc_count") >= least) if least > 1 else counted
            order = [F.desc("doc_count"), q(key).asc()]
            if not parents:
                return counted.orderBy(*order).limit(size)
            rank = F.row_number().over(Window.partitionBy(*map(q, parents)).orderBy(*order))
            return counted.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")
        if kind in ("histogram", "date_histogram"):
            least = int(spec.get("min_doc_count") or 0)
            if least == 0:
                return self._fill(counted, parents, key, kind, spec, metrics)
            return counted.where(F.col("doc_count") >= least)
        if kind in ("range", "date_range"):
            return self._fill(counted, parents, key, kind, spec, metrics)
        return counted
