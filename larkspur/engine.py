"""The engine: names, ingestion and search in one place."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.errors import BadRequest
from larkspur.operators.search import Search
from larkspur.plans.catalog import Catalog
from larkspur.plans.mapping import Mapping, of_schema
from larkspur.sources import ingest
from larkspur.streaming import ingest as stream_ingest


def union(frames: list[tuple[str, DataFrame, Mapping]]) -> tuple[DataFrame, Mapping]:
    """All rows of several indexes with ``_index``; their mappings are merged, conflicts raise."""
    dfs = [df.withColumn("_index", F.lit(name)) for name, df, _ in frames]
    mapping = reduce(lambda a, b: a.merged(b), [m for _, _, m in frames])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs), mapping


class Engine:
    """Indexes are Parquet datasets under ``root`` or DataFrames registered as they are."""

    def __init__(self, spark: SparkSession, root: str | None = None, catalog: Catalog | None = None):
        self.spark, self.root, self.catalog = spark, root, catalog or Catalog()
        self.frames: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame, text: tuple[str, ...] = (), mapping: Mapping | None = None) -> None:
        """Makes a DataFrame searchable under a name."""
        index = self.catalog.create_index(name)
        index.mapping = mapping or of_schema(df.schema, text)
        self.frames[name] = df

    def create_index(self, name: str, body: dict | None = None) -> None:
        body = body or {}
        path = f"{self.root.rstrip('/')}/{name}" if self.root else None
        self.catalog.create_index(name, body.get("settings"), body.get("mappings"), body.get("aliases"), path)

    def _index(self, name: str):
        if name not in self.catalog.indexes:
            self.create_index(name)
        return self.catalog.indexes[name]

    def ingest(self, name: str, docs: list[dict]) -> int:
        """Appends documents; the index is made if it isn't there."""
        index = self._index(name)
        if not index.path:
            raise BadRequest(f"{name} has no path")
        ingest.append(ingest.build(self.spark, docs, index.mapping), index.path)
        return len(docs)

    def bulk(self, body: str, default_index: str | None = None) -> dict[str, int]:
        return {name: self.ingest(name, docs) for name, docs in ingest.parse_bulk(body, default_index).items()}

    def _rewritten(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the files of an index by ``change`` of its rows: written beside them, then put in their place."""
        index = self.catalog.indexes[name]
        if not index.path:
            raise BadRequest(f"{name} has no path")
        rows = self.spark.read.option("mergeSchema", "true").parquet(index.path)
        beside = f"{index.path}-{uuid.uuid4().hex}"
        change(rows).write.partitionBy("_day").parquet(beside)
        jvm = self.spark._jvm
        at, new = jvm.org.apache.hadoop.fs.Path(index.path), jvm.org.apache.hadoop.fs.Path(beside)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(at, True)
        files.rename(new, at)

    def update(self, name: str, docs: list[dict]) -> int:
        """Documents replace those of the same ``_id``; others are added."""
        index = self._index(name)
        new = ingest.build(self.spark, docs, index.mapping)
        self._rewritten(name, lambda rows: ingest.upsert(rows, new))
        return len(docs)

    def delete(self, name: str, ids: list[str]) -> None:
        """Documents of these ids go."""
        gone = self.spark.createDataFrame([(str(i),) for i in ids], "_id string")
        self._rewritten(name, lambda rows: ingest.delete_ids(rows, gone))

    def ingest_stream(self, name: str, path: str, checkpoint: str, dead: str | None = None, every: str | None = None) -> StreamingQuery:
        index = self._index(name)
        return stream_ingest.start(stream_ingest.read_json(self.spark, path, index.mapping), index.mapping, index.path, checkpoint, dead, every)

    def frame(self, expression: str, hours: float | None = None) -> tuple[DataFrame, Mapping]:
        """Rows of all indexes that an expression names; ``hours`` keeps those of the last hours only."""
        parts = []
        for i in self.catalog.resolve(expression):
            df = self.frames[i.name] if i.name in self.frames else self.spark.read.option("mergeSchema", "true").parquet(i.path)
            parts.append((i.name, df, i.mapping))
        if not parts:
            return self.spark.createDataFrame([], "_id string, _index string"), Mapping()
        df, mapping = union(parts)
        if hours is not None and "@timestamp" in df.columns:
            since = F.current_timestamp() - F.make_dt_interval(hours=F.lit(int(hours)))
            df = df.where(F.col("`@timestamp`") >= since)
        return df, mapping

    def query(self, expression: str, body: dict | None = None, **options) -> Search:
        df, mapping = self.frame(expression, options.pop("hours", None))
        most = options.pop("doc_num_limit", None)
        # Spark's limits are 32 bits wide; beyond them all documents are counted
        if most is not None and (df.limit(int(most) + 1) if most < 2**31 - 1 else df).count() > most:
            raise BadRequest(f"more than {most} documents")
        return Search(df, mapping, body or {}, **options)

    def search(self, expression: str, body: dict | None = None, typed_keys: bool = False, **options) -> dict:
        return self.query(expression, body, **options).response(typed_keys)

    def multi_search(self, requests: list[tuple[str, dict]]) -> list[dict]:
        """Responses of several requests, in order."""
        return [self.search(expression, body) for expression, body in requests]

    def add_virtual_field(self, name: str, field: str, value) -> None:
        """Gives all documents of a registered index a constant field."""
        self.frames[name] = self.frames[name].withColumn(field, F.lit(value))
        self.catalog.indexes[name].mapping = of_schema(self.frames[name].schema)

    def info(self) -> dict:
        return {"name": "larkspur", "version": {"number": "7.16.1"}, "indices": len(self.catalog.indexes)}

    def health(self) -> dict:
        return {"status": "green", "number_of_nodes": 1, "timed_out": False}

    def backup(self, expression: str, path: str) -> None:
        """Writes the rows of the named indexes as Parquet."""
        self.frame(expression)[0].write.parquet(path)
