"""Ingestion: bulk bodies and JSON batches checked against a mapping and appended as Parquet by day."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import BadRequest
from larkspur.functions import text
from larkspur.functions.dates import to_time
from larkspur.plans.mapping import Mapping, check_document

MOST_LINE = 4 << 20


def parse_bulk(body: str | Iterable[str], default_index: str | None = None) -> dict[str, list[dict]]:
    """Documents by index of a bulk body: pairs of an action line (``create`` or ``index``) and a document line."""
    lines = [x for x in (body.splitlines() if isinstance(body, str) else body) if x.strip()]
    if len(lines) % 2:
        raise BadRequest("bulk: an action without a document")
    out: dict[str, list[dict]] = {}
    for action_line, doc_line in zip(lines[::2], lines[1::2], strict=True):
        if max(len(action_line), len(doc_line)) > MOST_LINE:
            raise BadRequest("bulk: line too long")
        try:
            action, doc = json.loads(action_line), json.loads(doc_line)
        except ValueError as e:
            raise BadRequest(f"bulk: {e}") from e
        if not isinstance(action, dict) or len(action) != 1 or not isinstance(doc, dict):
            raise BadRequest("bulk: not an action and a document")
        (verb, meta), = action.items()
        if verb not in ("create", "index"):
            raise BadRequest(f"bulk: {verb} isn't supported")
        index = (meta or {}).get("_index") or default_index
        if not index:
            raise BadRequest("bulk: no index")
        if (meta or {}).get("_id") is not None:
            doc = {**doc, "_id": str(meta["_id"])}
        out.setdefault(index, []).append(doc)
    return out


def build(spark: SparkSession, docs: list[dict], mapping: Mapping, now: datetime | None = None) -> DataFrame:
    """Rows of checked documents: mapped fields, ``_id``, ``@timestamp`` and ``_source``. New fields join the mapping.

    The whole batch is refused where one document is. Of documents with one ``_id`` the last of the batch stays.
    """
    now = now or datetime.now(UTC)
    filled = [{**d, "_id": str(d.get("_id") or uuid.uuid4().hex), "@timestamp": d.get("@timestamp", now.isoformat())} for d in docs]
    added: dict = {}
    for d in filled:
        scope = Mapping({**mapping.properties, **added}, mapping.dynamic, mapping.templates)
        added |= check_document(scope, d)
    mapping.properties.update(added)
    filled = list({d["_id"]: d for d in filled}.values())
    names = list(mapping.properties)
    many = {n for d in filled for n, v in d.items() if isinstance(v, list)}

    def shown(name: str, v):
        if v is None:
            return None
        if isinstance(v, list):
            return [shown(name, x) for x in v]
        return str(v).lower() if mapping.properties[name].family == "bool" else str(v)

    raw = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n in many else T.StringType()) for n in names] + [T.StructField("_source", T.StringType())])
    rows = []
    for d in filled:
        values = [shown(n, d.get(n)) for n in names]
        values = [[v] if n in many and v is not None and not isinstance(v, list) else v for n, v in zip(names, values, strict=True)]
        rows.append((*values, json.dumps({k: v for k, v in d.items() if k != "_id"}, ensure_ascii=False)))
    return typed(spark.createDataFrame(rows, raw), mapping)


def typed(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Casts the mapped columns to their types; tokens of text fields are kept beside them, the day as partition."""
    out = []
    for f in df.schema.fields:
        p = mapping.properties.get(f.name)
        c = F.col(f"`{f.name}`")
        array = isinstance(f.dataType, T.ArrayType)
        if p is None:
            out.append(c)
        elif p.family == "date":
            kind = f.dataType.elementType.typeName() if array else f.dataType.typeName()
            out.append((times(c, kind) if array else to_time(c, kind)).alias(f.name))
        else:
            kind = p_type(p.type)
            out.append(c.cast(T.ArrayType(kind) if array else kind).alias(f.name))
        if p is not None and p.family == "text":
            t = F.flatten(F.transform(c, text.standard)) if array else text.standard(c)
            out.append(F.when(c.isNotNull(), t).alias(f"{f.name}__tokens"))
    return df.select(*out).withColumn("_day", F.to_date("`@timestamp`"))


def times(c, kind: str):
    return F.transform(c, lambda x: to_time(x, kind))


def p_type(name: str) -> T.DataType:
    return {"byte": T.ByteType(), "short": T.ShortType(), "integer": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType()}.get(name, T.StringType())


def last_of_batch(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each ``_id`` of a batch: the last by ``order``, without it the last as rows are read."""
    at = F.monotonically_increasing_id() if order is None else F.col(f"`{order}`")
    rows = df.select("_id", F.struct(*[f"`{c}`" for c in df.columns]).alias("_row"), at.alias("_at"))
    last = rows.groupBy("_id").agg(F.max_by("_row", "_at").alias("_row"))
    return last.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


def append(df: DataFrame, path: str) -> None:
    """Appends rows, a folder for each day, so that time ranges prune files."""
    df.write.mode("append").partitionBy("_day").parquet(path)


def compact(spark: SparkSession, path: str, to: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrites an index with few larger files, sorted by time within them. A day of many rows is spread over tasks."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    most = df.groupBy("_day").count().agg(F.max("count")).first()[0] or 0
    spread = F.pmod(F.xxhash64("_id"), F.lit(-(-most // rows_per_file) or 1))
    df.repartition(F.col("_day"), spread).sortWithinPartitions("_day", "`@timestamp`").write.option("maxRecordsPerFile", rows_per_file).partitionBy("_day").parquet(to)


def delete_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``_id`` isn't in ``ids``."""
    return df.join(ids.select("_id"), "_id", "left_anti")


def upsert(df: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """``new`` replaces rows of the same ``_id``; of rows of ``new`` with one ``_id`` the last by ``order`` does."""
    return delete_ids(df, new).unionByName(last_of_batch(new, order), allowMissingColumns=True)
