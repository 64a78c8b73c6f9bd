"""Field types, mappings, dynamic fields and their Spark schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import types as T

from larkspur.errors import BadRequest

NUMERIC = {"byte": T.ByteType(), "short": T.ShortType(), "integer": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}
KEYWORD, TEXT, BOOL, DATE = ("keyword", "constant_keyword"), ("text", "match_only_text"), ("bool", "boolean"), ("date",)
SPARK_TYPES: dict[str, T.DataType] = NUMERIC | dict.fromkeys(KEYWORD + TEXT, T.StringType()) | dict.fromkeys(BOOL, T.BooleanType()) | {"date": T.TimestampType()}
RESERVED = {"_id": "keyword", "@timestamp": "date"}
DATE_TEXT = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?")


@dataclass
class Property:
    type: str
    dynamic: str | None = None

    @property
    def family(self) -> str:
        t = self.type
        return "numeric" if t in NUMERIC else "keyword" if t in KEYWORD else "text" if t in TEXT else "bool" if t in BOOL else "date"


@dataclass
class Mapping:
    """``dynamic``: true (new fields are added), false (kept in the source only) or strict (an error)."""

    properties: dict[str, Property] = field(default_factory=dict)
    dynamic: str = "true"
    templates: list[dict] = field(default_factory=list)

    @classmethod
    def parse(cls, body: dict | None) -> Mapping:
        body = body or {}
        out = cls({}, str(body.get("dynamic", "true")).lower(), [])
        if out.dynamic not in ("true", "false", "strict"):
            raise BadRequest(f"dynamic: {out.dynamic}")
        for name, spec in (body.get("properties") or {}).items():
            out.properties[name] = Property(known_type(spec.get("type", "")) if spec.get("type") or name not in RESERVED else RESERVED[name], spec.get("dynamic"))
        for name, kind in RESERVED.items():
            if out.properties.setdefault(name, Property(kind, "strict")).type != kind:
                raise BadRequest(f"{name} must be {kind}")
        for entry in body.get("dynamic_templates") or []:
            for name, t in entry.items():
                if not (t.get("mapping") or {}).get("type"):
                    raise BadRequest(f"dynamic template {name} has no mapping type")
                known_type(t["mapping"]["type"])
                out.templates.append({"name": name, **t})
        return out

    def to_dict(self) -> dict:
        return {
            "dynamic": self.dynamic,
            "properties": {k: {"type": p.type} | ({"dynamic": p.dynamic} if p.dynamic else {}) for k, p in self.properties.items()},
            "dynamic_templates": [{t["name"]: {k: v for k, v in t.items() if k != "name"}} for t in self.templates],
        }

    def merged(self, other: Mapping) -> Mapping:
        """Fields of both; a field with two families is an error."""
        out = Mapping(dict(self.properties), self.dynamic, self.templates + other.templates)
        for name, p in other.properties.items():
            if name in out.properties and out.properties[name].family != p.family:
                raise BadRequest(f"field {name} is {out.properties[name].type} in one index and {p.type} in another")
            out.properties.setdefault(name, p)
        return out

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK_TYPES[p.type], True, {"mapping_type": p.type}) for n, p in self.properties.items()])


def known_type(name: str) -> str:
    low = str(name).lower()
    if low not in SPARK_TYPES:
        raise BadRequest(f"unknown type: {name}")
    return low


def of_schema(schema: T.StructType, text: tuple[str, ...] = ()) -> Mapping:
    """The mapping of a DataFrame's schema: strings are keywords unless named in ``text``."""
    props = {}
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.StringType):
            props[f.name] = Property(f.metadata.get("mapping_type", "text" if f.name in text else "keyword"))
        elif isinstance(kind, T.BooleanType):
            props[f.name] = Property("boolean")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            props[f.name] = Property("date")
        elif isinstance(kind, T.NumericType):
            props[f.name] = Property("double" if isinstance(kind, (T.DoubleType, T.DecimalType)) else "float" if isinstance(kind, T.FloatType) else "long")
    return Mapping(props, "false")


def deduce(value) -> str:
    """The type of a value whose field the mapping lacks."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long"
    if isinstance(value, float):
        return "long" if value.is_integer() else "float"
    if isinstance(value, str):
        return "date" if DATE_TEXT.fullmatch(value) else "text"
    raise BadRequest(f"can't deduce a type for {type(value).__name__}")


def _name_fits(pattern: str, name: str) -> bool:
    return fnmatchcase(name, pattern) or (not re.search(r"[*?]", pattern) and pattern == name) or (pattern.startswith("^") and re.search(pattern, name) is not None)


def template_type(templates: list[dict], name: str, value) -> str | None:
    """The type that the first fitting template gives a new field."""
    kind = deduce(value)
    for t in templates:
        wanted = t.get("match_mapping_type")
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        by_kind = wanted in (None, "*", kind) or (wanted == "string" and isinstance(value, str) and kind == "text") or (wanted == "double" and number) or (wanted == "long" and number and float(value).is_integer())
        if by_kind and ("match" not in t or _name_fits(t["match"], name)) and not ("unmatch" in t and _name_fits(t["unmatch"], name)):
            return known_type(t["mapping"]["type"])
    return None


def _valid(p: Property, value) -> bool:
    if value is None:
        return True
    if isinstance(value, list):
        return all(_valid(p, v) for v in value)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if p.family == "numeric":
        return number
    if p.family == "bool":
        return isinstance(value, bool) or value in ("true", "false")
    if p.family == "date":
        return (number and value >= 0) or (isinstance(value, str) and bool(DATE_TEXT.fullmatch(value) or re.fullmatch(r"\d{1,19}", value)))
    return isinstance(value, str)


def check_document(mapping: Mapping, doc: dict) -> dict[str, Property]:
    """Checks a document and returns the fields that it adds to the mapping; raises where the mapping forbids it."""
    added: dict[str, Property] = {}
    for name, value in doc.items():
        p = mapping.properties.get(name) or added.get(name)
        if p is None:
            if mapping.dynamic == "strict":
                raise BadRequest(f"field {name} is not in the mapping")
            if mapping.dynamic == "false" or value is None:
                continue
            one = next((v for v in value if v is not None), None) if isinstance(value, list) else value
            if one is None:
                continue
            p = added[name] = Property(template_type(mapping.templates, name, one) or deduce(one))
        if not _valid(p, value):
            if p.dynamic == "false":
                continue
            raise BadRequest(f"field {name}: {value!r} is no {p.type}")
    return added


def check_name(name: str) -> None:
    if not name or name != name.lower() or len(name) > 255 or re.search(r'[\\/*?"<>| ,#:]', name) or name[0] in "._" or name[-1] in "._":
        raise BadRequest(f"index name: {name!r}")


def check_settings(settings: dict | None) -> dict:
    """Shards (1 to 100) and replicas (1 to 5), with or without ``index.`` before their names."""
    given = settings or {}
    given = {**given, **(given.get("index") or {})} if isinstance(given.get("index"), dict) else given
    out = {}
    for name, most in (("number_of_shards", 100), ("number_of_replicas", 5)):
        value = given.get(name, given.get(f"index.{name}", 1))
        if not str(value).isdigit() or not 1 <= int(value) <= most:
            raise BadRequest(f"{name}: {value}")
        out[name] = int(value)
    return out
