"""Indexes, aliases and index templates, and the resolution of names to them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession

from larkspur.errors import BadRequest, NotFound
from larkspur.plans.mapping import Mapping, check_name, check_settings


@dataclass
class Index:
    name: str
    settings: dict
    mapping: Mapping
    path: str | None = None


@dataclass
class Catalog:
    """State of the engine's names; ``save`` and ``load`` keep it as JSON through Spark's file systems."""

    indexes: dict[str, Index] = field(default_factory=dict)
    aliases: set[tuple[str, str]] = field(default_factory=set)  # (alias, index)
    templates: dict[str, dict] = field(default_factory=dict)

    def create_index(self, name: str, settings: dict | None = None, mappings: dict | None = None, aliases: dict | None = None, path: str | None = None) -> Index:
        check_name(name)
        if name in self.indexes or any(a == name for a, _ in self.aliases):
            raise BadRequest(f"{name} exists")
        base = self.template_for(name)
        inner = (base or {}).get("template", {})
        given, own = inner.get("mappings") or {}, mappings or {}
        merged = {**given, **own, "properties": {**(given.get("properties") or {}), **(own.get("properties") or {})}, "dynamic_templates": (own.get("dynamic_templates") or []) + (given.get("dynamic_templates") or [])}
        index = Index(name, check_settings({**(inner.get("settings") or {}), **(settings or {})}), Mapping.parse(merged), path)
        self.indexes[name] = index
        for alias in {**(inner.get("aliases") or {}), **(aliases or {})}:
            self.add_alias(alias, name)
        return index

    def delete_index(self, expression: str) -> list[str]:
        names = [i.name for i in self.resolve(expression)]
        for n in names:
            del self.indexes[n]
        self.aliases = {(a, n) for a, n in self.aliases if n not in names}
        return names

    def exists(self, expression: str) -> bool:
        try:
            return bool(self.resolve(expression))
        except NotFound:
            return False

    def add_alias(self, alias: str, expression: str) -> None:
        check_name(alias)
        if alias in self.indexes:
            raise BadRequest(f"{alias} is an index")
        self.aliases |= {(alias, i.name) for i in self.resolve(expression)}

    def remove_alias(self, alias: str, expression: str = "*") -> None:
        gone = {(a, n) for a, n in self.aliases if fnmatchcase(a, alias) and fnmatchcase(n, expression)}
        if not gone:
            raise NotFound(alias)
        self.aliases -= gone

    def get_aliases(self, alias: str = "*", expression: str = "*") -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for a, n in sorted(self.aliases):
            if fnmatchcase(a, alias) and fnmatchcase(n, expression):
                out.setdefault(n, []).append(a)
        return out

    def update_aliases(self, actions: list[dict]) -> None:
        for action in actions:
            (verb, spec), = action.items()
            for alias in spec.get("aliases") or [spec["alias"]]:
                for index in spec.get("indices") or [spec["index"]]:
                    {"add": self.add_alias, "remove": self.remove_alias}[verb](alias, index)

    def put_template(self, name: str, body: dict) -> None:
        if not body.get("index_patterns"):
            raise BadRequest("template: no index_patterns")
        inner = body.get("template") or {}
        check_settings(inner.get("settings"))
        Mapping.parse(inner.get("mappings"))
        self.templates[name] = body

    def get_template(self, name: str) -> dict:
        if name not in self.templates:
            raise NotFound(name)
        return self.templates[name]

    def delete_template(self, name: str) -> None:
        self.get_template(name)
        del self.templates[name]

    def template_for(self, name: str) -> dict | None:
        """The fitting template of highest priority, of equal ones the first by name."""
        fits = [(-int(t.get("priority") or 0), n, t) for n, t in self.templates.items() if any(fnmatchcase(name, p) for p in t["index_patterns"])]
        return min(fits, key=lambda x: x[:2])[2] if fits else None

    def resolve(self, expression: str) -> list[Index]:
        """Indexes of a comma list of names, wildcards and aliases, each once, by name; a plain name must exist."""
        found: set[str] = set()
        for part in filter(None, (p.strip() for p in expression.split(","))):
            wild = any(c in part for c in "*?") or part == "_all"
            pattern = "*" if part == "_all" else part
            hits = {n for n in self.indexes if fnmatchcase(n, pattern)} | {n for a, n in self.aliases if fnmatchcase(a, pattern)}
            if not hits and not wild:
                raise NotFound(part)
            found |= hits
        return [self.indexes[n] for n in sorted(found)]

    def to_json(self) -> str:
        return json.dumps({
            "indexes": [{"name": i.name, "settings": i.settings, "mappings": i.mapping.to_dict(), "path": i.path} for i in self.indexes.values()],
            "aliases": sorted(self.aliases), "templates": self.templates,
        })

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        body = json.loads(text)
        return cls({i["name"]: Index(i["name"], i["settings"], Mapping.parse(i["mappings"]), i["path"]) for i in body["indexes"]}, {tuple(a) for a in body["aliases"]}, body["templates"])

    def save(self, spark: SparkSession, path: str) -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(self.to_json().encode()))
        out.close()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        return cls.from_json("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
