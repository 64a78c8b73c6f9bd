"""The query-string language: ``field:term``, quotes, ``+`` and ``-``, AND/OR/NOT, groups, ranges, wildcards,
``/regex/``, ``~n`` (fuzzy or slop) and ``^n`` (boost). It gives a query of the JSON language."""

from __future__ import annotations

import re

from larkspur.errors import BadRequest

TOKEN = re.compile(
    r"""\s+ | (?P<op>\(|\)|\+|-(?=\S)|&&|\|\||!) | (?P<word>AND|OR|NOT)(?=[\s()]|$)
      | (?:(?P<field>[\w@.*]+):)? (?: "(?P<phrase>(?:[^"\\]|\\.)*)" | /(?P<regex>(?:[^/\\]|\\.)+)/ | (?P<open>[\[{])(?P<low>\S+)\s+TO\s+(?P<high>[^\s\]}]+)(?P<close>[\]}])
      | (?P<cmp>>=|<=|>|<)(?P<bound>[^\s()]+) | (?P<group>\() | (?P<term>(?:[^\s()"^~\\]|\\.)+) ) (?:~(?P<near>\d*))? (?:\^(?P<boost>[\d.]+))?""",
    re.X,
)


def _value(text: str):
    try:
        return float(text) if re.fullmatch(r"-?\d+(?:\.\d+)?", text) else text
    except ValueError:
        return text


def _leaf(m: re.Match, default: list[str], analyzer: str | None) -> dict:
    fields = [m["field"]] if m["field"] else default
    plain = lambda s: re.sub(r"\\(.)", r"\1", s)

    def one(f: str) -> dict:
        if m["phrase"] is not None:
            return {"match_phrase": {f: {"query": plain(m["phrase"]), "slop": int(m["near"] or 0), "analyzer": analyzer}}}
        if m["regex"] is not None:
            return {"regexp": {f: m["regex"]}}
        if m["low"] is not None:
            body = {}
            if m["low"] != "*":
                body["gte" if m["open"] == "[" else "gt"] = _value(m["low"])
            if m["high"] != "*":
                body["lte" if m["close"] == "]" else "lt"] = _value(m["high"])
            return {"range": {f: body}}
        if m["cmp"]:
            return {"range": {f: {{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[m["cmp"]]: _value(m["bound"])}}}
        term = m["term"]
        if term == "*":
            return {"exists": {"field": f}}
        if re.search(r"(?<!\\)[*?]", term):
            return {"wildcard": {f: term}}
        if m["near"] is not None:
            return {"match": {f: {"query": plain(term), "fuzziness": int(m["near"] or 1), "analyzer": analyzer}}}
        return {"match": {f: {"query": plain(term), "analyzer": analyzer}}}

    body = one(fields[0]) if len(fields) == 1 else {"bool": {"should": [one(f) for f in fields]}}
    return {"boosted": {"query": body, "boost": float(m["boost"])}} if m["boost"] else body


def parse(text: str, default: list[str], analyzer: str | None = None) -> dict:
    """Clauses without an operator are optional; ``AND`` makes both sides required."""
    found, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise BadRequest(f"query string, place {at}: {text!r}")
        at = m.end()
        if m[0].strip():
            found.append(m)
    place = 0

    def group(until: bool) -> dict:
        nonlocal place
        must, should, must_not, mark, last = [], [], [], "", None
        while place < len(found):
            m = found[place]
            place += 1
            if m["op"] == ")" and until:
                break
            if m["op"] in ("+", "-", "!") or m["word"] == "NOT":
                mark = "-" if m["op"] != "+" else "+"
                continue
            if m["word"] == "AND" or m["op"] == "&&":
                if last is not None and last in should:
                    should.remove(last)
                    must.append(last)
                mark = "+"
                continue
            if m["word"] == "OR" or m["op"] == "||":
                continue
            if m["op"] == ")":
                raise BadRequest(f"query string: {text!r}")
            last = group(True) if m["op"] == "(" or m["group"] else _leaf(m, default, analyzer)
            (must if mark == "+" else must_not if mark == "-" else should).append(last)
            mark = ""
        if len(should) == 1 and not must and not must_not:
            return should[0]
        body = {k: v for k, v in (("must", must), ("should", should), ("must_not", must_not)) if v}
        return {"bool": body} if body else {"match_none": {}}

    return group(False)
