"""URL rules whose block decisions spread over redirects and canonical links, in SQL functions only.

Urls are nodes, redirects and canonical links are edges. A url that an own rule decides keeps that verdict:
an explicit allow is never overruled. A url without a rule is blocked when its connected component holds a
blocked url; otherwise it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.components import connected_components
from larkspur.llm.names import col
from larkspur.llm.storage import stage

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _lower(x: Column) -> Column:
    """A-Z only."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query; all empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    bare = F.regexp_extract(rest, r"^[^#]*", 0)
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), F.regexp_extract(bare, r"\?.*$", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equal rules the first given holds."""
    rule = verdict = F.when(F.lit(False), "")
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        rule, verdict = rule.when(fits, text), verdict.when(fits, says)
    return rule, verdict


def _decoded(link: Column) -> Column:
    """Character references in an attribute's value: numbers, and the five names that urls need."""
    codes = F.array_distinct(F.regexp_extract_all(link, F.lit(r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(1)))

    def put(text: Column, code: Column) -> Column:
        number = F.when(F.lower(F.left(code, F.lit(1))) == "x", F.conv(F.substr(code, F.lit(2)), 16, 10)).otherwise(code).cast("long")
        sign = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), F.replace(text, F.concat(F.lit("&#"), code, F.lit(";")), sign)).otherwise(text)

    out = F.aggregate(codes, link, put)
    for name, sign in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def plain_path(path: Column) -> Column:
    """A path without dot segments; an empty one is ``/``."""
    steps = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    ends = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise("")
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.lit("/"), F.array_join(kept, "/"), ends)).when(path == "", "/").otherwise(path)


def node_of(host: Column, path: Column, query: Column) -> Column:
    """Names a url in the graph: without scheme, fragment and dot segments; empty without a host."""
    return F.when(host == "", "").otherwise(F.concat(host, plain_path(path), query))


def resolve(host: Column, path: Column, link: Column) -> Column:
    """The node that a link of a page leads to; null for none, for the page's own fragments and for other schemes."""
    bare = F.regexp_extract(F.trim(_decoded(link)), r"^[^#]*", 0)
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    full = F.when(F.startswith(bare, F.lit("//")), F.concat(F.lit("http:"), bare)).otherwise(bare)
    there, there_path, there_query = split_url(full)
    own_path, own_query = F.regexp_extract(bare, r"^[^?]*", 0), F.regexp_extract(bare, r"\?.*$", 0)
    return (
        F.when(bare.isNull() | (bare == ""), None)
        .when(F.startswith(bare, F.lit("//")) | scheme.isin("http", "https"), F.when(there != "", node_of(there, there_path, there_query)))
        .when(scheme != "", None)
        .when(F.startswith(bare, F.lit("/")), node_of(host, own_path, own_query))
        .when(own_path == "", node_of(host, path, own_query))
        .otherwise(node_of(host, F.concat(F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^.*/", 0)), own_path), own_query))
    )


def page_links(html: Column) -> Column:
    """Targets of all canonical links and of all redirects (meta refresh) in a page's source, comments apart."""
    seen = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
    links = F.regexp_extract_all(seen, F.lit(r"""(?i)<link\b(?:[^>"']|"[^"]*"|'[^']*')*+>"""), F.lit(0))
    canonical = F.filter(links, lambda x: x.rlike(r"""(?i)\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""))
    metas = F.regexp_extract_all(seen, F.lit(r"""(?i)<meta\b(?:[^>"']|"[^"]*"|'[^']*')*+>"""), F.lit(0))
    refresh = F.filter(metas, lambda x: x.rlike(r"""(?i)\shttp-equiv\s*=\s*["']?refresh["'\s/>]"""))
    first = lambda x, pattern: F.concat(*[F.regexp_extract(x, pattern, k) for k in (1, 2, 3)])
    to = F.transform(refresh, lambda x: F.regexp_extract(first(x, r"(?i)\scontent" + value), r"""(?i)^[^;,]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1))
    return F.array_distinct(F.concat(F.transform(canonical, lambda x: first(x, r"(?i)\shref" + value)), to))


def edges_of_pages(pages: DataFrame) -> DataFrame:
    """``(u, v)``: nodes of page urls and of what their redirects and canonical links name.

    Null sources and urls without a host give none; repeated rows and links give an edge once. Sources of any length
    are read whole.
    """
    host, path, query = split_url(F.col("url"))
    there = pages.where(F.col("html").isNotNull() & F.col("html").rlike("(?i)canonical|refresh")).select(host.alias("h"), path.alias("p"), query.alias("q"), page_links(F.col("html")).alias("links"))
    there = there.where("h != ''")
    out = there.select(node_of(F.col("h"), F.col("p"), F.col("q")).alias("u"), F.explode(F.transform("links", lambda x: resolve(F.col("h"), F.col("p"), x))).alias("v"))
    return out.where("v is not null and u != v").distinct()


def judge(pages: DataFrame, edges: DataFrame, rules=RULES, id_col: str = "page_id") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``pages``; ``edges`` link nodes ``(u, v)``.

    A null url or one without ``://`` has an empty host and path, fits no rule, is no node and is allowed.
    In the graph, not in rules, an empty path is ``/``. Repeated rows are judged alike. Without edges the own rules decide alone. Columns of other names are not read;
    an empty table gives an empty one.
    """
    host, path, query = split_url(F.col("url"))
    rows = pages.select(col(id_col).alias(id_col), host.alias("host"), path.alias("path"), node_of(host, path, query).alias("node"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "own": verdict})
    parts = connected_components(edges)
    node_host = F.regexp_extract("node", r"^[^/?]*", 0)
    node_path = F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)
    parts = stage(parts.withColumn("own", rule_of(node_host, node_path, rules)[1]), "aliases")
    bad = parts.where("own = 'block'").select("component").distinct()
    aliases = parts.where("own is null or own = 'block'").join(bad, "component", "left_semi").select("node", F.lit("block").alias("spread"))
    return rows.join(aliases, "node", "left").select(id_col, "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """``judge`` with the edges that the pages' own sources name."""
    return judge(pages.select("page_id", "url"), edges_of_pages(pages.select("url", "html")), rules)
