"""Main text of web pages by two-pass block rules.

The first pass cuts a page into blocks and decides by link density, length and stop-word density; blocks that
this leaves open (short ones above all) inherit in the second pass from the nearest decided neighbours. The
container of a block is evidence: it moves the limits of these rules and says what counts on a page without a
block that is good by itself. Only what a reader doesn't see (the head, hidden elements) is out by its container
alone. A page is judged within its row; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.names import col

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|canvas|audio|video)\b.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^<>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|(?=<)|\Z)
      | <[!?][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article aside body details dialog div fieldset figure footer form head header html main menu nav ol section table td ul li span p".split())
VOID = frozenset("hr p li span".split())  # not kept open unless they say that they are boilerplate
BAD_TAGS = frozenset("aside dialog footer form menu nav button fieldset".split())
GOOD_TAGS = frozenset(("article", "main"))
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|"
    r"comments?|commentlist|respond|reply|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|pagination|pager|widget|toolbar|skip|legal|copyright|hidden)(?:$|[\s_-])",
    re.I,
)
LAYOUT_NAME = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|overflow)-\S*", re.I)  # says something of the page around
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ATTRIBUTE = re.compile(r"""([a-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it not of on or she that the they this to was we were which will with you "
    "als am auch auf aus bei das dem den der des die durch ein eine einer es für hat ich im ist mit nach nicht oder sich sie sind und von war wie wird zu zum zur über "
    "au aux avec ce ces dans de du elle en est et il ils la le les leur lui ne nous ou par pas plus pour que qui sa se ses son sur un une vous "
    "al como con del el ella entre era esta este fue ha hay lo los las más me mi muy no para pero por su sus también te una uno y ya "
    "che di da gli ho io ma nel non per più sono tra um uma o os as em não na nas dos das "
    "van het een niet zijn voor met dat aan te ook maar".split()
)
WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    tag: str
    label: str | None  # what the container speaks for: good, bad or nothing; or hidden
    text: str = ""
    linked: int = 0
    parts: list[str] = field(default_factory=list)


def _container(tag: str, rest: str, in_good: bool) -> str | None:
    """What an element says of the text in it."""
    names, bad, unseen = "", tag in BAD_TAGS or (tag == "header" and not in_good), tag == "head"
    if rest.strip(" /"):
        for name, a, b, c in ATTRIBUTE.findall(rest):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names += f" {value}"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                unseen = True
            elif name == "role" and value.lower() in BAD_ROLE:
                bad = True
        if tag not in ("body", "html", "main") and BAD_NAME.search(LAYOUT_NAME.sub("", names)):
            bad = True
    return "hidden" if unseen else "bad" if bad else "good" if tag in GOOD_TAGS else None


def blocks_of(html: str) -> list[Block]:
    """The page's blocks with text, in order; white space is single and references are decoded."""
    out: list[Block] = []
    open_: list[tuple[str, str | None]] = [("", None)]  # elements and the label that holds inside
    now = Block("", None)
    in_link = 0

    def close(tag: str) -> None:
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            out.append(now)
        now = Block(tag, open_[-1][1])

    def say(text: str) -> None:
        if text:
            text = unescape(text) if "&" in text else text
            now.parts.append(text)
            if in_link:
                now.linked += len("".join(text.split()))

    at = 0
    for m in MARKUP.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        if m["raw"]:
            now.parts.append(" ")
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag == "a":
            in_link = max(0, in_link + (-1 if m["end"] else 1))
        elif tag == "br":
            now.parts.append(" ")
        if tag in CONTAINERS or tag == "button":
            if m["end"]:
                k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k][0] == tag), 0)
                if k:
                    del open_[k:]
            else:
                held = open_[-1][1]
                label = _container(tag, m["rest"], held == "good")
                if tag in ("body",) and held == "hidden" and open_[-1][0] == "head":
                    del open_[1:]
                    held = None
                if held == "hidden":
                    label = "hidden"
                elif held == "bad" and label == "good" and tag == "article":
                    label = "open"  # an article in a form or an aside: neither speaks
                if not m["rest"].endswith("/") and (tag not in VOID or (label in ("bad", "hidden") and held != label)):
                    if tag == "p" and open_[-1][0] == "p":
                        open_.pop()
                    open_.append((tag, label or held))
        if tag in BLOCKS or tag == "button":
            close("" if m["end"] else tag)
            if tag in BLOCKS:
                in_link = 0
    say(html[at:])
    close("")
    return out


def first_labels(blocks: list[Block], long: int = 200, short: int = 70, stop_high: float = 0.3, stop_low: float = 0.2, most_linked: float = 0.5, least_listed: float = 0.03) -> list[str]:
    """good, bad, near or short for each block, by what it is alone; doubt for one that is good in a bad container,
    out for one without stop words in a good one, which goes alone and says nothing of its neighbours.

    In a good container half of ``stop_low``, or one stop word in a block that isn't long, is enough to be near, and
    short blocks with links stay open; in a bad one, blocks that aren't good are bad. A page whose longer blocks hold
    next to no listed stop words is in a language that isn't listed: there length and links decide.
    """
    out = []
    lists = any(b.label == "good" for b in blocks)
    spoken = [w for b in blocks if b.label != "hidden" and len(b.text) >= short and b.linked <= most_linked * len(b.text.replace(" ", "")) for w in WORDS.findall(b.text.lower())]
    listed = sum(w in STOP_WORDS for w in spoken) >= least_listed * len(spoken)
    for b in blocks:
        chars = len(b.text)
        linked = b.linked / max(1, len(b.text.replace(" ", "")))
        if b.label == "hidden" or linked > most_linked or ("©" in b.text and chars < long):
            out.append("bad")
        elif chars < short:
            out.append("bad" if b.label == "bad" or (linked > 0.2 and b.label != "good" and not lists) else "short")
        else:
            words = WORDS.findall(b.text.lower())
            stop = sum(w in STOP_WORDS for w in words) / max(1, len(words)) if listed else stop_high
            if b.label == "bad":
                out.append("doubt" if stop >= stop_high and chars > long else "bad")
            else:
                low = stop_low if b.label != "good" else stop_low / 2 if chars > long else 1e-9
                out.append(("good" if chars > long else "near") if stop >= stop_high else "near" if stop >= low else "out" if b.label == "good" else "bad")
    return out


def standing(blocks: list[Block], first: list[str], most_linked: float = 0.5) -> list[str]:
    """``first`` with good blocks on every page that has any text to keep.

    Without a block that is good by itself the nearly good ones decide, or those in bad containers where they hold
    more text; without either, what good containers hold and links don't.
    """
    if "good" not in first:
        size = {x: sum(len(b.text) for b, y in zip(blocks, first, strict=True) if x == y) for x in ("near", "doubt")}
        if size["near"] or size["doubt"]:
            up = ("near", "doubt") if size["doubt"] > size["near"] else ("near",)
            first = ["good" if x in up else x for x in first]
        else:
            plain = [b.label == "good" and b.linked <= most_linked * len(b.text.replace(" ", "")) for b in blocks]
            first = ["good" if p else x for x, p in zip(first, plain, strict=True)]
    return ["bad" if x == "doubt" else x for x in first]


def labels_of(blocks: list[Block]) -> list[bool]:
    """Whether each block is main text: open blocks take the label of the nearest decided neighbours."""
    first = standing(blocks, first_labels(blocks))
    n = len(first)
    before, after, last = [(n, "bad")] * n, [(n, "bad")] * n, None
    for i in range(n):
        if first[i] in ("good", "bad"):
            last = i
        elif last is not None:
            before[i] = (i - last, first[last])
    last = None
    for i in range(n - 1, -1, -1):
        if first[i] in ("good", "bad"):
            last = i
        elif last is not None:
            after[i] = (last - i, first[last])
    out = []
    for i, x in enumerate(first):
        if x in ("good", "bad", "out"):
            out.append(x == "good")
        elif before[i][1] == after[i][1]:
            out.append(before[i][1] == "good")
        elif x == "near" or blocks[i].label == "good" or (blocks[i].tag[:1] == "h" and after[i][1] == "good"):
            out.append(True)
        else:
            near, far = sorted((before[i], after[i]), key=lambda p: p[0])
            out.append(near[0] < far[0] and near[1] == "good")
    return out


def main_text(html: str | None) -> str:
    """Main blocks of a page joined by blank lines; empty for null and for pages without any."""
    blocks = blocks_of(html or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, labels_of(blocks), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns but the source, with ``text`` and ``n_chars`` (columns of those names are replaced).

    Null sources give an empty text; unclosed tags and comments end with the page, a quote that isn't closed is a sign
    like others; equal sources give equal texts, so repeated rows do. Pages and attributes of any length are read
    whole; other columns of any name pass through; an empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [main_text(h) for h in f[html_col]]
            yield f[kept].assign(text=pd.Series(texts, dtype=object, index=f.index), n_chars=pd.Series([len(t) for t in texts], dtype="int64", index=f.index))

    return pages.select(*map(col, [*kept, html_col])).mapInPandas(run, schema)
