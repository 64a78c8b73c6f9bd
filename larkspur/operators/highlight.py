"""Highlighting: the best fragments of a text around query words."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STYLES = {"html": ("<mark>", "</mark>"), "ansi": ("\x1b[43m", "\x1b[0m")}
WORD = regex.compile(r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*")


def fragments(text: str | None, words: frozenset[str], size: int, best: int, style: str) -> list[str]:
    """At most ``best`` fragments of ``size`` characters that don't overlap, those with most different words first."""
    if not text:
        return []
    hits = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text) if m[0].lower() in words]
    if not hits:
        return [text[:size]]
    windows = []
    for i, (start, _, _) in enumerate(hits):
        inside = [h for h in hits[i:] if h[1] <= start + size]
        room = (size - ((inside or [hits[i]])[-1][1] - start)) // 2
        low = max(0, start - max(0, room))
        windows.append((-len({h[2] for h in inside}), low, min(len(text), low + size)))
    chosen: list[tuple[int, int]] = []
    for _, low, high in sorted(windows):
        if len(chosen) < best and all(high <= a or low >= b for a, b in chosen):
            chosen.append((low, high))
    before, after = STYLES[style]
    out = []
    for low, high in chosen:
        parts, at = [], low
        for a, b, _ in hits:
            if a >= at and b <= high:
                parts += [text[at:a], before, text[a:b], after]
                at = b
        out.append(("…" if low else "") + "".join(parts) + text[at:high] + ("…" if high < len(text) else ""))
    return out


def highlight(c: Column, words: list[str], size: int = 200, best: int = 1, style: str = "html") -> Column:
    """Fragments of a text column with the words marked."""
    wanted = frozenset(w.lower() for w in words)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: fragments(t, wanted, size, best, style))

    return run(c)
