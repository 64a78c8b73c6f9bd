"""Normal forms of letters in some scripts, as tables of characters.

The tables are fixed values: which letters count as one in a script is convention, not logic.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "ـًٌٍَُِّْ"  # tatweel and the signs of vowels

#: script: letters, what they become one by one, and letters that go
TABLES = {
    "arabic": ("آأإىة", "اااي" + "ه", MARKS),
    "persian": ("یےکۀہ", "ييكهه", "ٔ"),
    "hindi": (
        "ँऩऱऴक़ख़ग़ज़ड़ढ़फ़य़ॅॆॉॊऍऎऑऒॲआईऊॠॡऐऔीूॄॣैौ",
        "ंनरळकखगजडढफयेेोोएएओओअअइउऋऌएओिुृॢेो",
        "़‍‌्",
    ),
}
DEAD_N = ("न्", "ं")  # goes before the table of Hindi, which drops the second sign


def _by_table(c: Column, name: str) -> Column:
    letters, become, gone = TABLES[name]
    return F.translate(c, letters + gone, become)


def arabic(c: Column) -> Column:
    """One alef, yeh and heh; no tatweel, no signs of vowels."""
    return _by_table(c, "arabic")


def persian(c: Column) -> Column:
    """Arabic forms, then those of yeh, kaf and heh that Persian writes otherwise."""
    return _by_table(arabic(c), "persian")


def sorani(c: Column) -> Column:
    """Letters as Sorani writes them; heh before a zero-width non-joiner and at the end is the vowel."""
    for pattern, by in (("[يى]", "ی"), ("ك", "ک"), ("ه‌|ه$|ة", "ە"), ("ھ", "ه"), ("^ر|ڒ", "ڕ"), (f"[{MARKS}\\p{{Cf}}]", "")):
        c = F.regexp_replace(c, pattern, by)
    return c


def hindi(c: Column) -> Column:
    """Short vowels for long ones, plain letters for those with a nukta, no virama."""
    return _by_table(F.replace(c, F.lit(DEAD_N[0]), F.lit(DEAD_N[1])), "hindi")


def width(c: Column) -> Column:
    """Full-width ASCII becomes ASCII, half-width katakana full-width, with its voice marks joined."""
    ascii_wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    kana = [chr(x) for x in range(0xFF65, 0xFFA0)]
    full = [unicodedata.normalize("NFKC", x) for x in kana]
    out = F.translate(c, ascii_wide + "".join(kana), "".join(chr(ord(x) - 0xFEE0) for x in ascii_wide) + "".join(full))
    voiced = out
    for base in full:
        for mark in "゙゚":
            if len(joined := unicodedata.normalize("NFC", base + mark)) == 1:
                voiced = F.replace(voiced, F.lit(base + mark), F.lit(joined))
    return F.when(out.rlike("[゙゚]"), voiced).otherwise(out)
