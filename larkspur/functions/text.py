"""Text analysis as Column functions: character filters, tokenizers, token filters and analyzers.

Tokens are ``array<string>``; everything but the stemmers, folding and Unicode normalisation stays in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import languages, scripts

# character filters


def regexp_char(c: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(c, pattern, by)


def html_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"</?[!\p{L}][^<>]*>", " ")


def zero_width_non_joiner(c: Column) -> Column:
    return F.translate(c, "‌", " ")


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Letters with marks to plain ASCII ones, ligatures to their letters."""
    more = str.maketrans({"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"})
    fold = lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x.translate(more)) if not unicodedata.combining(c))
    return s.map(fold, na_action="ignore")


# tokenizers

_LONE = r"[\p{IsHan}\p{IsHiragana}]"
_WORD = r"[\p{L}\p{M}\p{N}_&&[^\p{IsHan}\p{IsHiragana}]]"
UNICODE_WORD = rf"{_LONE}|{_WORD}+(?:(?:(?<=\p{{L}})['’.:·](?=\p{{L}})|(?<=\p{{N}})[.,;'](?=\p{{N}})){_WORD}+)*"
EMAIL = r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}.\-]+\.[\p{L}]{2,}"
URL = r"https?://[^\s<>\"]+[^\s<>\".,;:!?)\]]"
HANDLE, HASHTAG = r"@[\p{L}\p{N}_]+", r"#[\p{L}\p{N}_]+"


def regexp_tokens(c: Column, pattern: str) -> Column:
    """All matches that are not empty."""
    return F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)), lambda x: x != "")


def unicode_tokens(c: Column) -> Column:
    """Words by the Unicode rules for letters, numbers and what may stand between them; ideographs alone."""
    return regexp_tokens(c, UNICODE_WORD)


def letter_tokens(c: Column) -> Column:
    return regexp_tokens(c, r"\p{L}+")


def whitespace_tokens(c: Column) -> Column:
    return regexp_tokens(c, r"\S+")


def character_tokens(c: Column, char_class: str) -> Column:
    """Runs of characters of a class such as ``[a-z]``."""
    return regexp_tokens(c, f"(?:{char_class})+")


def single_token(c: Column) -> Column:
    return F.filter(F.array(c), lambda x: x.isNotNull())


def exception_tokens(c: Column, exceptions: Iterable[str], rest: str = UNICODE_WORD) -> Column:
    """Matches of the exceptions stay whole, the remainder is cut by ``rest``."""
    return regexp_tokens(c, "|".join(f"(?:{p})" for p in (*exceptions, rest)))


def web_tokens(c: Column) -> Column:
    return exception_tokens(c, (EMAIL, URL, HANDLE, HASHTAG))


# token filters


def lowercase(t: Column) -> Column:
    return F.transform(t, F.lower)


def stop(t: Column, words: Iterable[str], letters: Iterable[tuple[str, str]] = ()) -> Column:
    """Tokens that aren't in ``words``, after the replacements of ``letters`` in what is compared."""

    def folded(x: Column) -> Column:
        for pattern, by in letters:
            x = F.regexp_replace(x, pattern, by)
        return x

    return F.filter(t, lambda x: ~folded(x).isin(*words))


def stop_with_positions(t: Column, words: Iterable[str]) -> Column:
    """Structs (pos, term); positions of dropped words stay empty."""
    return F.filter(F.transform(t, lambda x, i: F.struct((i + 1).alias("pos"), x.alias("term"))), lambda x: ~x["term"].isin(*words))


def length(t: Column, least: int, most: int) -> Column:
    return F.filter(t, lambda x: F.length(x).between(least, most))


def truncate(t: Column, n: int) -> Column:
    return F.transform(t, lambda x: F.substring(x, 1, n))


def unique(t: Column) -> Column:
    return F.array_distinct(t)


def reverse(t: Column) -> Column:
    return F.transform(t, F.reverse)


def ngrams(t: Column, least: int, most: int) -> Column:
    """At each character the pieces of ``least`` to ``most`` characters, shorter first."""

    def of(x: Column) -> Column:
        n = F.length(x)
        at = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.filter(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(i + k - 1 <= n, F.substring(x, i, k))), lambda y: y.isNotNull()))
        return F.flatten(at)

    return F.flatten(F.transform(t, of))


def edge_ngrams(t: Column, least: int, most: int, back: bool = False) -> Column:
    def of(x: Column) -> Column:
        cut = lambda k: F.when(k <= F.length(x), F.substring(x, F.length(x) - k + 1, k) if back else F.substring(x, F.lit(1), k))
        return F.filter(F.transform(F.sequence(F.lit(least), F.lit(most)), cut), lambda y: y.isNotNull())

    return F.flatten(F.transform(t, of))


def shingles(t: Column, least: int, most: int, separator: str = " ", originals: bool = False) -> Column:
    """Runs of ``least`` to ``most`` tokens; with ``originals`` each run stands after its first token."""

    def at(i: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(i + k - 1 <= F.size(t), F.array_join(F.slice(t, i, k), separator)))
        runs = F.filter(runs, lambda y: y.isNotNull())
        return F.concat(F.slice(t, i, F.lit(1)), runs) if originals else runs

    return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), at)))


def apostrophe(t: Column) -> Column:
    return F.transform(t, lambda x: F.regexp_replace(x, "['’].*$", ""))


def elision(t: Column, articles: Iterable[str]) -> Column:
    return F.transform(t, lambda x: F.regexp_replace(x, f"^(?:{'|'.join(articles)})['’]", ""))


def possessive(t: Column) -> Column:
    return F.transform(t, lambda x: F.regexp_replace(x, "['’＇][sS]$", ""))


def camel_case(t: Column) -> Column:
    """Cuts where case, digits or other signs change."""
    return F.flatten(F.transform(t, lambda x: F.regexp_extract_all(x, F.lit(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+|[^\p{L}\p{N}]+"), F.lit(0))))


def dictionary_compound(t: Column, words: Iterable[str], least_word: int = 5, least: int = 2, most: int = 15) -> Column:
    """Tokens, each followed by the dictionary words inside it."""
    known = [w for w in words if least <= len(w) <= most]

    def inner(x: Column) -> Column:
        found = F.filter(F.array(*[F.lit(w) for w in known]), lambda w: F.contains(x, w) & (F.length(x) >= least_word) & (w != x))
        return F.concat(F.array(x), found)

    return F.flatten(F.transform(t, inner)) if known else t


def normal_form(form: str = "NFKC") -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ts: None if ts is None else [unicodedata.normalize(form, x) for x in ts])

    return run


def stemmer(lang: str, keep: Iterable[str] = ()) -> Callable[[Column], Column]:
    """A stemming filter; words in ``keep`` (a keyword marker) stay."""
    stem, kept = languages.STEMMERS[lang], frozenset(keep)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ts: None if ts is None else [x if x in kept else stem(x) for x in ts])

    return run


def cjk_bigrams(c: Column) -> Column:
    """Neighbouring ideographs in pairs, other words whole."""
    runs = regexp_tokens(F.lower(c), rf"(?:[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsHangul}}])+|{_WORD}+")
    pairs = lambda x: F.when(
        x.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
    ).otherwise(F.array(x))
    return F.flatten(F.transform(runs, pairs))


# analyzers


def keyword(c: Column) -> Column:
    return single_token(c)


def simple(c: Column) -> Column:
    return lowercase(letter_tokens(c))


def standard(c: Column) -> Column:
    return lowercase(unicode_tokens(c))


def web(c: Column) -> Column:
    return stop(lowercase(web_tokens(c)), languages.STOP["en"])


NORMAL_FIRST = {"fa": scripts.persian, "ckb": scripts.sorani, "hi": scripts.hindi}


def language(lang: str) -> Callable[[Column], Column]:
    """The chain of a language pack: words, lower case, own normalisation, stop words, stems."""

    def run(c: Column) -> Column:
        if lang == "cjk":
            return cjk_bigrams(scripts.width(c))
        t = unicode_tokens(zero_width_non_joiner(c) if lang == "fa" else c)
        if lang == "en":
            t = possessive(t)
        if lang == "tr":
            t = apostrophe(t)
        t = lowercase(t)
        if lang in NORMAL_FIRST:
            t = F.transform(t, NORMAL_FIRST[lang])
        if lang in languages.ELISION:
            t = elision(t, languages.ELISION[lang])
        if lang in languages.STOP:
            t = stop(t, languages.STOP[lang], languages.STOP_LETTERS.get(lang, ()))
        if lang == "ar":  # stop words are told before letters change
            t = F.transform(t, scripts.arabic)
        return stemmer(lang)(t) if lang in languages.STEMMERS else t

    return run


ANALYZERS: dict[str, Callable[[Column], Column]] = {"keyword": keyword, "simple": simple, "standard": standard, "web": web} | {
    lang: language(lang) for lang in sorted({*languages.STOP, *languages.STEMMERS, "cjk"})
}


def analyzer(name: str | None) -> Callable[[Column], Column]:
    """An analyzer by name, in any case; an unknown name gives the standard one."""
    return ANALYZERS.get((name or "standard").lower(), standard)
