"""Line-first quality rules, built from SQL functions only.

Every line is judged by itself; lines that fail go; a document goes when the lines it lost held more than
``max_lost`` of its word characters. Nothing is shuffled: a document is judged within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.names import col

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "cookie", "javascript", "all rights reserved", "terms of use", "terms of service", "privacy policy",
    "licensed under", "creative commons", r"copyright (?:\(c\)|[12][0-9]{3})", "subscribe", "newsletter", "sign in", "log in",
    "click here", "read more", "lorem ipsum",
)


def words(text: Column) -> Column:
    """The words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def line_verdict(
    line: Column, max_symbol_share: float = 0.3, max_shout_share: float = 0.5, max_separator_share: float = 0.15, max_boilerplate_words: int = 40
) -> Column:
    """Name of the first rule that a line breaks, ``blank`` for a line without words, null for a good one.

    navigation: separators between few words. boilerplate: a short line with a telling phrase as whole words, or a
    copyright sign. punctuation: the line doesn't end with a mark of its sentence (so a paragraph that is cut off goes),
    or marks stand in place of words: many words end in symbols or in repeated exclamation marks.
    """
    n = F.regexp_count(line, F.lit(WORD))
    ended = F.concat(line, F.lit(" "))
    separators = F.regexp_count(line, F.lit(r"[|»›·•]|[\x20\x09]>[\x20\x09]"))
    symbols = F.regexp_count(ended, F.lit(r"[#*$%&<>\\^~={}][\x20\x09-\x0D]"))
    shouts = F.regexp_count(ended, F.lit(r"!![\x20\x09-\x0D]"))
    phrase = F.concat(F.lit(" "), line).rlike(r"(?i)[^a-z](?:" + "|".join(BOILERPLATE) + r")(?:[^a-z]|\z)|©")
    return (
        F.when(n == 0, "blank")
        .when((separators >= 2) & (separators >= max_separator_share * n), "navigation")
        .when((n <= max_boilerplate_words) & phrase, "boilerplate")
        .when(~line.rlike(r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*\z"), "punctuation")
        .when((symbols >= 2) & (symbols >= max_symbol_share * n), "punctuation")
        .when((shouts >= 3) & (shouts >= max_shout_share * n), "punctuation")
    )


def repeated_words(word_list: Column, window: int = 8) -> tuple[Column, Column]:
    """Hashes of all windows, and of a column ``windows`` of such hashes the number of words in repeated ones."""
    hashes = F.transform(word_list, lambda w: F.xxhash64(w))
    rolled = F.when(
        F.size(word_list) > window,
        F.transform(F.sequence(F.lit(0), F.size(word_list) - window), lambda i: F.xxhash64(*[F.get(F.col("word_hashes"), i + k) for k in range(window)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return hashes, rolled


def _covered(windows: str, window: int) -> Column:
    """Words under the windows whose hash stands at two places or more."""
    return F.expr(f"""
        CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE
          aggregate(array(sort_array(transform({windows}, (h, i) -> struct(h AS h, i AS i)))), 0L, (acc, s) -> acc +
            aggregate(array(sort_array(transform(
                filter(s, (e, k) -> coalesce(get(s, k - 1).h = e.h, false) OR coalesce(get(s, k + 1).h = e.h, false)), e -> e.i))),
              0L, (sum, at) -> sum + aggregate(
                transform(at, (p, k) -> CAST(least({window}, coalesce(get(at, k + 1) - p, {window})) AS BIGINT)), 0L, (a, b) -> a + b)))
        END""")


def clean(docs: DataFrame, max_lost: float = 0.7, min_words: int = 20, max_repeat_percent: int = 30, window: int = 8) -> DataFrame:
    """All columns of ``docs`` and ``quality`` (one of that name is replaced), a struct of the base counts, the verdict and the cleaned text.

    Null texts count as empty: no words, all counts zero, ``base_failed``. A text whose lines are all good is
    kept unchanged. Repeated rows get equal results; columns of any other name pass through. Very long texts
    cost time in proportion to their length times its logarithm, within one row.
    """
    own = [F.col("d").getField(c).alias(c) for c in docs.columns if c != "quality"]
    row = docs.select(F.struct(*map(col, docs.columns)).alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    row = row.select("d", "t", words(F.col("t")).alias("words"), F.split("t", "\n").alias("lines"))
    row = row.select("d", "t", "lines", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes"))
    row = row.select(
        "d", "t", "n_words", F.transform("lines", lambda x: F.struct(x.alias("line"), line_verdict(x).alias("rule"))).alias("lines"),
        repeated_words(F.col("word_hashes"), window)[1].alias("windows"),
    )
    chars = lambda x: F.length(F.regexp_replace(x, SPACES, "")).cast("long")
    spoken = F.transform(F.filter("lines", lambda x: x["rule"].isNull() | (x["rule"] != "blank")), lambda x: x["line"])
    failed = F.filter("lines", lambda x: x["rule"].isNotNull() & (x["rule"] != "blank"))
    row = row.select(
        "d", "n_words", chars(F.col("t")).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(spoken) - F.size(F.array_distinct(spoken))).cast("long").alias("n_dup_lines"),
        _covered("windows", window).alias("n_repeat_words"),
        F.size(failed).alias("n_failed_lines"),
        F.aggregate(failed, F.lit(0).cast("long"), lambda a, x: a + chars(x["line"])).alias("lost_chars"),
        F.when(F.size(failed) == 0, F.col("t")).otherwise(
            F.array_join(F.transform(F.filter("lines", lambda x: x["rule"].isNull() | (x["rule"] == "blank")), lambda x: x["line"]), "\n")).alias("cleaned_text"),
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, F.col("lost_chars") / F.col("word_chars")).otherwise(F.lit(1.0))
    return row.select(
        *own,
        F.struct(
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", lost.alias("lost_share"), base.alias("base_failed"),
            (~base & (lost <= max_lost)).alias("kept"), "cleaned_text",
        ).alias("quality"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: the base counts and the verdict, as ``clean`` defines them for nulls, long texts and repeated rows."""
    q = "quality."
    return clean(docs.select("doc_id", "text")).select(
        "doc_id", *[F.col(q + c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines")], F.round(q + "lost_share", 6).alias("lost_share")
    )
