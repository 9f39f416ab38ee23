"""Quality rules, line first: lines that fail punctuation, navigation or
boilerplate rules are removed, then documents that lose too much are rejected.

Everything is DataFrame functions over one row; nothing is shuffled.

Defined cases: a null or blank text has no words and is rejected by the base
rule (fewer than 20 words); repeated rows are judged alike; lines without a
word are neutral: never counted as removed, and kept where they are.

The phrases of the boilerplate rule are English; texts in other languages meet
the punctuation and navigation rules only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"
#: Phrases of boilerplate lines, lower case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "sign up for our newsletter",
)
#: Separators of navigation bars.
NAVIGATION = r"[|»›•→]"


def base_counts(text: Column) -> dict[str, Column]:
    """Expressions over a text: words, their characters, symbols, repeated lines
    and words inside repeated windows of eight words."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(INK))
    return {
        "words": words,
        "lines": lines,
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
    }


def with_base(docs: DataFrame, text: Column, window: int = 8) -> DataFrame:
    """``docs`` with ``qr_``-prefixed counts of the whole text.

    A window is known by the hash of its words' hashes; a text without repeated
    windows stops after one pass over the distinct hashes.
    """
    b = base_counts(text)
    d = docs.withColumn("qr_words", b["words"]).withColumn("qr_lines", b["lines"])
    d = d.withColumn("qr_n_words", F.size("qr_words").cast("long"))
    d = d.withColumn("qr_word_chars", b["word_chars"]).withColumn("qr_n_symbols", b["n_symbols"])
    d = d.withColumn("qr_n_dup_lines", (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long"))
    return d.withColumn("qr_n_repeat_words", repeated_words(F.col("qr_words"), window))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, also where the optimizer
    moves the expression into a filter."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words covered by windows that occur more than once in the text."""

    def hashes(w: Column) -> Column:
        fold = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: fold(h, i)))

    def places(s: Column) -> Column:
        # sorted (hash, place): neighbours with the same hash are repeated windows
        near = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: near(j - 1, x) | near(j + 1, x)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(x: Column) -> Column:
        ranked = F.array_sort(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        once = F.size(F.array_distinct(x)) == F.size(x)
        return F.when(once, F.lit(0).cast("long")).otherwise(let(ranked, lambda s: let(places(s), covered)))

    zero = F.lit(0).cast("long")
    return let(words, lambda w: F.when(F.size(w) < window, zero).otherwise(let(hashes(w), count)))


def bad_line(line: Column) -> Column:
    """A line that goes: no letters or digits; mostly shouting or symbols;
    a navigation bar; a boilerplate phrase."""
    low = F.lower(line)
    ink = F.regexp_count(line, F.lit(INK))
    marks = F.regexp_count(line, F.lit(r"[#*$%&|<>!?=_~^\\]"))
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    bars = F.regexp_count(line, F.lit(NAVIGATION))
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    upper = F.regexp_count(line, F.lit(r"\p{Lu}"))
    punctuation = ~line.rlike(r"[\p{L}\p{N}]") | (marks * 100 > ink * 15) | ((words >= 5) & (upper * 100 > letters * 80))
    navigation = (bars >= 2) & (bars * 5 >= words)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | low.contains(phrase)
    return punctuation | navigation | (boiler & (words <= 40))


def chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def base_failed() -> Column:
    """The base rule on the counts of ``with_base``."""
    return (F.col("qr_n_words") < 20) | (F.col("qr_n_repeat_words") * 100 > F.col("qr_n_words") * 30)


def judge(docs: DataFrame, text: Column, max_lost_percent: int = 40) -> DataFrame:
    """``with_base`` plus the verdict: ``qr_base_failed``, ``qr_lost_chars`` and
    ``qr_kept``. A document goes if the base rule fails or if its removed lines
    hold more than ``max_lost_percent`` of its characters."""
    d = with_base(docs, text)
    d = d.withColumn("qr_lost_lines", F.filter("qr_lines", bad_line))
    d = d.withColumn("qr_lost_chars", chars(F.col("qr_lost_lines"))).withColumn("qr_all_chars", chars(F.col("qr_lines")))
    failed = base_failed()
    loses = F.col("qr_lost_chars") * 100 > F.col("qr_all_chars") * max_lost_percent
    return d.withColumn("qr_base_failed", failed).withColumn("qr_kept", ~failed & ~loses)


def quality_filter(docs: DataFrame, text_col: str = "text", clean: bool = True, max_lost_percent: int = 40) -> DataFrame:
    """The documents that pass, with the columns of ``docs``; ``clean`` removes
    the failing lines from their texts.

    The same verdict as ``judge``. Verdict and cleaned text come out of one
    generator, so that each line is judged once and only after the base rule.
    """
    names = [f"c{i}_" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text_col)]
    d = with_base(docs.toDF(*names), F.col(at)).withColumn("qr_all_chars", chars(F.col("qr_lines")))

    def verdict(lines: Column) -> Column:
        def passed(stay: Column) -> Column:
            lost = chars(lines) - chars(stay)
            return F.when(lost * 100 <= F.col("qr_all_chars") * max_lost_percent, F.array_join(stay, "\n") if clean else F.col(at))

        return let(F.filter(lines, lambda x: ~x.rlike(INK) | ~bad_line(x)), passed)

    text = F.when(~base_failed(), let(F.split(F.col(at), "\n"), verdict))
    kept = d.select(*names, F.explode_outer(F.array(text)).alias("qr_text")).filter(F.col("qr_text").isNotNull())
    return kept.select(*[F.col("qr_text").alias(n) if n == at else F.col(n) for n in names]).toDF(*docs.columns)
