"""Mixing sources to target weights.

Words are totalled per source, each source's share of the wanted total gives a
repetition rate, and every document is emitted ``floor(rate)`` times plus once
more if a coin seeded by its id falls within the fraction of the rate.

Defined cases: a null source is a source of its own; a null or blank text has
size 0; a source without words has target 0 and rate 0 (nothing of it is
emitted); an empty table gives an empty result; rows with the same id and text
share one coin, a null id's coin comes from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadence.llm.common import hold, pick

WORD = r"[^\x20\x09-\x0D]+"
#: Sources of at most this many rows are joined by broadcast.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_sizes(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(source, source_size)``: words per source, partial sums before the shuffle."""
    d = pick(docs, source_col, text_col).toDF("source", "t")
    return d.groupBy("source").agg(F.sum(word_count(F.col("t"))).alias("source_size"))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``weight``: the weights in turn, sources by code point, null last.

    The rank comes from a range sort and the row counts of its partitions, so no
    task holds all sources.
    """
    spark = sources.sparkSession
    mark = F.monotonically_increasing_id()
    flat = hold(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", mark), "mix-ranked")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in flat.groupBy(part.alias("p")).agg((F.max(row) + 1).alias("n")).collect())
    first, total = [], 0
    for p, n in counts:
        first.append((p, total))
        total += n
    starts = spark.createDataFrame(first or [(0, 0)], "p long, first long")
    ranked = flat.withColumn("p", part.cast("long")).join(F.broadcast(starts), "p").withColumn("rank", F.col("first") + row)
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return ranked.select("source", "source_size", turn.cast("long").alias("weight"))


def targets(weighted: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target``: ``share`` of all words dealt by weight; a source stops at
    ``most`` times its size and what it cannot take is dealt again by weight.

    Each round needs one row of sums; rounds end when no source is newly full.
    """
    table = hold(weighted, "mix-weighted")
    cap = F.col("source_size") * F.lit(most)
    r = table.agg(F.sum("source_size").alias("n")).first()
    want = share * (r["n"] or 0)
    full, level, was = F.lit(False), 0.0, -1
    while True:
        s = table.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(full.cast("long")).alias("n"),
        ).first()
        if not s["open"] or s["n"] == was:
            break
        level, was = (want - s["taken"]) / s["open"], s["n"]
        full = cap < F.lit(level) * F.col("weight")
    return table.withColumn("target", F.when(cap < F.lit(level) * F.col("weight"), cap).otherwise(F.lit(level) * F.col("weight")))


def coin(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) with 52 bits, the same for the same id at every run."""
    what = F.coalesce(id_col.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), what))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs`` (by position, as ``c0_`` ...) with the
    columns ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``."""
    per_source = hold(targets(cyclic_weights(source_sizes(docs, source_col, text_col), weights), share, most), "mix-targets")
    names = [f"c{i}_" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    ident, src, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, source_col, text_col))
    right = per_source.select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")
    )
    if per_source.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    rate = F.when(F.col("mix_source_size") > 0, F.least(F.col("mix_target") / F.col("mix_source_size"), F.lit(float(most)))).otherwise(0.0)
    low = F.floor(rate)
    copies = low + (coin(ident, text, seed) < rate - low).cast("long")
    return (
        flat.join(right, src.eqNullSafe(F.col("mix_source")))
        .withColumn("mix_size", word_count(text))
        .withColumn("mix_copies", copies)
        .drop("mix_source")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: columns of ``docs``, each document as often as drawn."""
    planned = plan_mix(docs, **options)
    names = [f"c{i}_" for i in range(len(docs.columns))]
    out = planned.filter("mix_copies > 0").withColumn("mix_one", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int"))))
    return out.select(*names).toDF(*docs.columns)
