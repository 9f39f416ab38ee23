"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing of
sources, SentencePiece encoding. Each stage works on all that its predecessor
kept; all but the last return the columns of ``documents``.

Defined cases: a null, empty or blank text has fewer words than the quality rules
ask for, so its document goes in the first stage; repeated rows are judged and
shortened alike and are one document from the near-dedup on; rows with a null id
stay rows with a null id; a null source is a source of its own; an empty table
gives an empty result; further columns travel along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadence.llm import lines, mixing, pieces, rules, simhash
from cadence.llm.common import hold, read
from cadence.llm.queries import piece_model_path, sha

#: SQL cannot express the SimHash and SentencePiece stages.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return rules.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a smaller id holds."""
    out = lines.dedup_lines(docs)
    return out.select(*[f"c{i}_" for i in range(len(docs.columns))]).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return mixing.mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each emitted document, and digests of ids and decoded text."""
    d = pieces.encode_documents(docs, piece_model_path())
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.translate("ids", ",", "")) + 1)
    return d.select("doc_id", n.cast("long").alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", mixing_stage),
    ("SentencePiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = hold(docs, f"pipeline-{at}")
    return docs
