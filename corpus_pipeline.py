"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Toxic documents go, lines that many documents share go, one document of each group of near
duplicates stays, documents with benchmark text go, and the rest is encoded.  All stages but the
last return the columns of ``documents``; n_chars follows the text.  Documents are told apart by
their ids: rows of one id stay or go together, and rows without an id aren't taken for duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm import decontaminate, jaccard, line_dedup, pieces, toxicity
from thresher.llm.common import cut, drop_cut, maybe_broadcast

#: Near duplicates: shingles of five words, a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=~toxicity.held_out())
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines found in ten or more of them."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    found = jaccard.jaccard_components(docs, SHINGLE_WORDS, SIMILARITY, count_links=False)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(maybe_broadcast(gone, 8), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    out = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(~F.col("contaminated")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids, their number, and the text that the ids decode to."""
    out = pieces.encode_decode(docs)
    return out.withColumn("n_tokens", F.size("ids").cast("long")).select(*docs.columns, "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a learned model, which SQL can't express; tests compare the run with brute force.
ORACLE_SQL = None
