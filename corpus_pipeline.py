"""A training-data pipeline over documents: language, quality, near duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import common, jaccard_join, langid, mixing, packing, quality


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by place, so that none clashes with what an operator adds."""
    names = {c: f"x{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    model = langid.fit(docs, learn=~common.held_out())
    plain, names = _numbered(docs)
    judged = langid.identify(plain, model, id_cols=tuple(plain.columns), text_col=names["text"])
    return judged.filter(~F.col("rejected")).select(*plain.columns).toDF(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    forest = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~common.held_out())
    plain, names = _numbered(docs)
    judged = quality.score(plain, forest, id_cols=tuple(plain.columns), text_col=names["text"])
    return judged.filter(F.col("predicted") == 1).select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id."""
    return jaccard_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    cut = packing.pieces(docs.select("doc_id", "text")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Trained classifiers and tokenised packing can't be said in SQL; a test holds run() against a plain Python version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
