"""A training corpus from the documents table: classify, drop copies, drop near copies, mix, tokenise.

Each stage works on all rows that the one before kept. ``run`` applies them in order, each written as Parquet in
the shared folder and read again, so that a stage starts from files and not from the plans before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.llm.common import Scratch
from haulspark.llm.exact_dedup import exact_dedup
from haulspark.llm.mixing import mix_sources
from haulspark.llm.near_dedup import near_dedup
from haulspark.llm.quality import score_quality, train_quality
from haulspark.llm.sentencepiece_codec import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows_of(docs: DataFrame, told: DataFrame, extra: str | None = None) -> DataFrame:
    """Rows of ``docs`` that ``told`` (doc_id, text_key) names, each once; a null id or text is matched as such."""
    d, t = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text")).alias("d"), told.alias("t")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.text_key") == F.col("t.text_key"))
    if extra is None:
        return d.join(t, same, "left_semi")
    return d.join(t, same).select("d.*", extra)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good; it learns from the labelled ones among the corpus's own.

    A null text is scored as an empty one; repeated rows are judged alike and all stay. Without labels of both kinds
    nothing is learned and all stay. No rows give no rows.
    """
    ranking = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, ranking, keep=[c for c in COLUMNS if c != "doc_id"])
    return scored.where("predicted = 1").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are equal but for spaces: the longest, then that of the smallest id.

    Null and empty texts are one class. Of repeated rows one stays. No rows give no rows.
    """
    kept = exact_dedup(docs).where("kept").select("doc_id", "text_key")
    return _rows_of(docs, kept).dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id of those linked by five-word shingles at 0.8 or more.

    Documents without words, or without an id, are linked with nothing and stay. Rows that repeat an id stay or go
    each by its own text. No rows give no rows.
    """
    kept = near_dedup(docs).where("kept").select("doc_id", "text_key")
    return _rows_of(docs, kept).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: no row, or up to three.

    A null source is one source, the last. Documents without words cost nothing and stay once. No rows give no rows.
    """
    taken = mix_sources(docs).where("copies > 0").groupBy("doc_id", "text_key").agg(F.max("copies").alias("copies"))
    return _rows_of(docs, taken, "copies").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text; a null or empty text has none. Repeated rows are encoded alike; no rows give no rows."""
    return encode(docs.select(*COLUMNS))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mix), ("SentencePiece", tokens)]

#: The classifier's scores and the rounding of the mix are not for SQL to express; tests/llm checks a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(i))
        scratch.drop(str(i - 1))
    return docs
