"""A corpus pipeline: from all documents to token ids, each stage by one operator of ``graphloom.llm``.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame.  All but the last return the columns of documents.
``run`` chains them over the documents table, each written as Parquet and read
again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chosen_path, cluster, mixing, pii_crf, piece_transducer, toxicity_chain


#: Rows of an Arrow batch: texts go through Python workers in batches of a few MB, and a worker holds some copies of one.
BATCH_ROWS = 1_000
#: Parts of texts whose ids an encoding task keeps: executors hold much else by then.
CACHE = 60_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    small_batches(spark)
    chain = toxicity_chain.standard_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return chain.score(docs, keep=True).where(F.col("p_toxic") < toxicity_chain.THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, of equal ids the first; rows without an id come last.

    Rows are numbered once and written, so rows that share an id, or have none, are told apart.
    """
    small_batches(spark)
    rows = cluster.saved(docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))]).withColumn("_row", F.monotonically_increasing_id()), "rows")
    at = [c.lower() for c in docs.columns]
    named = rows.select("_row", F.col(f"_c{at.index('doc_id')}").alias("_id"), F.col(f"_c{at.index('text')}").alias("text"))
    groups = cluster.saved(chosen_path.near_duplicates(named, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id"), "groups")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("first")
    kept = groups.join(named.select("_row", "_id"), "_row").groupBy("component_id").agg(first).select("first._row")
    gone = cluster.saved(groups.select("_row").join(kept, "_row", "left_anti"), "gone")
    few = gone.count() <= chosen_path.BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, "_row", "left_anti").drop("_row").toDF(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by a tag of its kind; n_chars follows."""
    small_batches(spark)
    return pii_crf.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with its language and source."""
    small_batches(spark)
    return piece_transducer.encoded(docs, keep=["doc_id", "lang", "source"], cache=CACHE)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("mix", mix), ("encode", encode)]

#: SQL can express neither the fitted models nor the transducer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cluster.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
