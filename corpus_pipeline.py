"""From raw documents to packed training bins, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.llm import exact_dedup, language, near_dups, packing, secrets
from iotrail.llm.common import SPACES, keep_rows, stage, table

#: Rows of a block are 2 to this power, the size of Spark's bitmaps.
BLOCK_BITS = 15


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts whose two likeliest languages are too close to tell apart.

    Without labelled rows there is no model; then only texts without a letter go.
    """
    model = language.fit(language.training_rows(docs))
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.predict(docs, model, own=("__lang", "__score", "__close"))
    return found.filter((F.col("__lang") != "und") & ~F.col("__close")).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest, then the smallest id."""
    listed = exact_dedup.dedup(docs).filter("kept")
    kept = listed.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n_copies"))
    flat = F.translate(F.coalesce("text", F.lit("")), SPACES, "")
    return keep_rows(docs, stage(kept, "kept"), {"doc_id": F.col("doc_id"), "text_sha256": F.sha2(flat.cast("binary"), 256)}, F.length("text"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity 0.8): the smallest id, then the first row.

    Each row is a document of its own, whatever its id; a null id is the smallest. The row's key is written with it.
    What stays is one bit a row, in blocks of rows, so that no list of rows as long as the table meets the texts.
    """
    keyed = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    listed = near_dups.near_duplicates(keyed, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    first = keyed.select("__row", F.col("doc_id").alias("__id")).join(listed, "__row").groupBy("component_id").agg(F.min(F.struct("__id", "__row")).alias("first"))
    block, at = F.shiftright("__row", BLOCK_BITS).alias("__block"), F.col("__row") % (1 << BLOCK_BITS)
    bits = first.select("first.__row").groupBy(block).agg(F.bitmap_construct_agg(at).alias("bits"), F.max(at).alias("last"))
    bits = stage(bits.select("__block", F.col("bits").substr(F.lit(1), F.floor(F.col("last") / 8).cast("int") + 1).alias("__bits")), "kept")
    byte = F.conv(F.hex(F.col("__bits").substr(F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return keyed.withColumn("__block", block).join(bits, "__block").filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its kind; ``n_chars``, where there is one, follows the new text. No row goes."""
    clean = secrets.redact_documents(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training bins."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The language model, the bins and the near copies have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
