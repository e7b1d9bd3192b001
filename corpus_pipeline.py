"""The corpus pipeline: STAGES over documents, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm.common import Scratch, digest
from quadlake.llm.language_id import fit, language_id
from quadlake.llm.line_dedup import line_dedup
from quadlake.llm.mixing import by_length, mix
from quadlake.llm.near_dedup import near_dedup
from quadlake.llm.packing import pack_documents
from quadlake.llm.queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised. Null texts, texts without letters and scores under the calibrated
    threshold go; rows stay as they are."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return docs.select(COLUMNS).withColumn("_found", language_id(docs, model)).where(~F.col("_found.rejected")).drop("_found")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are in ten documents or more from all of them; n_chars is counted again. A document that has no other
    lines stays, with an empty text; a null text stays null. Repeated rows are documents. An empty table stays empty."""
    out = line_dedup(docs.select(COLUMNS), least=10)
    changed = F.col("n_dropped") > 0
    return out.withColumns({"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one with the smallest id (null ids are above all others); of
    repeated rows one. Null texts count as empty and are each other's copies. An empty table stays empty."""
    kept = near_dedup(docs, width=5, similarity=0.8).where("kept").select(F.col("doc_id").alias("_id"), F.col("h1").alias("_1"), F.col("h2").alias("_2"))
    h1, h2 = digest(F.coalesce("text", F.lit("")))
    text = docs.select(COLUMNS).withColumns({"_h1": h1, "_h2": h2})
    found = text.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_1")) & (F.col("_h2") == F.col("_2")), "left_semi")
    return found.dropDuplicates(["doc_id", "_h1", "_h2"]).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources wants it, up to twice; a document that isn't wanted goes. Each row has
    its own number of copies, repeated rows and null ids too. A null source is a source; null texts have no words and come as
    often as their source's whole copies. An empty table stays empty."""
    taken = mix(docs, weights=(5, 2, 1), share=1.5, most=2.0, priority=by_length(F.col("text")), carry=tuple(COLUMNS)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row for each piece, with its ids. Null and empty texts are one token; repeated rows are packed
    as often as they stand there. An empty table gives no rows."""
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)
    return out.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("language", language), ("lines", lines), ("near", near), ("mixture", mixture), ("packed", packed)]

#: The language model, the signatures and the tokenizer aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
