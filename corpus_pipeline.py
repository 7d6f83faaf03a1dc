"""The corpus pipeline: documents through five operators of trivex.llm, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trivex.llm import line_dedup, mixing, packing, quality, simhash
from trivex.llm.common import discard, written


def quality_classifier(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models of trusted text accept. Null, empty and repeated rows, small languages and an empty table: as quality.judge says; kept rows keep all columns."""
    return quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_only=True)


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; n_chars follows the text, null for a null one. No row goes; ties, repeats, long texts and an empty table: as line_dedup.line_dedup says."""
    out = line_dedup.line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Texts without words, null ones too, are a group; rows with a null doc_id stay; rows that repeat the smallest doc_id stay all."""
    return simhash.one_of_each(docs)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so rows repeat. A null source is a source; documents without words may be left out; repeated rows and an empty table: as mixing.mix says."""
    return mixing.mix(docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in their training sequences. A null text is its end id alone; each repeated row is packed; an empty table gives no pieces."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", lines), ("simhash_near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Language models, hashes of Spark and a tokenizer aren't in DuckDB; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table is deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
