"""A corpus pipeline: toxic documents out, near duplicates out, benchmark leaks out, sources mixed, tokens written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import covering_simhash, pfair_mix, template_decontam, token_store, toxicity_cnn
from quern.llm.common import few_decoded, fresh, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject."""
    few_decoded(spark)
    scored = toxicity_cnn.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(scored.columns[-1]) < toxicity_cnn.PASS).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link at a similarity of 0.8."""
    return covering_simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    few_decoded(spark)
    return template_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the mixture reads them."""
    few_decoded(spark)
    at_id, at_source, at = fresh(docs, "at_id", "at_source", "at")
    order = pfair_mix.mix(docs.select("doc_id", "source"))
    # repeated ids of a source share their positions: those of the first of them
    first = order.groupBy(F.col("doc_id").alias(at_id), F.col("source").alias(at_source)).agg(F.min("position").alias(at))
    same = F.col("doc_id").eqNullSafe(F.col(at_id)) & F.col("source").eqNullSafe(F.col(at_source))
    # rows that share a position are in the order of their texts
    return docs.join(first, same).orderBy(at, F.xxhash64("text"), F.xxhash64(*docs.columns)).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, written in the order of the rows of docs, which is that of its files, and read back."""
    few_decoded(spark)
    uri, order = f"{shared_dir(spark)}/tokens", None
    if docs.inputFiles():
        part = F.regexp_extract("_metadata.file_path", r"part-(\d+)", 1).try_cast("long")
        order = [part, F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return token_store.read_tokens(spark, uri, token_store.write_tokens(docs, uri, token_store.public_tokenizer(), order=order))


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("mixture", mix_sources), ("tokens", write_tokens)]

#: No SQL expresses the classifier or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
