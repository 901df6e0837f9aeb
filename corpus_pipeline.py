"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Each stage works on all rows that the one before it kept, and its decisions take effect. All but the last return the
columns of documents (doc_id, text, lang, source, n_chars); columns beyond these are dropped at the start of a stage.

Defined results: a null text fails the quality rules; of rows with one id and text each copy is judged alone and one
stays after near-dedup, and unlike texts stay whatever their ids (see near_dedup); an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.bpe import encode_decode, vocabulary_path
from wayfold.llm.common import row_key, shared_dir, table
from wayfold.llm.decontaminate import contamination
from wayfold.llm.minhash import near_duplicates
from wayfold.llm.quality import judge, train
from wayfold.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees, which are grown on the labelled ones among them."""
    docs = docs.select(*COLUMNS)
    return judge(docs, train(docs, table(spark, sf_dir, "labels")), columns=COLUMNS).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): that with the least id.

    Groups go by text alone, so unlike texts stay whatever their ids. Of rows that share the least id, that with the least
    hash of its text stays; a row without an id stays if no row of its group has one. Of equal rows one stays.
    """
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk1", "rk2")).alias("one")
    one = found.filter("component is not null").groupBy("component").agg(least).select("one.rk1", "one.rk2")
    verdict = one.unionByName(found.filter("component is null").select("rk1", "rk2")).distinct()
    return docs.select("*", *row_key("doc_id", "text")).join(verdict, ["rk1", "rk2"], "left_semi").dropDuplicates(["rk1", "rk2"]).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages. Untouched texts stay as they are; of others the kept words remain,
    joined by a space; n_chars follows. Documents of which nothing remains go."""
    out = substring_dedup(docs.select(*COLUMNS), ["doc_id", "lang", "source"])
    return out.filter("n_removed < n_words or n_words = 0").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited."""
    return contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), COLUMNS).filter("not contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what remains, with the public 50k byte-level vocabulary: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(docs.select("doc_id", "text"), vocabulary_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substrings", substrings), ("decontaminate", decontaminate), ("tokens", tokens)]

#: The stages of quality, similarity sketches, alignment and BPE can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
