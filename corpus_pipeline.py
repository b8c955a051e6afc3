"""A training corpus from the documents table: quality, near-duplicates, repeated passages, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and reads all that its predecessor kept, written as Parquet. All but the last return
the columns of documents; extra columns of the input are dropped, whatever their names. Texts of any length are read whole.
An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import mixing, neardup, packing, quality, substrings
from factloom.llm.common import new_folder, words

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and every rule of the threshold table.

    Null, empty and blank texts have no word and fail the base. Rows aren't compared: repeated rows, rows that share an id and
    rows without one are judged by their own text, and all that pass stay."""
    return quality.apply_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of near-duplicates over 5-word shingles at 0.8.

    Texts without a word and rows without an id link with nothing and stay. Rows that share an id but not a text are documents
    of their own; if linked, that of the least text hash stays. Of rows of one id and text one stays."""
    return neardup.keep_one(docs.select(*COLUMNS), k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that a document of a smaller id has; texts of nothing else go.

    Null, empty and short texts and rows without an id stay as they are. Rows that share an id lose nothing to each other, so
    repeated rows stay. n_chars is counted anew where words went, and is left as it is elsewhere."""
    cut = substrings.remove_repeats(docs.select(*COLUMNS), 13)
    cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.filter("NOT (n_removed > 0 AND text = '')").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mixture of its source repeats it, three times at most.

    A document's pattern is the sources that hold its text, and its words count for its own; null is a source of its own.
    Texts without a word add nothing to a mixture and go. Repeated rows are documents each; ties in the seeded order are rows
    of one id and text, and alike."""
    held = mixing.with_members(docs.select(*COLUMNS))
    mixed = mixing.mix_sources(held, F.col("members"), F.size(words(F.col("text"))), [F.col("doc_id"), F.xxhash64("text")], home=F.col("source"))
    return mixed.filter("_copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids.

    Every row is packed, repeated ones each; null and empty texts have only the final id, rows without an id a null one."""
    return packing.pack_documents(docs, packing.word_ids(public_tokenizers.path("word_bpe_49k.json"), end=1), 2048)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("source mix", source_mix),
    ("packing", pack_sequences),
]

#: The stages fold hashes and tokenizer merges, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table; each stage is written in the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
