"""Stored facts: content-addressed Parquet with a manifest, JSON lines with a version header, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from factloom.operators import knowledge
from factloom.sources import code

VERSION = "1"


def file_key(path):
    """Where a file's facts lie: the hash of its relative path."""
    return F.sha2(path, 256)


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2(F.coalesce("source", F.lit("")), 256))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def parse_changed(files: DataFrame, folder: str) -> DataFrame:
    """Parses only files whose content isn't in the manifest, appends their facts, and returns the facts of all files.

    The store is append-only: a version is its (file_path, file_hash), so two runs can't disturb each other, and a run that
    dies leaves facts that the next one finds. Facts of contents that are gone stay until ``compact``."""
    spark = files.sparkSession
    now = hashed(files)
    kept = _read(spark, f"{folder}/facts")
    todo = now if kept is None else knowledge.stale(now, kept.select("file_path", "file_hash").distinct())
    parsed = code.parse(todo).join(todo.select("file_path", "file_hash").distinct(), "file_path")
    parsed.withColumn("version", F.lit(VERSION)).write.mode("append").parquet(f"{folder}/facts")
    all_ = spark.read.parquet(f"{folder}/facts").filter(F.col("version") == VERSION)
    return all_.join(now.select("file_path", "file_hash").distinct(), ["file_path", "file_hash"], "left_semi").dropDuplicates(["file_path", "file_hash"])


def load_project(files: DataFrame, folder: str, strict: bool = False) -> DataFrame | None:
    """Facts of the files that are fresh; strict: null if any is stale."""
    now = hashed(files)
    kept = _read(files.sparkSession, f"{folder}/facts")
    if kept is None or strict and not knowledge.stale(now, kept.select("file_path", "file_hash")).isEmpty():
        return None
    return kept.join(now.select("file_path", "file_hash"), ["file_path", "file_hash"], "left_semi").dropDuplicates(["file_path", "file_hash"])


def compact(spark: SparkSession, folder: str, files: DataFrame, out: str) -> None:
    """A store of the current contents only, in another folder."""
    found = load_project(files, folder)
    if found is not None:
        found.write.mode("overwrite").parquet(f"{out}/facts")


def write_lines(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, folder: str) -> None:
    """A graph as JSON lines: one meta line, then a line per record with its type."""
    spark = nodes.sparkSession
    meta = spark.createDataFrame([(0, json.dumps({"record_type": "meta", "version": VERSION}))], "o int, value string")
    row = lambda d, kind, o: d.select(F.lit(o).alias("o"), F.to_json(F.struct(F.lit(kind).alias("record_type"), *d.columns)).alias("value"))
    lines = meta.unionByName(row(nodes, "node", 1)).unionByName(row(edges, "edge", 2)).unionByName(row(symbols, "symbol", 3))
    lines.repartitionByRange(8, "o").sortWithinPartitions("o").select("value").write.mode("overwrite").text(folder)


def read_lines(spark: SparkSession, folder: str, schemas: dict[str, StructType | str]) -> dict[str, DataFrame]:
    """Tables by record type; a folder whose meta line is missing or of another version is an error."""
    lines = spark.read.text(folder)
    kind = F.get_json_object("value", "$.record_type")
    meta = lines.filter(kind == "meta").select(F.get_json_object("value", "$.version").alias("v")).collect()
    if [r["v"] for r in meta] != [VERSION]:
        raise ValueError(f"{folder} has no meta line of version {VERSION}")
    return {k: lines.filter(kind == k).select(F.from_json("value", s).alias("r")).select("r.*") for k, s in schemas.items()}


def keep_newest(snapshots: DataFrame, keys: list[str], at: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned) snapshots of each target: the newest stay."""
    ranked = knowledge.newest(snapshots, keys, [at], 1 << 30)
    return ranked.filter(F.col("rank") <= most).drop("rank"), ranked.filter(F.col("rank") > most).drop("rank")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_path and change (added, removed, modified) between two snapshots of file_path and file_hash."""
    a, b = before.select("file_path", F.col("file_hash").alias("old")), after.select("file_path", F.col("file_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "file_path", "full_outer").select("file_path", change.alias("change")).filter("change IS NOT NULL")
