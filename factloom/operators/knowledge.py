"""Knowledge operators: upserts, caches, library profiles, examples, manifests, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: of the rows of a key, the last in order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Merge of graphs or examples: of the rows of a key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def newest(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The newest rows of each key (examples, backups, decisions): a rank that Spark limits before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def cached_decision(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """verdict and origin (prompt, snippet or null): by prompt hash, else the newest of (check_id, snippet_hash)."""
    by_prompt = decisions.groupBy("prompt_hash").agg(F.max_by("verdict", F.struct("ts", "id")).alias("_p"))
    by_code = decisions.groupBy("check_id", "snippet_hash").agg(F.max_by("verdict", F.struct("ts", "id")).alias("_s"))
    j = findings.join(by_prompt, "prompt_hash", "left").join(by_code, ["check_id", "snippet_hash"], "left")
    return j.withColumn("verdict", F.coalesce("_p", "_s")).withColumn("origin", F.when(F.col("_p").isNotNull(), "prompt").when(F.col("_s").isNotNull(), "snippet")).drop("_p", "_s")


def latest_versions(profiles: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """The latest release of each library, by numbers and not by text."""
    return profiles.groupBy(F.lower(name).alias(name)).agg(F.max_by(version, T.version_key(F.col(version))).alias("latest"))


def match_profiles(dependencies: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each dependency's profile version: the exact one if it is known, else the latest."""
    known = profiles.select(F.lower("name").alias("name"), "version").distinct()
    latest = latest_versions(known)
    d = dependencies.withColumn("name", F.lower("name"))
    exact = d.join(known.withColumn("exact", F.col("version")), ["name", "version"], "left")
    return exact.join(latest, "name", "left").select("name", "version", F.coalesce("exact", "latest").alias("matched"))


def satisfies(version: Column, specifiers: Column) -> Column:
    """Whether a version meets every clause of ``>=1.2,<2`` (==, !=, <, <=, >, >=, ~=); an empty set allows all."""
    clauses = F.filter(F.split(F.coalesce(specifiers, F.lit("")), r"\s*,\s*"), lambda c: c != "")

    def one(c: Column) -> Column:
        op, wanted = F.regexp_extract(c, r"\A\s*(==|!=|<=|>=|~=|<|>)", 1), F.trim(F.regexp_extract(c, r"\A\s*(?:==|!=|<=|>=|~=|<|>)\s*(.*)\z", 1))
        a, b = T.version_key(version), T.version_key(wanted)
        n = F.size(F.split(wanted, r"\."))
        return (
            F.when(op == "==", a == b).when(op == "!=", a != b).when(op == "<", a < b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == ">=", a >= b)
            .when(op == "~=", (a >= b) & (F.slice(a, F.lit(1), n - 1) == F.slice(b, F.lit(1), n - 1))).otherwise(F.lit(False))
        )

    return F.forall(clauses, one)


def requirement(line: Column) -> dict[str, Column]:
    """name, extras and specifier of a line of a requirements file; null name for comments, options and git addresses without an egg."""
    bare = F.trim(F.regexp_replace(line, r"\s+#.*\z|\A#.*\z", ""))
    git = F.startswith(bare, F.lit("git+"))
    egg = F.regexp_extract(bare, r"[#&]egg=([A-Za-z0-9_.\-]+)", 1)
    name = F.when(git, egg).otherwise(F.regexp_extract(bare, r"\A([A-Za-z0-9][A-Za-z0-9._\-]*)", 1))
    plain = lambda c: F.when(git, "").otherwise(c)
    return {
        "name": F.when(name != "", F.lower(name)),
        "extras": plain(F.regexp_extract(bare, r"\[([^\]]*)\]", 1)),
        "specifier": plain(F.regexp_replace(F.regexp_extract(bare, r"((?:==|!=|<=|>=|~=|<|>)[^;#]*)", 1), r"\s+", "")),
    }


def prefer(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Of several sources of one dependency, the one that ranks first (lock file, requirements, project file)."""
    w = Window.partitionBy(*keys).orderBy(rank)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def stale(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content hash isn't the manifest's: a parse is needed for these only."""
    return files.join(manifest, ["file_path", "file_hash"], "left_anti")


def confusion(predicted: Column, actual: Column) -> dict[str, Column]:
    """Precision, recall, F1, false positive and negative rates and accuracy, rounded; 0 where nothing divides."""
    tp, fp, fn, tn = (F.count_if(predicted & actual), F.count_if(predicted & ~actual), F.count_if(~predicted & actual), F.count_if(~predicted & ~actual))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}
