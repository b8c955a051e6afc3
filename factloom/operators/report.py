"""Report sinks: SARIF, Markdown, graph JSON. Rows are built in Spark; one bounded document is written by the driver."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"ERROR": "error", "WARNING": "warning", "INFO": "note"}
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: Findings of one document; more are an error: write the rows instead.
MOST_FINDINGS = 100_000


def level(verdict: Column, severity: Column) -> Column:
    """A verdict decides, else the severity."""
    v = F.lower(verdict)
    return F.when(v == "true positive", "error").when(v == "false positive", "note").otherwise(F.when(severity == "ERROR", "error").when(severity == "INFO", "note").otherwise("warning"))


def with_insights(findings: DataFrame, insights: DataFrame) -> DataFrame:
    """The last insight on each (file, check) beside its findings. insights: file_path, check_id, seq, verdict, text.

    Merged, never broadcast: Spark takes the tables of a parse for far smaller than they are."""
    last = insights.groupBy("file_path", "check_id").agg(F.max_by(F.struct("verdict", "text"), "seq").alias("i"))
    return findings.join(last.hint("merge"), ["file_path", "check_id"], "left").select(*findings.columns, F.col("i.verdict").alias("verdict"), F.col("i.text").alias("insight"))


def sarif_rows(findings: DataFrame) -> DataFrame:
    """A JSON result per finding (check_id, severity, file_path, line, column, verdict)."""
    region = F.struct(F.col("line").alias("startLine"), (F.col("column") + 1).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select("file_path", "line", F.to_json(F.struct(F.col("check_id").alias("ruleId"), level(F.col("verdict"), F.col("severity")).alias("level"), F.struct(F.col("check_id").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def fix_region(line: Column, column: Column, old: Column) -> Column:
    """Deleted range of a fix: it ends after the first line of the old text at least."""
    first = F.get(F.split(old, "\n"), F.lit(0))
    lines = F.size(F.split(old, "\n"))
    return F.struct(line.alias("startLine"), column.alias("startColumn"), (line + lines - 1).alias("endLine"), F.greatest(column + F.length(first), column).alias("endColumn"))


def sarif(findings: DataFrame, tool: str = "factloom") -> str:
    """One SARIF 2.1.0 document with each rule once, in order of first sight."""
    rows = sarif_rows(findings).orderBy("file_path", "line", "result").limit(MOST_FINDINGS + 1).collect()
    if len(rows) > MOST_FINDINGS:
        raise ValueError("too many findings for one document; write sarif_rows as a table")
    results = [json.loads(r["result"]) for r in rows]
    rules = list(dict.fromkeys(r["ruleId"] for r in results))
    driver = {"rules": [{"id": x} for x in rules], "name": tool}
    one = {"results": results, "tool": {"driver": driver}}
    return json.dumps({"$schema": SCHEMA, "runs": [one], "version": "2.1.0"}, indent=2)


def markdown_rows(findings: DataFrame) -> DataFrame:
    """A table line per finding."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\n]", " ")
    return findings.select("file_path", "line", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("severity", "check_id", "file_path", "line")]), F.lit(" |")).alias("row"))


def markdown(findings: DataFrame) -> str:
    rows = markdown_rows(findings).orderBy("file_path", "line", "row").limit(MOST_FINDINGS + 1).collect()
    if len(rows) > MOST_FINDINGS:
        raise ValueError("too many findings for one document; write markdown_rows as a table")
    return "\n".join(["# Findings", "", f"Total: {len(rows)}", "", "| severity | check | file | line |", "|-|-|-|-|", *(r["row"] for r in rows)]) + "\n"


def graph_rows(trace: DataFrame) -> DataFrame:
    """Nodes and edges of traces as JSON, a row per flow."""
    node = F.struct("id", F.col("version").alias("label"), "kind")
    edge = F.struct(F.col("previous").alias("from"), F.col("id").alias("to"), F.lit("taint").alias("type"))
    return trace.groupBy("file_path", "seq").agg(F.to_json(F.struct(F.array_sort(F.collect_list(node)).alias("nodes"), F.array_sort(F.collect_list(F.when(F.col("previous").isNotNull(), edge))).alias("edges"))).alias("graph"))


class Reports:
    """Named report makers over one table of findings; plugins add their own."""

    def __init__(self):
        self.makers: dict[str, Callable[[DataFrame], str]] = {"sarif": sarif, "markdown": markdown}

    def register(self, name: str, maker: Callable[[DataFrame], str]) -> None:
        self.makers[name] = maker

    def make(self, findings: DataFrame, names: list[str] | None = None) -> dict[str, str]:
        return {n: self.makers[n](findings) for n in names or self.makers}
