"""Risk scoring, routing and thresholds as pure expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Tokens of one request: (warning, critical).
REQUEST_LIMITS = (6000, 8000)
#: ratio -> (warning, critical, whether high values are the bad ones)
QUALITY_LIMITS = {"precision": (0.8, 0.7, False), "recall": (0.7, 0.6, False), "fpr": (0.2, 0.3, True)}


def _by_word(scores: dict[float, str]) -> dict[str, float]:
    return {w: s for s, words in scores.items() for w in words.split()}


SOURCE_SENSITIVITY = _by_word({1.0: "card credit password secret ssn", 0.95: "token", 0.9: "credential key", 0.85: "private", 0.8: "pii"})
SINK_SENSITIVITY = _by_word({1.0: "eval exec system", 0.95: "subprocess", 0.85: "pickle yaml.load", 0.8: "sql", 0.75: "query", 0.6: "http open request send write", 0.4: "print sink"})
WEIGHTS = {"source": 0.35, "sink": 0.25, "path": 0.25, "implicit": 0.15}
LEVELS = (("CRITICAL", 85.0), ("HIGH", 70.0), ("MEDIUM", 50.0), ("LOW", 30.0))
#: operation -> (warning, critical) in milliseconds
LATENCY_LIMITS = {"parse": (3000.0, 5000.0), "cfg_build": (7000.0, 10000.0), "llm_call": (20000.0, 30000.0), "total_scan": (90000.0, 120000.0)}


def sensitivity(name: Column, table: dict[str, float]) -> Column:
    """The greatest score of the keys that the name contains, at least 0.3."""
    return F.greatest(F.lit(0.3), *[F.when(F.contains(F.lower(name), F.lit(k)), F.lit(v)).otherwise(0.3) for k, v in table.items()])


def path_score(n: Column) -> Column:
    return F.when(n <= 2, 1.0).when(n >= 7, 0.1).otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - (n - 2) / F.lit(5.0)))


def risk_score(source: Column, sink: Column, length: Column, implicit: Column) -> Column:
    signals = (sensitivity(source, SOURCE_SENSITIVITY), sensitivity(sink, SINK_SENSITIVITY), path_score(length), F.when(implicit, 1.0).otherwise(0.0))
    return F.round(100 * sum((F.lit(w) * s for w, s in zip(WEIGHTS.values(), signals)), F.lit(0.0)), 2)


def confidence(length: Column, implicit: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.6) + F.least(F.lit(0.25), 0.05 * length) + F.when(implicit, 0.05).otherwise(0.0))


def risk_level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][1], LEVELS[0][0])
    for name, low in LEVELS[1:]:
        out = out.when(score >= low, name)
    return out.otherwise("SAFE")


def route(level: Column) -> Column:
    return F.when(level.isin("CRITICAL", "HIGH"), "LLM").otherwise("RULES")


def alert(value: Column, warning: Column, critical: Column) -> Column:
    """Null below both limits; limits are inclusive."""
    return F.when(value >= critical, "critical").when(value >= warning, "warning")


def quality_alerts(**values: Column) -> Column:
    """Array of (metric, level) for ratios named as in QUALITY_LIMITS; limits are inclusive, null ratios raise none."""
    found = []
    for k, v in values.items():
        warning, critical, high = QUALITY_LIMITS[k]
        level = alert(v, F.lit(warning), F.lit(critical)) if high else F.when(v <= critical, "critical").when(v <= warning, "warning")
        found.append(F.when(level.isNotNull(), F.struct(F.lit(k).alias("metric"), level.alias("level"))))
    return F.array_compact(F.array(*found))


def sql_sensitivity(name: str, table: dict[str, float]) -> str:
    return "greatest(0.3, " + ", ".join(f"CASE WHEN contains(lower({name}), '{k}') THEN {v} ELSE 0.3 END" for k, v in table.items()) + ")"


def sql_score(source: str, sink: str, length: str, implicit: str) -> str:
    path = f"CASE WHEN {length} <= 2 THEN 1.0::DOUBLE WHEN {length} >= 7 THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - ({length} - 2) / 5.0::DOUBLE) END"
    return f"round(100 * (0.35::DOUBLE * {sql_sensitivity(source, SOURCE_SENSITIVITY)} + 0.25::DOUBLE * {sql_sensitivity(sink, SINK_SENSITIVITY)} + 0.25::DOUBLE * {path} + 0.15::DOUBLE * CASE WHEN {implicit} THEN 1.0 ELSE 0.0 END), 2)"


def sql_level(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {low} THEN '{name}'" for name, low in LEVELS) + " ELSE 'SAFE' END"
