"""Extension points: framework detectors, stages with hooks before and after, model calls with a fallback chain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.pyfacts import SANITIZERS

Transform = Callable[[DataFrame], DataFrame]
STAGES = tuple("static_scan external_scan ir graph_build baseline ssa taint llm privacy".split())
EVENTS = ("pre_analysis", *(f"{when}_{s}" if when else s for s in STAGES for when in ("pre", "", "post")), "post_analysis")
BANNED = ("as an ai", "i cannot verify", "hypothetical file", "imaginary")


@dataclass
class Pipeline:
    """Transforms hung on ordered events. A transform may set the boolean column ``stopped``; such rows skip what follows and stay."""

    hooks: dict[str, list[Transform]] = field(default_factory=dict)

    def on(self, event: str, transform: Transform) -> None:
        if event not in EVENTS:
            raise ValueError(f"no such event: {event}")
        self.hooks.setdefault(event, []).append(transform)

    def run(self, files: DataFrame) -> DataFrame:
        df = files if "stopped" in files.columns else files.withColumn("stopped", F.lit(False))
        for event in EVENTS:
            for f in self.hooks.get(event, ()):
                df = f(df.filter(~F.col("stopped"))).unionByName(df.filter("stopped"), allowMissingColumns=True)
        return df


@dataclass
class Frameworks:
    """Framework name -> predicate on a column of lower-case dependency names."""

    detectors: dict[str, Callable[[Column], Column]] = field(default_factory=lambda: {n: (lambda c, n=n: F.exists(c, lambda d: d.startswith(n))) for n in ("django", "flask", "fastapi")})

    def register(self, name: str, detect: Callable[[Column], Column]) -> None:
        self.detectors[name] = detect

    def detect(self, dependencies: Column) -> Column:
        return F.array_compact(F.array(*[F.when(f(dependencies), n) for n, f in self.detectors.items()]))


@dataclass
class Sanitizers:
    """Sanitizer name -> kind; a broadcast lookup."""

    kinds: dict[str, str] = field(default_factory=lambda: {name: kind for kind, names in SANITIZERS.items() for name in names})

    def register(self, name: str, kind: str) -> None:
        self.kinds[name] = kind

    def kind(self, name: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in self.kinds.items() for x in kv]), name)


def gate(files: DataFrame, most_lines: int) -> DataFrame:
    """Files of more lines are stopped."""
    return files.withColumn("stopped", F.size(F.split("source", "\n")) > most_lines)


def invented(answer: Column) -> Column:
    """Whether an answer has a phrase that marks it as invented."""
    return F.exists(F.array(*[F.lit(w) for w in BANNED]), lambda w: F.contains(F.lower(answer), w))


def prompt(code: Column, finding: Column, context: Column) -> Column:
    return F.format_string("Finding: %s\nContext: %s\nCode:\n%s\nAnswer with a JSON object of verdict, confidence and reason.", finding, context, code)


def cache_key(**parts: Column) -> Column:
    """SHA-256 of the sorted-key JSON of the parts, separated as Python's json does."""
    items = [F.concat(F.lit(f'"{k}": '), F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)) for k, v in sorted(parts.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}")), 256)


def answered(requests: DataFrame, cache: DataFrame, providers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Requests (key, prompt) with response and provider: from the cache, else from the first provider that answers.

    A provider maps (key, prompt) to (key, response), null where it fails; only what is still open reaches the next."""
    out = requests.join(cache.select("key", "response"), "key", "left").withColumn("provider", F.when(F.col("response").isNotNull(), "cache"))
    for i, call in enumerate(providers):
        open_ = out.filter("response IS NULL").select("key", "prompt")
        found = call(open_).select("key", F.col("response").alias("_r"))
        out = out.join(found, "key", "left").select("key", "prompt", F.coalesce("response", "_r").alias("response"), F.coalesce("provider", F.when(F.col("_r").isNotNull(), f"provider{i}")).alias("provider"))
    return out


def stub(module: Column, functions: Column) -> Column:
    """Text of a type stub: a class where the first letter is upper case, else a function."""
    first = lambda f: F.substring(f, 1, 1)
    line = lambda f: F.when((first(f) == F.upper(first(f))) & (first(f) != F.lower(first(f))), F.concat(F.lit("class "), f, F.lit(": ..."))).otherwise(F.concat(F.lit("def "), f, F.lit("(*args, **kwargs): ...")))
    return F.concat(F.lit("# "), module, F.lit("\n"), F.array_join(F.transform(F.array_sort(F.array_distinct(functions)), line), "\n"))
