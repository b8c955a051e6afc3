"""State machines over ordered events: budgets, cooldowns, breakers, caches; windows over streams.

A machine whose next state depends on its own decisions reads the events of a key in order. In a batch the rows are
partitioned by key and sorted, and a task steps through them with one state at a time, so that no key's rows are ever held;
on a stream the state is kept between batches. Both use the plain step functions below, so that they can't differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.graphs import shared_dir


def _micros(at: Column) -> Column:
    """Microseconds of a timestamp with or without a zone (the session's is UTC)."""
    return F.unix_micros(at.cast("timestamp"))


def fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, added: str) -> DataFrame:
    """All rows with the columns that ``step(state, row) -> (state, values)`` gives, each key from its own start, in order; null is a key.

    ``added`` names and types these columns. A hot key takes one task, as its machine is sequential, but bounded memory."""
    names = [c.split()[0] for c in added.split(", ")]
    mark = "_key_of_fold"  # a text: pandas would make a null number unequal to itself
    text = F.when(F.col(key).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(key).cast("string")))

    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = None, object()
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if state is None or row[-1] != last:
                    state, last = start(), row[-1]
                state, values = step(state, row)
                out.append(values)
            yield pdf.drop(columns=mark).assign(**{n: [v[i] for v in out] for i, n in enumerate(names)})

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", " + added
    return rows.withColumn(mark, text).repartition(mark).sortWithinPartitions(mark, *order).mapInPandas(kernel, schema)


def budget_admission(requests: DataFrame, key: str, order: list[str], cost: str, most: int, actual: str | None = None, price: float = 0.0, most_price: float | None = None) -> DataFrame:
    """Adds admitted and spent_before: a request is admitted if it fits in what is left; a rejected one spends nothing.

    ``cost`` is an estimate (null: 0). Where the column ``actual`` isn't null, an admitted request has spent that in the end.
    With ``most_price``, what 1000 units cost at ``price`` must fit in it too."""
    at, used = requests.columns.index(cost), None if actual is None else requests.columns.index(actual)
    whole = lambda x: 0 if pd.isna(x) else int(x)

    def step(spent: int, row: tuple) -> tuple[int, tuple[bool, int]]:
        wanted = spent + whole(row[at])
        ok = wanted <= most and (most_price is None or wanted / 1000 * price <= most_price)
        after = wanted if used is None or pd.isna(row[used]) else spent + whole(row[used])
        return (max(0, after) if ok else spent), (ok, spent)

    return fold(requests, key, order, int, step, "admitted boolean, spent_before long")


def cooldown(events: DataFrame, key: str, at: str, limited: Column, seconds: int = 60) -> DataFrame:
    """Adds blocked: a rate-limit event lies in the seconds before (that moment included, the event itself not)."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(limited, F.col(at)), ignorenulls=True).over(w)
    return events.withColumn("blocked", F.coalesce(_micros(F.col(at)) - _micros(last) < seconds * 1_000_000, F.lit(False)))


def breaker_step(state: tuple[str, int, float], now: float, failed: bool, most: int = 3, wait: float = 30.0) -> tuple[tuple[str, int, float], bool, str]:
    """(state, failures, opened at) -> the next, whether the call was allowed, and the state in which it was tried."""
    name, failures, opened = state
    if name == "OPEN" and now - opened >= wait:
        name = "HALF_OPEN"
    if name == "OPEN":
        return (name, failures, opened), False, name
    if not failed:
        return ("CLOSED", 0, opened), True, name
    if name == "HALF_OPEN" or failures + 1 >= most:
        return ("OPEN", failures + 1, now), True, name
    return (name, failures + 1, opened), True, name


BREAKER = "key string, event_id long, allowed boolean, tried_in string, state string"


def circuit_breaker(events: DataFrame) -> DataFrame:
    """Runs a breaker per key over columns key, event_id, now (seconds) and failed; batch form."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple[bool, str, str]]:
        state, allowed, tried = breaker_step(state, row.now, row.failed)
        return state, (allowed, tried, state[0])

    rows = events.select("key", "event_id", "now", "failed")
    return fold(rows, "key", ["now", "event_id"], lambda: ("CLOSED", 0, 0.0), step, "allowed boolean, tried_in string, state string").drop("now", "failed")


def circuit_breaker_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, with the breaker's state kept between batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def kernel(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("CLOSED", 0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["now", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            now, allowed, tried = breaker_step(now, r.now, r.failed)
            out.append((r.key, r.event_id, allowed, tried, now[0]))
        state.update(now)
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "tried_in", "state"])

    return events.select("key", "event_id", "now", "failed").groupBy("key").applyInPandasWithState(kernel, BREAKER, "name string, failures long, opened double", "append", GroupStateTimeout.NoTimeout)


def fresh(entries: DataFrame, now: Column, at: str, ttl: Column) -> Column:
    """Whether a cache entry still counts; a null time to live never ends, the last moment counts."""
    return ttl.isNull() | (_micros(now) - _micros(F.col(at)) <= ttl.cast("long") * 1_000_000)


def operation_windows(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Count, sum and greatest value per operation and window; on a stream, late events within the watermark still count."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "most")


def stream_to_table(spark: SparkSession, folder: str, glob: str, schema, transform, name: str) -> DataFrame:
    """Runs a transform over a file stream to its end, and returns what it appended or completed, as a table in the shared folder.

    Each batch is a folder of its own that a retry writes anew; of a complete result the last one counts."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = transform(spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder))
    complete, done = transform is operation_windows, []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        done.append(number)

    query = made.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").outputMode("complete" if complete else "append").trigger(availableNow=True).start()
    query.awaitTermination()
    paths = [f"{root}/out/batch={n}" for n in ([max(done)] if complete and done else sorted(set(done)))]
    return spark.read.schema(made.schema).parquet(*paths) if paths else spark.createDataFrame([], made.schema)
