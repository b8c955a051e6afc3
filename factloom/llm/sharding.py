"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring has a fixed number of places. A key's place is its hash; its home is the shard of the first virtual node at or
clockwise of that place. The rows of each place are counted (a table bounded by the ring, not by the data), and the driver
lays out which ranks of each place go to which shard: a shard takes rows until it is full, and what is left continues
clockwise to the next virtual node whose shard has room. Each row then needs only its rank within its place.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import small

PLACES, VNODES = 1 << 14, 64
#: Rows of a place beyond which it is ranked in so many parts.
HOT_ROWS, PARTS = 1_000_000, 256


def virtual_nodes(shards: int, vnodes: int = VNODES, places: int = PLACES, seed: int = 0) -> list[tuple[int, int]]:
    """(place, shard) in ring order; a shard's places don't depend on the other shards."""
    return sorted((xxhash.xxh64_intdigest(f"{s}/{v}", seed) % places, s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, load_factor: float = 1.0) -> list[int]:
    """Most rows of each shard. At a factor of 1 they sum to the rows, so that counts end at most one apart."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-rows * load_factor // shards)] * shards


def layout(counts: dict[int, int], shards: int, load_factor: float = 1.0, vnodes: int = VNODES, places: int = PLACES) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, first slot) that cover every rank of every place once."""
    ring = virtual_nodes(shards, vnodes, places)
    at = [p for p, _ in ring]
    room, used, out = capacities(sum(counts.values()), shards, load_factor), [0] * shards, []
    wait = [(p, 0, n, bisect_left(at, p) % len(ring)) for p, n in sorted(counts.items()) if n]
    while wait:
        later = []
        for place, lo, end, node in wait:
            shard = ring[node][1]
            take = min(end - lo, room[shard])
            if take:
                out.append((place, lo, lo + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if lo + take < end:
                later.append((place, lo + take, end, (node + 1) % len(ring)))
        wait = later
    return out


def assign_shards(rows: DataFrame, shards: int, key: list[Column], tie: list[Column], load_factor: float = 1.0, hot: int = HOT_ROWS) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in its shard) to all rows; columns of these names are replaced.

    ``key`` places a row, ``tie`` orders the rows of one place. Null keys share one place and are bounded as any; a place of
    more than ``hot`` rows is ranked in parts by hash of key and tie, so that no task ranks it alone. Rows equal in both are
    interchangeable, and repeated rows are rows of their own. Other columns pass through, whatever their names. An empty table
    gives none. Shuffles: one of a bounded count (two where a place is hot), one for the ranks."""
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    whole = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row")
    ties = [t.alias(f"t{i}") for i, t in enumerate(tie)]
    df = rows.select(whole, F.pmod(F.xxhash64(*key), F.lit(PLACES)).cast("int").alias("place"), F.xxhash64(*key).alias("hash"), F.pmod(F.xxhash64(*key, *tie), F.lit(PARTS)).cast("int").alias("part"), *ties)
    counts = {r["place"]: r["n"] for r in df.groupBy("place").agg(F.count("*").alias("n")).collect()}  # at most PLACES rows
    large = sorted(p for p, n in counts.items() if n > hot)
    df = df.withColumn("part", F.when(F.col("place").isin(large), F.col("part")).otherwise(0)) if large else df.withColumn("part", F.lit(0))
    before = []
    if large:
        seen = dict.fromkeys(large, 0)
        for r in sorted(df.filter(F.col("place").isin(large)).groupBy("place", "part").agg(F.count("*").alias("n")).collect()):  # at most PARTS rows of each hot place
            before.append((r["place"], r["part"], seen[r["place"]]))
            seen[r["place"]] += r["n"]
    rank = (F.row_number().over(Window.partitionBy("place", "part").orderBy("hash", *[f"t{i}" for i in range(len(tie))])) - 1).cast("long")
    ranked = df.select("row", "place", "part", rank.alias("rank"))
    if before:
        offsets = spark.createDataFrame(before, "place int, part int, before long")
        ranked = ranked.join(small(offsets), ["place", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    plan = spark.createDataFrame(layout(counts, shards, load_factor), "at int, lo long, end long, shard int, base long")
    # at most PLACES rows and one for each time a place is cut
    on = ranked.join(small(plan), F.col("place") == F.col("at")).filter("rank >= lo AND rank < end")
    on = on.select("row", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
    return on.select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", "slot")
