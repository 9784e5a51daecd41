"""Readers and normalisers of match records."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions.values import cell_number

#: Factors from a feed's time unit to milliseconds.
TIME_UNITS = {"ms": 1, "ds": 100}


def read_archive(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Per-event CSV files with a header, one row per player-map; the columns vary by file and all stay text.

    Each path (a file, or a folder of files with one header) is read with its own header, and the plans are united by name;
    columns that a file lacks are null, and those that are not asked for go to extras by name.
    """
    out = None
    for path in paths:
        one = spark.read.csv(path, header=True, encoding="UTF-8", inferSchema=False, enforceSchema=False)
        one = one.toDF(*(c.lstrip("﻿").strip() for c in one.columns))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    have = set(out.columns)
    return out.select(*(F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns), F.map_filter(F.create_map(*(x for c in out.columns if c not in columns for x in (F.lit(c), F.col(f"`{c}`")))) if have - set(columns) else F.create_map().cast("map<string,string>"), lambda k, v: v.isNotNull() & (v != "") & (v != "0.0%")).alias("extras"))


def typed(rows: DataFrame, numbers: list[str]) -> DataFrame:
    """The named cells as numbers: empty cells and 0.0% are missing, % and m are stripped."""
    return rows.withColumns({c: cell_number(F.col(c)) for c in numbers})


def read_tarballs(spark: SparkSession, path: str) -> DataFrame:
    """name, body: the JSON members of the gzipped tar archives of a path; see unpacked()."""
    return unpacked(spark.read.format("binaryFile").load(path))


def unpacked(archives: DataFrame) -> DataFrame:
    """name, body: the JSON members of tar archives (content), members streamed one by one."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r:*") as tar:
                    for member in tar:
                        if member.isfile() and member.name.endswith(".json"):
                            body = json.dumps(json.load(tar.extractfile(member)), separators=(",", ":"))
                            yield pa.RecordBatch.from_arrays([pa.array([member.name]), pa.array([body])], ["name", "body"])

    return archives.select("content").mapInArrow(unpack, "name string, body string")


def death_shape(body: Column) -> Column:
    """nested, flat or none: how a feed entry names the attacker."""
    return F.when(F.get_json_object(body, "$.data.attacker").isNotNull(), "nested").when(F.get_json_object(body, "$.data.attacker_name").isNotNull(), "flat").otherwise("none")


def death_kind(victim: Column, killer: Column, victim_team: Column, killer_team: Column) -> Column:
    """suicide, teamkill or normal."""
    return F.when(killer.isNull() | (killer == victim), "suicide").when(victim_team == killer_team, "teamkill").otherwise("normal")


def deaths(entries: DataFrame, unit: str, team: Callable[[Column], Column]) -> DataFrame:
    """The entries (at, body, ...) that name a victim, with time_ms, victim, killer and kind.

    A nested entry names both sides in objects of their own, a flat one in plain fields; other entries are no deaths.
    unit: that of at, a key of TIME_UNITS; team: the side of a player's name.
    """
    of = lambda path: F.get_json_object("body", path)
    named = entries.withColumns({
        "time_ms": F.col("at") * TIME_UNITS[unit],
        "victim": F.coalesce(of("$.data.victim.name"), of("$.data.name")),
        "killer": F.coalesce(of("$.data.attacker.name"), of("$.data.attacker_name")),
    }).filter("victim is not null")
    return named.withColumn("kind", death_kind(F.col("victim"), F.col("killer"), team("victim"), team("killer")))


#: A series snapshot: its maps, and the lines of its players on each.
SNAPSHOT = "id long, event string, maps array<struct<ordinal:int,mode:string,lines:array<struct<player:long,kills:double,deaths:int,extras:map<string,string>>>>>"


def series_rows(snapshots: DataFrame) -> DataFrame:
    """series, event, maps (their number) of snapshots (body)."""
    s = snapshots.select(F.from_json("body", SNAPSHOT).alias("s")).filter("s.id is not null")
    return s.select(F.col("s.id").alias("series"), F.col("s.event").alias("event"), F.coalesce(F.size("s.maps"), F.lit(0)).alias("maps"))


def line_rows(snapshots: DataFrame) -> DataFrame:
    """series, ordinal, mode, player, kills, deaths, extras: a row per player and map of snapshots (body)."""
    maps_ = snapshots.select(F.from_json("body", SNAPSHOT).alias("s")).select(F.col("s.id").alias("series"), F.inline("s.maps"))
    return maps_.select("series", "ordinal", "mode", F.inline("lines"))


def rounds(marks: DataFrame) -> DataFrame:
    """game, round, score1, score2, started, ended, winner_side (0: none) from start and end marks with cumulative scores."""
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    r = marks.groupBy("game", "round").agg(at("roundend", "score1").alias("score1"), at("roundend", "score2").alias("score2"), at("roundstart", "time_ms").alias("started"), at("roundend", "time_ms").alias("ended"))
    w = Window.partitionBy("game").orderBy("round")
    d1, d2 = (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in ("score1", "score2"))
    return r.withColumn("winner_side", F.when(d1 > d2, 1).when(d2 > d1, 2).otherwise(0))


def without_repeats(series: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Series (id, catalogue, pair, day) without those that a better catalogue also has, a day before or after at most.

    ranks: smaller is better. Series of one catalogue never push each other out.
    """
    rank = F.create_map(*(x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))))
    own = series.withColumn("rank", rank[F.col("catalogue")])
    better = own.select("pair", F.col("rank").alias("r"), F.explode(F.array(*(F.date_add("day", d) for d in (-1, 0, 1)))).alias("day")).distinct()
    beaten = own.join(better, ["pair", "day"]).filter("r < rank").select("id").distinct()
    return series.join(beaten, "id", "left_anti")


def linked(a: DataFrame, b: DataFrame, gap_days: int = 1) -> DataFrame:
    """a, b: maps (id, map, mode, day, players) of two sources that are one: the best overlap of players for both.

    Only pairs that are each other's single best within the gap are linked; ties are left unlinked.
    """
    right = b.select(F.col("id").alias("b"), "map", "mode", F.col("day").alias("day_b"), F.col("players").alias("pb"))
    near = right.withColumn("day", F.explode(F.expr(f"transform(sequence({-gap_days}, {gap_days}), d -> date_add(day_b, d))")))
    pairs = a.select(F.col("id").alias("a"), "map", "mode", "day", "players").join(near, ["map", "mode", "day"]).withColumn("shared", F.size(F.array_intersect("players", "pb"))).filter("shared > 0")
    best = lambda k: F.rank().over(Window.partitionBy(k).orderBy(F.desc("shared")))
    top = pairs.select("a", "b", best("a").alias("ra"), best("b").alias("rb")).filter("ra = 1 and rb = 1")
    alone = lambda k: F.count(F.lit(1)).over(Window.partitionBy(k))
    return top.withColumns({"na": alone("a"), "nb": alone("b")}).filter("na = 1 and nb = 1").select("a", "b")


def venue(curated: Column, provider: Column) -> Column:
    """Whether an event is on a LAN: the curated verdict, else the provider's type, else unknown."""
    return F.coalesce(curated, F.when(F.lower(provider).isin("offline", "lan"), True).when(F.lower(provider) == "online", False))


def spellings(names: DataFrame) -> DataFrame:
    """key, spelling: the commonest spelling of each normalised handle, the smallest of equals."""
    from matchloom.functions.values import handle_key

    n = names.select(handle_key(F.col("handle")).alias("key"), "handle").groupBy("key", "handle").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("key").agg(F.min_by("handle", F.struct(-F.col("n"), "handle")).alias("spelling"))
