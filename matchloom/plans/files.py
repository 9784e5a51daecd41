"""Queries of readers, writers and parameters: each lays the stand-in's rows down as the files that the operator reads."""

from __future__ import annotations

import csv
import io
import json
import tarfile
import uuid

import pandas as pd
from pyspark.sql import functions as F

from matchloom.operators import quality, reports, runs
from matchloom.operators.scratch import shared_folder
from matchloom.plans.base import Tables, query
from matchloom.sources import records


def folder(t: Tables) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"


#: Three kinds of archive files, each with columns of its own.
KINDS = {"A": ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"], "N": ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"], "R": ["l_orderkey", "l_linenumber", "l_shipmode"]}


def archives(t: Tables):
    rows = t("lineitem").withColumn("l_shipmode", F.concat(F.lit("mode, "), F.col("l_linestatus")))
    paths = []
    for kind, columns in KINDS.items():
        paths.append(folder(t))
        rows.filter(F.col("l_returnflag") == kind).select(*columns).write.option("header", True).csv(paths[-1])
    return records.read_archive(t.spark, paths, ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"])


@query("src_csv", """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag <> 'R' AS has_quantity, l_returnflag = 'N' AS has_tax,
CASE l_returnflag WHEN 'A' THEN 'l_discount' WHEN 'R' THEN 'l_shipmode' ELSE '' END AS extra, CASE WHEN l_returnflag = 'R' THEN 'mode, ' || l_linestatus END AS shipmode FROM lineitem""")
def src_csv(t: Tables):
    """Columns that a file lacks are null; those that nobody asked for are kept by name."""
    rows = archives(t)
    return rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").isNotNull().alias("has_quantity"), F.col("l_tax").isNotNull().alias("has_tax"), F.array_join(F.map_keys("extras"), ",").alias("extra"), F.col("extras")["l_shipmode"].alias("shipmode"))


@query("src_row", """SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS l_quantity, CASE WHEN l_returnflag = 'N' THEN l_tax END AS l_tax FROM lineitem""")
def src_row(t: Tables):
    """The cells of the archive rows as numbers."""
    return records.typed(archives(t), ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"]).select(F.col("l_orderkey").cast("long").alias("l_orderkey"), "l_linenumber", "l_quantity", "l_tax")


@query("src_targz", "SELECT event_id, event_type, user_id FROM events")
def src_targz(t: Tables):
    """Each day's events as a gzipped tar archive of one JSON file per event, beside members that are no JSON."""

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for e, kind, user in zip(rows.event_id, rows.event_type, rows.user_id):
                body = json.dumps({"id": int(e), "type": kind, "user": {"id": int(user)}}).encode()
                for name, data in ((f"feed/{e}.json", body), (f"feed/{e}.txt", b"no json")):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"content": [out.getvalue()]})

    hours = t("events").select(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "event_id", "event_type", "user_id")  # an archive is an hour: bounded
    members = records.unpacked(hours.groupBy("day", "hour").applyInPandas(packed, "content binary"))
    of = lambda path: F.get_json_object("body", path)
    return members.select(of("$.id").cast("long").alias("event_id"), of("$.type").alias("event_type"), of("$.user.id").cast("long").alias("user_id"))


def bodies(t: Tables):
    """Feed entries in the three shapes, by event number; some without an attacker."""
    who, killer = F.concat(F.lit("p"), F.col("user_id")), F.concat(F.lit("p"), F.col("event_id") % 150)
    named = F.col("event_id") % 11 > 0
    nested = F.to_json(F.struct(F.struct(F.struct(who.alias("name")).alias("victim"), F.when(named, F.struct(killer.alias("name"))).alias("attacker")).alias("data")))
    flat = F.to_json(F.struct(F.struct(who.alias("name"), F.when(named, killer).alias("attacker_name")).alias("data")))
    shape = F.col("event_id") % 3
    at = F.floor(F.col("value") * 10).cast("long")
    return t("events").select("event_id", F.to_date("ts").alias("game"), F.hour("ts").alias("round"), at.alias("at"), F.when(shape == 0, nested).when(shape == 1, flat).otherwise(F.col("props")).alias("body"))


@query("src_xform", """SELECT o_orderkey AS series, CAST(l_linenumber % 3 AS INTEGER) AS ordinal, 'm' || (l_linenumber % 3) AS mode, l_suppkey AS player, l_quantity AS kills, l_linenumber AS deaths, l_returnflag AS flag, o_orderpriority AS event,
CAST((SELECT count(DISTINCT x.l_linenumber % 3) FROM lineitem x WHERE x.l_orderkey = o_orderkey) AS INTEGER) AS maps FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def src_xform(t: Tables):
    """Every order as the nested snapshot of a series, and back to rows of series and of lines."""
    line = F.struct(F.col("l_suppkey").alias("player"), F.col("l_quantity").alias("kills"), F.col("l_linenumber").alias("deaths"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("extras"))
    games = t("lineitem").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).alias("ordinal")).agg(F.collect_list(line).alias("lines"))
    game = F.struct("ordinal", F.concat(F.lit("m"), F.col("ordinal")).alias("mode"), "lines")
    snapshots = games.groupBy("id").agg(F.collect_list(game).alias("maps")).join(t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("event")), "id").select(F.to_json(F.struct("id", "event", "maps")).alias("body"))
    rows = records.line_rows(snapshots).withColumn("flag", F.col("extras")["flag"]).drop("extras")
    return rows.join(records.series_rows(snapshots), "series")


@query("src_probe", "SELECT event_id, CASE WHEN event_id % 3 = 2 OR event_id % 11 = 0 THEN 'none' WHEN event_id % 3 = 0 THEN 'nested' ELSE 'flat' END AS shape FROM events")
def src_probe(t: Tables):
    return bodies(t).select("event_id", records.death_shape(F.col("body")).alias("shape"))


@query("src_deaths", """WITH d AS (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'p' || user_id END AS victim, CASE WHEN event_id % 3 < 2 AND event_id % 11 > 0 THEN 'p' || (event_id % 150) END AS killer, CAST(floor(value * 10) AS BIGINT) * 100 AS time_ms FROM events)
SELECT event_id, time_ms, victim, killer, CASE WHEN killer IS NULL OR killer = victim THEN 'suicide' WHEN right(killer, 1) = right(victim, 1) THEN 'teamkill' ELSE 'normal' END AS kind FROM d WHERE victim IS NOT NULL""")
def src_deaths(t: Tables):
    """Times come in tenths of a second; players whose names end alike are one team."""
    team = lambda c: F.substring(c, -1, 1)
    return records.deaths(bodies(t), "ds", team).select("event_id", "time_ms", "victim", "killer", "kind")


@query("snk_run", """SELECT 'elo' AS model, 'v1' AS version, '2024-02' AS through, o_orderkey, o_totalprice * 2 AS value FROM orders UNION ALL SELECT 'elo', 'v2', '2024-02', o_orderkey, o_totalprice FROM orders
UNION ALL SELECT 'glicko', 'v1', '2024-01', o_orderkey, o_totalprice FROM orders""")
def snk_run(t: Tables):
    """The second run of a model, version and date replaces the first."""
    path, rows = folder(t), t("orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    runs.publish(rows, path, "elo", "v1", "2024-02")
    runs.publish(rows, path, "elo", "v2", "2024-02")
    runs.publish(rows, path, "glicko", "v1", "2024-01")
    runs.publish(rows.withColumn("value", F.col("value") * 2), path, "elo", "v1", "2024-02")
    return t.spark.read.parquet(path).select("model", "version", "through", "o_orderkey", "value")


@query("snk_export", """SELECT o_orderkey, o_orderpriority, o_totalprice, true AS cut FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10000)""")
def snk_export(t: Tables):
    """The first rows of a table in a CSV file, read back; the export holds at most EXPORT_ROWS of them and says that it was cut."""
    data, cut = reports.exported(t("orders").orderBy("o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice"), "csv")
    head, *body = csv.reader(io.StringIO(data.decode("utf-8-sig")))
    rows = [(int(r[0]), r[1], float(r[2]), cut) for r in body]
    return t.spark.createDataFrame(rows, f"{head[0]} long, {head[1]} string, {head[2]} double, cut boolean")


@query("rp_export", "SELECT n_nationkey, n_name, false AS cut, kind FROM nation, (VALUES ('csv'), ('json'), ('xml'), ('xlsx')) AS k(kind)")
def rp_export(t: Tables):
    """The same small table in each kind of file, read back."""
    import re
    import zipfile

    table = t("nation").orderBy("n_nationkey").select("n_nationkey", "n_name")
    out = []
    for kind in ("csv", "json", "xml", "xlsx"):
        data, cut = reports.exported(table, kind)
        if kind == "csv":
            cells = list(csv.reader(io.StringIO(data.decode("utf-8-sig"))))[1:]
        elif kind == "json":
            cells = [(r["n_nationkey"], r["n_name"]) for r in json.loads(data)]
        elif kind == "xml":
            cells = re.findall(r"<row><n_nationkey>(.*?)</n_nationkey><n_name>(.*?)</n_name></row>", data.decode())
        else:
            sheet = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
            cells = re.findall(r'<row><c><v>(\d+)</v></c><c t="inlineStr"><is><t xml:space="preserve">(.*?)</t></is></c></row>', sheet)
        out += [(int(k), name, cut, kind) for k, name in cells]
    return t.spark.createDataFrame(out, "n_nationkey int, n_name string, cut boolean, kind string")


SOFT = [
    quality.Check("small order", lambda t: t["orders"].filter("o_totalprice < 1000"), hard=False),
    quality.Check("idle customer", lambda t: t["customer"].select(F.col("c_custkey").alias("o_custkey")).join(t["orders"], "o_custkey", "left_anti"), hard=False),
    quality.Check("full discount", lambda t: t["lineitem"].filter("l_discount >= 0.1"), hard=False),
]


@query("qa_soft", """SELECT 'small order' AS check_name, false AS hard, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_totalprice < 1000) AS failing
UNION ALL SELECT 'idle customer', false, (SELECT CAST(count(*) AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) UNION ALL SELECT 'full discount', false, (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_discount >= 0.1)""")
def qa_soft(t: Tables):
    """Soft checks count what they find and stop nothing."""
    return quality.report(SOFT, {name: t(name) for name in ("orders", "customer", "lineitem")})
