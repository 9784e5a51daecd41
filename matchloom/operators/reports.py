"""The report builder: parameters to a report, a report to a wide table, a table to a file."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that an export holds at most; the feature's own limit, reported as truncation.
EXPORT_ROWS = 10_000


@dataclass(frozen=True)
class Report:
    metrics: tuple[str, ...]
    years: tuple[int, ...] = ()
    mode: str | None = None
    qualified: bool = True
    players: tuple[int, ...] = ()
    sort: str = ""
    descending: bool = True


def resolve(params: dict[str, str], known: list[str], presets: dict[str, dict[str, str]] | None = None) -> Report:
    """A report from URL parameters; a preset seeds those that are not given, unknown metrics and bad years are left out."""
    given = {**(presets or {}).get(params.get("preset", ""), {}), **{k: v for k, v in params.items() if v}}
    named = [m for m in (given.get("metrics") or given.get("metric", "")).split(",") if m in known]
    metrics = tuple(dict.fromkeys(named)) or tuple(known[:1])
    years = tuple(sorted({int(y) for y in given.get("years", "").split(",") if y.isdigit()}))
    players = tuple(int(p) for p in given.get("players", "").split(",") if p.isdigit())
    sort = given.get("sort", "")
    return Report(metrics, years, given.get("mode") or None, given.get("qualified", "1") != "0", players, sort if sort in metrics else metrics[0], given.get("dir", "desc") != "asc")


def wide(rows: DataFrame, report: Report) -> DataFrame:
    """player, season and per metric value, denom, z, pctl, qualified, in report order.

    rows: long metric rows. The gate looks at the sort metric and is off when players are asked for. Missing cells sort
    last in both directions; ties go by player.
    """
    kept = rows.filter(F.col("metric").isin(*report.metrics))
    kept = kept.filter(F.col("season").isin(*report.years)) if report.years else kept
    kept = kept.filter(F.col("mode").isNull() if report.mode is None else F.col("mode") == report.mode)
    kept = kept.filter(F.col("player").isin(*report.players)) if report.players else kept
    cell = F.struct("value", "denom", "z", "pctl", "qualified")
    cells = {m: F.max(F.when(F.col("metric") == m, cell)).alias(m) for m in report.metrics}  # a metric occurs once per key
    table = kept.groupBy("player", "season").agg(*cells.values())
    if report.qualified and not report.players:
        table = table.filter(F.col(f"`{report.sort}`.qualified"))
    key = F.col(f"`{report.sort}`.value")
    order = key.desc_nulls_last() if report.descending else key.asc_nulls_last()
    flat = [F.col(f"`{m}`.{f}").alias(f"{m}_{f}") for m in report.metrics for f in ("value", "denom", "z", "pctl", "qualified")]
    return table.orderBy(order, "player", "season").select("player", "season", *flat)


def exported(table: DataFrame, kind: str, limit: int = EXPORT_ROWS) -> tuple[bytes, bool]:
    """The first rows of a table as csv, json, xml or xlsx, and whether there were more."""
    rows = table.limit(limit + 1).collect()
    cut, names = len(rows) > limit, table.columns
    body = [[r[n] for n in names] for r in rows[:limit]]
    return {"csv": _csv, "json": _json, "xml": _xml, "xlsx": _xlsx}[kind](names, body), cut


def _csv(names: list[str], body: list[list]) -> bytes:
    def cell(v: object) -> str:
        s = "" if v is None else str(v)
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s

    return ("﻿" + "".join(",".join(map(cell, row)) + "\r\n" for row in [names, *body])).encode()


def _json(names: list[str], body: list[list]) -> bytes:
    import json

    return json.dumps([dict(zip(names, row)) for row in body], default=str).encode()


def _xml(names: list[str], body: list[list]) -> bytes:
    rows = ("<row>" + "".join(f"<{n}>{escape(str(v))}</{n}>" for n, v in zip(names, row) if v is not None) + "</row>" for row in body)
    return ('<?xml version="1.0" encoding="UTF-8"?><report>' + "".join(rows) + "</report>").encode()


def _xlsx(names: list[str], body: list[list]) -> bytes:
    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Report" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in [names, *body]) + "</sheetData></worksheet>",
    }
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def coverage_share(rows: DataFrame, keys: list[str], present: Column) -> DataFrame:
    """Per keys: n and the share of rows where a value is present."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(present.cast("int")).alias("share"))
