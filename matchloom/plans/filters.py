"""Projections, filters, predicates and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from matchloom.functions.values import age_in_years, handle_key, number_or_null, season_year, slug, trigram_similarity
from matchloom.plans.base import Tables, query


@query("flt_cmp", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_linestatus NOT IN ('X') AND l_discount >= 0.05""")
def flt_cmp(t: Tables):
    li = t("lineitem")
    return li.filter(
        F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R") & ~F.col("l_linestatus").isin("X") & (F.col("l_discount") >= 0.05)
    ).select("l_orderkey", "l_linenumber", "l_quantity")


@query("flt_any", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def flt_any(t: Tables):
    wanted = t("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return t("customer").join(wanted, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("flt_null", """SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') IS NULL AS is_missing,
nullif(o_orderpriority, '1-URGENT') IS DISTINCT FROM nullif(o_orderstatus, 'F') AS differs FROM orders""")
def flt_null(t: Tables):
    a, b = F.nullif("o_orderpriority", F.lit("1-URGENT")), F.nullif("o_orderstatus", F.lit("F"))
    return t("orders").select("o_orderkey", a.isNull().alias("is_missing"), (~a.eqNullSafe(b)).alias("differs"))


@query("flt_like", """SELECT p_partkey, p_name LIKE 'P%' AS starts, p_type ILIKE '%brass%' AS holds,
regexp_matches(p_brand, '(?i)^brand#[1-3]') AS matches FROM part""")
def flt_like(t: Tables):
    return t("part").select(
        "p_partkey", F.col("p_name").like("P%").alias("starts"), F.col("p_type").ilike("%brass%").alias("holds"), F.col("p_brand").rlike("(?i)^brand#[1-3]").alias("matches")
    )


@query("flt_jsonkey", """SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k,
TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def flt_jsonkey(t: Tables):
    k = F.get_json_object("props", "$.k")
    return t("events").select("event_id", k.isNotNull().alias("has_k"), k.try_cast("double").alias("k"))


@query("flt_bool", """SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END), 6) AS share
FROM lineitem GROUP BY l_returnflag""")
def flt_bool(t: Tables):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("share"))


def where_all(df, *, years=(), mode=None, qualified=None):
    """Filters by the conditions that are asked for; no years means all, mode None means the pooled rows."""
    wanted = [F.col("season").isin(*years)] if years else []
    wanted.append(F.col("mode").isNull() if mode is None else F.col("mode") == mode)
    if qualified is not None:
        wanted.append(F.col("qualified") == qualified)
    return df.filter(reduce(lambda a, b: a & b, wanted))


@query("flt_dyn", """SELECT l_suppkey AS player, CAST(year(l_shipdate) AS INTEGER) AS season, l_returnflag AS mode, l_linestatus = 'O' AS qualified, l_quantity AS kills
FROM lineitem WHERE year(l_shipdate) IN (1995, 1996) AND l_returnflag = 'N' AND l_linestatus = 'O'""")
def flt_dyn(t: Tables):
    lines = t("lineitem").select(
        F.col("l_suppkey").alias("player"), F.year("l_shipdate").alias("season"), F.col("l_returnflag").alias("mode"), (F.col("l_linestatus") == "O").alias("qualified"), F.col("l_quantity").alias("kills")
    )
    return where_all(lines, years=(1995, 1996), mode="N", qualified=True)


@query("prj_case", """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice - 150000 ELSE 150000 - o_totalprice END AS margin FROM orders""")
def prj_case(t: Tables):
    own = F.col("o_totalprice") - 150000
    return t("orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, own).otherwise(F.lit(150000) - F.col("o_totalprice")).alias("margin"))


@query("prj_concat", "SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'A') || '#' || CAST(l_linenumber AS VARCHAR) AS natural_key FROM lineitem")
def prj_concat(t: Tables):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.nullif("l_returnflag", F.lit("A")), F.lit("#"), F.col("l_linenumber").cast("string")).alias("natural_key"))


@query("fn_conditional", """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), '?') AS status, greatest(o_custkey % 25, o_orderkey % 25) AS hi,
least(o_custkey % 25, o_orderkey % 25) AS lo FROM orders""")
def fn_conditional(t: Tables):
    a, b = F.col("o_custkey") % 25, F.col("o_orderkey") % 25
    return t("orders").select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("?")).alias("status"), F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))


@query("fn_numeric", """SELECT l_orderkey, l_linenumber, round(abs(l_discount - 0.05), 4) AS off, round(sqrt(l_quantity), 6) AS root, round(ln(1 + l_quantity), 6) AS logged,
least(greatest(l_quantity, 10), 40) AS clipped, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS logistic FROM lineitem""")
def fn_numeric(t: Tables):
    q = F.col("l_quantity")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.abs(F.col("l_discount") - 0.05), 4).alias("off"), F.round(F.sqrt(q), 6).alias("root"), F.round(F.log1p(q), 6).alias("logged"),
        F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("clipped"), F.round(1 / (1 + F.exp(-(q - 25) / 10)), 6).alias("logistic"),
    )


@query("fn_string", r"""SELECT c_custkey, lower(c_name) AS lowered, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS handle_key, levenshtein(c_name, 'Customer#000000001') <= 1 AS near FROM customer""")
def fn_string(t: Tables):
    name = F.col("c_name")
    return t("customer").select("c_custkey", F.lower(name).alias("lowered"), slug(name).alias("slug"), handle_key(name).alias("handle_key"), (F.levenshtein(name, F.lit("Customer#000000001")) <= 1).alias("near"))


@query("fn_date", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS played_on, CAST(extract(isoyear FROM o_orderdate) AS INTEGER) AS iso_year,
CAST(extract(week FROM o_orderdate) AS INTEGER) AS iso_week, CAST(month(o_orderdate) AS INTEGER) AS month,
CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS season FROM orders""")
def fn_date(t: Tables):
    d = F.col("o_orderdate")
    return t("orders").select(
        "o_orderkey", F.to_date(d).alias("played_on"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"), F.weekofyear(d).alias("iso_week"), F.month(d).alias("month"), season_year(d).alias("season")
    )


@query("fn_age", """SELECT o_orderkey, CAST(date_diff('day', DATE '1970-06-15', CAST(o_orderdate AS DATE)) AS DOUBLE) / 365.25 AS age FROM orders""")
def fn_age(t: Tables):
    return t("orders").select("o_orderkey", age_in_years(F.to_date(F.lit("1970-06-15")), F.to_date("o_orderdate")).alias("age"))


@query("fn_json", """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(strlen(props) AS BIGINT) AS bytes FROM events""")
def fn_json(t: Tables):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.octet_length("props").cast("long").alias("bytes"))


@query("fn_array", """SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS n, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS members,
list_sort(list_distinct(list(o_orderpriority)))[1] AS first_member FROM orders GROUP BY o_custkey""")
def fn_array(t: Tables):
    members = F.array_sort(F.collect_set("o_orderpriority"))
    return t("orders").groupBy("o_custkey").agg(members.alias("m")).select("o_custkey", F.size("m").alias("n"), F.array_join("m", ",").alias("members"), F.element_at("m", 1).alias("first_member"))


@query("fn_type", """SELECT l_orderkey, l_linenumber, CAST(l_discount > 0.05 AS INTEGER) AS flag, CAST(l_linenumber AS VARCHAR) AS text_number,
TRY_CAST(l_returnflag AS DOUBLE) AS bad_number FROM lineitem""")
def fn_type(t: Tables):
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") > 0.05).cast("int").alias("flag"), F.col("l_linenumber").cast("string").alias("text_number"), number_or_null(F.col("l_returnflag")).alias("bad_number")
    )


_PIECES = lambda x: f"list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, len(w) + 2)] FOR w IN regexp_extract_all(lower({x}), '[a-z0-9]+')]))"


@query("fn_trigram", f"""WITH c AS (SELECT s_suppkey, s_name, n_name, {_PIECES("s_name")} AS x, {_PIECES("n_name || ' supplier 17'")} AS y FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, round(len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE), 6) AS similarity FROM c""")
def fn_trigram(t: Tables):
    rows = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.select("s_suppkey", F.round(trigram_similarity(F.col("s_name"), F.concat("n_name", F.lit(" supplier 17"))), 6).alias("similarity"))


@query("fn_special", """SELECT p_partkey, round(((w + 1.9208) / (n + 3.8416)) - 1.96 * sqrt(w * (n - w) / n + 0.9604) / (n + 3.8416), 6) AS low,
round(((w + 1.9208) / (n + 3.8416)) + 1.96 * sqrt(w * (n - w) / n + 0.9604) / (n + 3.8416), 6) AS high
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, 60.0::DOUBLE AS n FROM part)""")
def fn_special(t: Tables):
    from matchloom.functions.statistics import wilson_interval

    low, high = wilson_interval(F.col("p_size").cast("double"), F.lit(60.0))
    return t("part").select("p_partkey", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("st_kdse", """SELECT l_suppkey AS player, CASE WHEN n >= 2 AND d > 0 AND v > 0 THEN round(sqrt(v), 6) END AS kd_se FROM (
SELECT l_suppkey, n, d, n / (n - 1.0) * (kk - 2 * k / d * kd + k / d * k / d * dd) / (d * d) AS v FROM (
SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS k, CAST(sum(l_linenumber) AS DOUBLE) AS d, sum(l_quantity * l_quantity) AS kk,
CAST(sum(l_linenumber * l_linenumber) AS DOUBLE) AS dd, sum(l_quantity * l_linenumber) AS kd FROM lineitem GROUP BY l_suppkey))""")
def st_kdse(t: Tables):
    from matchloom.functions.statistics import ratio_standard_error

    k, d = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    sums = t("lineitem").groupBy(F.col("l_suppkey").alias("player")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"), F.sum(d).alias("d"), F.sum(k * k).alias("kk"), F.sum(d * d).alias("dd"), F.sum(k * d).alias("kd")
    )
    return sums.select("player", F.round(ratio_standard_error("n", "k", "d", "kk", "dd", "kd"), 6).alias("kd_se"))


@query("st_hyper", """SELECT p_brand, CAST(count(*) AS BIGINT) AS k, round(count(*) * 40.0 / (SELECT count(*) FROM part), 6) AS expected FROM part GROUP BY p_brand""")
def st_hyper(t: Tables):
    parts = t("part")
    total = parts.agg(F.count(F.lit(1)).alias("total"))
    return parts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(total)).select("p_brand", "k", F.round(F.col("k") * 40.0 / F.col("total"), 6).alias("expected"))


@query("st_p", """SELECT n, round(2.0 / f, 9) AS ordering_p FROM (VALUES (3, 6.0), (4, 24.0), (5, 120.0), (6, 720.0)) v(n, f)""")
def st_p(t: Tables):
    return t.spark.range(3, 7).select(F.col("id").cast("int").alias("n"), F.round(F.lit(2.0) / F.factorial("id"), 9).alias("ordering_p"))
