"""Exact deduplication by whole normalised text, safe for groups that hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import table

#: White space that does not distinguish two texts: [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Shares into which each digest group is dealt before it is combined; bits of a long remember which were used.
SALTS = 64


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE_SPACE, F.coalesce(text, F.lit("")))


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_sha256, mark, salt) and their groups' verdicts: best, group_size, by digest and salt."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("raw"), normalised(text).alias("body")).select(
        "doc_id",
        "body",
        (-F.coalesce(F.char_length("raw"), F.lit(0))).alias("shorter"),
        F.sha2("body", 256).alias("text_sha256"),
        F.xxhash64("body").alias("mark"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    shares = rows.groupBy("mark", "salt", "text_sha256", "body").agg(
        F.min(F.struct("shorter", F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best"),
        F.count(F.lit(1)).alias("size"),
    )
    groups = shares.groupBy("mark", "text_sha256", "body").agg(
        F.min("best").alias("best"),
        F.sum("size").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("used"),
    )
    return rows.select("doc_id", "text_sha256", "mark", "salt"), groups.select("text_sha256", "mark", "best", "group_size", "used")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space. Of equal texts the one with the most code points
    stays, then the one with the smallest id. The groups are formed in three steps, each of which groups by digest
    and by the whole normalised text, so no digest collision can merge two texts: map tasks combine their own rows,
    the shares of a salted group are merged, and the share winners of a group are combined. A group that holds a
    third of all rows thus reaches any task as at most one row per map task. Rows then fetch their group's verdict
    by digest and salt, so that join is dealt out as well.

    Null text: empty. Null id: loses ties, and matches a null keep_id. Repeated rows (same id and text): each
    returns a row, and all rows of a group that carry its winning id are kept; keep_one_of_each() keeps one of them.
    Very long texts: compared whole. Empty table: no rows. Other columns are ignored.
    """
    rows, groups = _groups(docs, id_col, text_col)
    verdicts = groups.select(
        "text_sha256",
        "mark",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(used, s) & 1L) = 1L)")).alias("salt"),
    )
    return rows.join(verdicts, ["text_sha256", "mark", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: the one that exact_dedup() names.

    The winner is found by id, digest and length together, so a row of another text that happens to share the winner's
    id is not kept for it, nor are other rows without an id. Where several rows agree in all three, any one of them stays.
    """
    _, groups = _groups(docs, id_col, text_col)
    keys = ["__no_id", "__id", "__digest", "__shorter"]
    winners = groups.select(
        F.col("best.no_id").alias("__no_id"), F.coalesce(F.col("best.doc_id").cast("string"), F.lit("")).alias("__id"), F.col("text_sha256").alias("__digest"), F.col("best.shorter").alias("__shorter")
    )
    named = docs.select(
        F.struct(*docs.columns).alias("__row"),
        F.col(id_col).isNull().alias("__no_id"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("__digest"),
        (-F.coalesce(F.char_length(text_col), F.lit(0))).alias("__shorter"),
    )
    return named.join(winners, keys, "left_semi").dropDuplicates(keys).select("__row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(body) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""
