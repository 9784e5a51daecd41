"""Shards of fixed capacity: indivisible groups are packed by best fit, largest first, over a bounded histogram of sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.operators.ordering import numbered
from matchloom.operators.scratch import forget, written
from matchloom.session import table

#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Sizes are rounded up to so many binary digits, so there are at most 2048 + 1024 * 52 different ones, whatever the data;
#: sizes below 2048 stay as they are, and others grow by less than a thousandth.
DIGITS = 11
#: Shares into which a group's rows are dealt where they meet their group; bits of a long remember which were used.
SALTS = 64


class Rooms:
    """Open shards by the room they have left: a balanced search tree (a treap with hashed priorities).

    A key is a room; a node holds the runs (first shard, shards) of consecutive shards that have it.
    """

    def __init__(self):
        self.root: list | None = None  # [room, priority, left, right, runs]

    @staticmethod
    def _split(node: list | None, room: int) -> tuple[list | None, list | None]:
        """The nodes of less room, and the others."""
        if node is None:
            return None, None
        if node[0] < room:
            node[3], rest = Rooms._split(node[3], room)
            return node, rest
        rest, node[2] = Rooms._split(node[2], room)
        return rest, node

    @staticmethod
    def _joined(low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = Rooms._joined(low[3], high)
            return low
        high[2] = Rooms._joined(low, high[2])
        return high

    def add(self, room: int, first: int, shards: int) -> None:
        node = self.root
        while node is not None and node[0] != room:
            node = node[2] if room < node[0] else node[3]
        if node is not None:
            node[4].append((first, shards))
            return
        low, high = self._split(self.root, room)
        fresh = [room, hash((room, 0x9E3779B9)), None, None, [(first, shards)]]
        self.root = self._joined(self._joined(low, fresh), high)

    def take(self, size: int) -> tuple[int, int, int] | None:
        """Removes a run of the tightest shards that have room for the size: room, first shard, shards."""
        node, best = self.root, None
        while node is not None:
            node, best = (node[2], node) if node[0] >= size else (node[3], best)
        if best is None:
            return None
        first, shards = best[4].pop()
        if not best[4]:
            low, rest = self._split(self.root, best[0])
            _, high = self._split(rest, best[0] + 1)
            self.root = self._joined(low, high)
        return best[0], first, shards


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int] | None:
    """The plan (size, start, stop, per_shard, first_shard) and the number of shards; None if they are more than most.

    sizes: (size, number of groups), largest first. Of the groups of a size, those numbered start <= i < stop go to shard
    first_shard + (i - start) // per_shard. A group of a size enters the shard with the least room that still holds it,
    and the next one of that size the same shard, as it is then the tightest of all: equal sizes are placed in one
    step a run of equal shards, so the work follows the number of different sizes. Larger groups than the capacity have a shard each.
    """
    rooms, opened, plan = Rooms(), 0, []
    for size, groups in sizes:
        at = 0
        if size > capacity:
            plan.append((size, 0, groups, 1, opened))
            opened, at = opened + groups, groups
        while at < groups:
            room, first, shards = rooms.take(size) or (capacity, opened, -(-(groups - at) // (capacity // size)))
            opened = max(opened, first + shards)
            per_shard = room // size
            filled = min(shards, (groups - at) // per_shard)
            stop = at + filled * per_shard if filled else groups
            plan.append((size, at, stop, per_shard, first))
            rooms.add(room - min(per_shard, stop - at) * size, first, max(1, filled))
            if shards > max(1, filled):
                rooms.add(room, first + max(1, filled), shards - max(1, filled))
            at = stop
        if most is not None and opened > most:
            return None
    return plan, opened


def least_capacity(sizes: list[tuple[int, int]], shards: int) -> int:
    """A capacity at which best fit needs no more shards, such that a byte less needs more.

    The search starts at the bound: groups that are larger than an equal share of what is left have a shard each, and
    the others share the rest of the shards.
    """
    total, free = sum(size * n for size, n in sizes), shards
    alone = ((size, n) for size, n in sizes)
    for size, n in alone:
        gone = 0
        while gone < n and free > 1 and size * free > total:
            total, free, gone = total - size, free - 1, gone + 1
        if gone < n:
            break
    low = max(1, -(-total // free)) - 1  # too small, or not tried
    step = 1
    while best_fit_decreasing(sizes, low + step, shards) is None:
        low, step = low + step, 2 * step
    high = low + step
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if best_fit_decreasing(sizes, middle, shards) else (middle, high)
    return high


def size_class(size: Column) -> Column:
    """The size, rounded up to DIGITS binary digits."""
    zeros = F.greatest(F.length(F.bin(size)) - DIGITS, F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), zeros)
    return F.call_function("shiftleft", F.call_function("shiftright", size + unit - 1, zeros), zeros)


def best_fit_shards(docs: DataFrame, capacity: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot, and row, a struct of the columns named in keep.

    capacity: the bytes of a shard; as few shards as best fit decreasing needs are filled. shards: their number; the least
    capacity is searched for with which best fit needs no more, so that their sizes are as equal as the groups permit.
    One of the two is given.

    size is the text's UTF-8 bytes and ROW_BYTES. Rows of equal texts (by SHA-256) are a group, which no shard boundary
    divides. Groups are summed where they lie and meet by digest; their sizes, rounded up by size_class(), make a histogram
    of bounded length. It alone is packed on the driver. Groups are then numbered within their size over range partitions
    and look their shard up; their rows fetch it by digest and salt, so that a group of a third of all rows is dealt over
    many tasks. slot numbers a shard's rows from 0, by id, over range partitions. No group is gathered anywhere.

    A group larger than the capacity has a shard of its own, which then exceeds it; no other shard does. Null text: empty,
    and in one group with empty texts. Null id: numbered first. Repeated rows: each has its slot. Very long texts: whole;
    only digests are shuffled unless text is kept. Empty table: no rows. Other columns are ignored, and clash with nothing.
    """
    if (capacity is None) == (shards is None) or min(capacity or 1, shards or 1) < 1:
        raise ValueError("give a capacity of a byte or more, or a number of shards of one or more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt"),
        *([F.struct(*keep).alias("row")] if keep else []),
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("used"))
    groups = written(groups.select("digest", size_class(F.col("bytes")).alias("size_class"), "rows", "used"))
    sizes = sorted(((r["size_class"], r["n"]) for r in groups.groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    plan, _ = best_fit_decreasing(sizes, capacity if capacity is not None else least_capacity(sizes, shards)) if sizes else ([], 0)
    before, upto = {}, 0
    for size, n in reversed(sizes):
        before[size], upto = upto, upto + n
    runs = docs.sparkSession.createDataFrame([(s, before[s] + start, before[s] + stop, per, first) for s, start, stop, per, first in plan], "size_class long, start long, stop long, per_shard long, first_shard long")
    placed = numbered(groups, ["size_class", "digest"], "n").join(runs, "size_class").filter("n > start and n <= stop")
    placed = written(placed.select("digest", "rows", "used", F.expr("cast(first_shard + (n - 1 - start) div per_shard as int)").alias("shard")))
    forget(groups)
    counts = placed.groupBy("shard").agg(F.sum("rows").alias("rows"))
    starts = counts.select("shard", (F.sum("rows").over(Window.orderBy("shard")) - F.col("rows")).alias("before"))
    of_salts = placed.select("digest", "shard", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(used, s) & 1L) = 1L)")).alias("salt"))
    found = numbered(rows.join(of_salts, ["digest", "salt"]).drop("salt"), ["shard", "doc_id", "digest"], "n").join(starts, "shard")
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("n") - 1 - F.col("before")).alias("slot"), *(["row"] if keep else []))


def write_shards(placed: DataFrame, folder: str) -> None:
    """Writes the rows of best_fit_shards(), with the columns it kept, as one Parquet folder a shard, in the order of slots.

    Rows are dealt by ranges of (shard, slot), so a large shard is written by several tasks, each a run of its slots.
    """
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = best_fit_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
