"""Kill-feed operators: trades, round winners, clutches, advantages, state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A death is traded if its killer dies within so many milliseconds, the end included.
TRADE_MS = 5000
#: Opponents against which a last survivor is in a clutch.
CLUTCH_OPPONENTS = 4


def in_order(deaths: DataFrame) -> DataFrame:
    """Adds ord, the place of a death in its game; feed order is round, time, seq, unknown times last."""
    order = Window.partitionBy("game").orderBy(F.asc_nulls_last("round"), F.asc_nulls_last("time_ms"), F.asc_nulls_last("seq"))
    return deaths.withColumn("ord", F.row_number().over(order))


def reconciled(lines: DataFrame, deaths: DataFrame) -> DataFrame:
    """The lines (game, player, deaths) of games with a feed, with matches: box deaths equal the normal feed deaths."""
    counts = deaths.filter("kind = 'normal'").groupBy("game", F.col("victim").alias("player")).agg(F.count(F.lit(1)).alias("feed_deaths"))
    fed = lines.join(deaths.select("game").distinct(), "game", "left_semi")
    return fed.join(counts, ["game", "player"], "left").withColumns({
        "feed_deaths": F.coalesce("feed_deaths", F.lit(0)),
        "matches": F.col("deaths") == F.coalesce("feed_deaths", F.lit(0)),
    })


def trades(deaths: DataFrame, teams: DataFrame, window_ms: int = TRADE_MS) -> DataFrame:
    """Each death with traded and answered, and the trader if traded.

    deaths: game, round, time_ms, seq, victim, killer. The killer's first death after this one, in the same round and
    within the window, answers this kill; if the player who made it was on the victim's side (both unknown counts as
    one side) this death is traded. The feed is read up to the first death without a time after this one.
    """
    feed = in_order(deaths)
    gap = F.min(F.when(F.col("time_ms").isNull(), F.col("ord"))).over(Window.partitionBy("game", "round"))  # unknown times come last
    a = feed.withColumn("stop", gap)
    # a player's kills and deaths in one stream, from the last on: a kill's answer is the nearest death that is later
    part = lambda who, dies: F.struct(F.col(who).alias("player"), F.lit(dies).alias("dies"))
    stream = a.select("game", "round", "ord", "time_ms", "stop", "killer", F.inline(F.array(part("victim", True), part("killer", False)))).filter("player is not null")
    later = Window.partitionBy("game", "round", "player").orderBy(F.desc("ord"), "dies").rowsBetween(Window.unboundedPreceding, -1)
    death = F.struct(F.col("ord").alias("ord"), F.col("time_ms").alias("time_ms"), F.col("killer").alias("avenger"))
    next_death = F.last(F.when(F.col("dies"), death), ignorenulls=True).over(later)
    within = (F.col("next.time_ms") - F.col("time_ms") <= window_ms) & (F.col("stop").isNull() | (F.col("next.ord") < F.col("stop")))
    first = stream.withColumn("next", next_death).filter("not dies").filter(within).select("game", "ord", F.col("next.avenger").alias("avenger"))
    side = lambda player, name: teams.select("game", F.col("player").alias(player), F.col("team").alias(name))
    joined = feed.join(first.withColumn("answered", F.lit(True)), ["game", "ord"], "left")
    joined = joined.join(side("victim", "victim_team"), ["game", "victim"], "left").join(side("avenger", "avenger_team"), ["game", "avenger"], "left")
    answered = F.coalesce("answered", F.lit(False))
    traded = answered & F.col("avenger").isNotNull() & F.col("victim_team").eqNullSafe(F.col("avenger_team"))
    return joined.select("game", "round", "time_ms", "seq", "ord", "victim", "killer", traded.alias("traded"), answered.alias("answered"), F.when(traded, F.col("avenger")).alias("trader"))


def opening_deaths(deaths: DataFrame) -> DataFrame:
    """The first death of each round."""
    return in_order(deaths).withColumn("nth", F.row_number().over(Window.partitionBy("game", "round").orderBy("ord"))).filter("nth = 1").drop("nth")


def round_winners(rounds: DataFrame, boxes: DataFrame) -> DataFrame:
    """game, round, team: who took each round.

    rounds: game, round, score1, score2, cumulative; boxes: game, team1, team2, box1, box2, winner. A round goes to
    the side whose score rose; one that shows (0, 0) or nothing goes to the game's winner. Both ways of laying the
    two sides on the two teams are tried, and the one whose totals equal the box score is kept, the direct one first;
    games that fit neither way are left out.
    """
    w = Window.partitionBy("game").orderBy("round")
    reset = F.coalesce((F.col("score1") == 0) & (F.col("score2") == 0), F.lit(True))
    side = F.when(reset, 0).when(F.col("score1") > F.coalesce(F.lag("score1").over(w), F.lit(0)), 1).otherwise(2)
    both = rounds.withColumn("side", side).join(boxes, "game").withColumn("swap", F.explode(F.array(F.lit(0), F.lit(1))))
    first, second = F.when(F.col("swap") == 0, F.col("team1")).otherwise(F.col("team2")), F.when(F.col("swap") == 0, F.col("team2")).otherwise(F.col("team1"))
    laid = both.withColumn("team", F.when(F.col("side") == 0, F.col("winner")).when(F.col("side") == 1, first).otherwise(second))
    fits = laid.groupBy("game", "swap").agg((F.count_if(F.col("team") == F.col("team1")) == F.first("box1")).alias("f1"), (F.count_if(F.col("team") == F.col("team2")) == F.first("box2")).alias("f2"))
    kept = fits.filter("f1 and f2").groupBy("game").agg(F.min("swap").alias("swap"))
    return laid.join(kept, ["game", "swap"]).select("game", "round", "team")


def alive_after(deaths: DataFrame, teams: DataFrame) -> DataFrame:
    """Each death of a rostered victim with team, and how many of its own and of the other side then live.

    A victim counts once a round. Games have two teams.
    """
    feed = in_order(deaths).join(teams.select("game", F.col("player").alias("victim"), "team"), ["game", "victim"])
    once = feed.withColumn("again", F.row_number().over(Window.partitionBy("game", "round", "victim").orderBy("ord"))).filter("again = 1").drop("again")
    size = teams.groupBy("game", "team").agg(F.count_distinct("player").alias("size"))
    sides = size.withColumnRenamed("size", "own_size").join(size.select("game", F.col("team").alias("other_team"), F.col("size").alias("other_size")), "game").filter("team <> other_team")
    seen = once.join(sides, ["game", "team"])
    upto = Window.partitionBy("game", "round").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.lit(1)).over(Window.partitionBy("game", "round", "team").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumns({"own_dead": own, "all_dead": F.sum(F.lit(1)).over(upto)}).withColumns({
        "own": F.col("own_size") - F.col("own_dead"),
        "opponents": F.col("other_size") - (F.col("all_dead") - F.col("own_dead")),
    })


def clutches(deaths: DataFrame, teams: DataFrame, winners: DataFrame) -> DataFrame:
    """game, round, team, player, opponents, won: the last survivor of a side against 1 to 4, once per team and round.

    The first moment counts at which a side has one player and 1..4 opponents live. Rounds without a winner do not count.
    """
    states = alive_after(deaths, teams)
    mine = states.select("game", "round", "ord", "team", "other_team", "own", "opponents")
    theirs = states.select("game", "round", "ord", F.col("other_team").alias("team"), F.col("team").alias("other_team"), F.col("opponents").alias("own"), F.col("own").alias("opponents"))
    last = mine.unionByName(theirs).filter((F.col("own") == 1) & F.col("opponents").between(1, CLUTCH_OPPONENTS))
    first = last.groupBy("game", "round", "team").agg(F.min("ord").alias("ord"), F.min_by("opponents", "ord").alias("opponents"))
    dead = states.select("game", "round", "team", F.col("victim").alias("player"), F.col("ord").alias("died"))
    live = first.join(teams.select("game", "team", "player"), ["game", "team"]).join(dead, ["game", "round", "team", "player"], "left").filter("died is null or died > ord")
    return live.join(winners.select("game", "round", F.col("team").alias("winner")), ["game", "round"]).select("game", "round", "team", "player", "opponents", (F.col("team") == F.col("winner")).alias("won"))


def advantages(deaths: DataFrame, teams: DataFrame, winners: DataFrame) -> DataFrame:
    """game, round, team, sign, won: the side that is first a man up (+1) and the other (-1); won is null if unknown."""
    states = alive_after(deaths, teams).filter("own <> opponents")
    first = states.groupBy("game", "round").agg(F.min_by(F.struct("team", "other_team", "own", "opponents"), "ord").alias("s"))
    rows = first.select("game", "round", F.inline(F.array(
        F.struct(F.col("s.team").alias("team"), F.when(F.col("s.own") > F.col("s.opponents"), 1).otherwise(-1).alias("sign")),
        F.struct(F.col("s.other_team").alias("team"), F.when(F.col("s.own") > F.col("s.opponents"), -1).otherwise(1).alias("sign")),
    )))
    return rows.join(winners.select("game", "round", F.col("team").alias("winner")), ["game", "round"], "left").select("game", "round", "team", "sign", (F.col("team") == F.col("winner")).alias("won"))


def thrown_deaths(deaths: DataFrame, teams: DataFrame) -> DataFrame:
    """player, thrown: deaths taken while one's side was a man up."""
    states = alive_after(deaths, teams)
    return states.filter("own + 1 > opponents").groupBy(F.col("victim").alias("player")).agg(F.count(F.lit(1)).alias("thrown"))


def state_table(states: DataFrame) -> DataFrame:
    """own, opponents, n, wins, p from states (own, opponents, won): p = (wins + 1/2) / (n + 1), certain when a side is gone."""
    g = states.groupBy("own", "opponents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("won")).alias("wins"))
    p = F.when(F.col("own") == 0, 0.0).when(F.col("opponents") == 0, 1.0).otherwise((F.col("wins") + 0.5) / (F.col("n") + 1.0))
    return g.withColumn("p", p)


def both_views(states: DataFrame) -> DataFrame:
    """Each state (own, opponents, won) also as the other side has it."""
    return states.select("own", "opponents", "won").unionByName(states.select(F.col("opponents").alias("own"), F.col("own").alias("opponents"), (~F.col("won")).alias("won")))


def timeline(states: DataFrame, table: DataFrame, side: Column) -> DataFrame:
    """Adds p_side to the states (own, opponents after a death, team of the victim): the chance of the given side from then on."""
    known = states.join(F.broadcast(table.select("own", "opponents", "p")), ["own", "opponents"], "left")  # a few dozen states
    p = F.when(F.col("own") == 0, 0.0).when(F.col("opponents") == 0, 1.0).otherwise(F.coalesce("p", F.lit(0.5)))
    return known.withColumn("p_side", F.when(F.col("team") == side, p).otherwise(1 - p)).drop("p")


def kill_values(states: DataFrame, table: DataFrame) -> DataFrame:
    """Adds wpa: what each death gave to the killer's side. states: game, round, ord, own, opponents of the victim's side.

    The state before a death has its victim alive; unseen states are worth one half.
    """
    p = table.select("own", "opponents", "p")
    before = p.select((F.col("own") - 1).alias("own"), "opponents", F.col("p").alias("p0"))
    joined = states.join(F.broadcast(p), ["own", "opponents"], "left").join(F.broadcast(before), ["own", "opponents"], "left")  # a few dozen states
    edge = F.when(F.col("own") == 0, 0.0).when(F.col("opponents") == 0, 1.0).otherwise(F.coalesce("p", F.lit(0.5)))
    return joined.withColumn("wpa", F.coalesce("p0", F.lit(0.5)) - edge)


#: What the feed says of a player on a map; the second list only of maps in search mode whose rounds' winners are known.
FEED_COLUMNS = ["feed_deaths", "feed_kills", "feed_traded", "feed_trade_kills", "feed_answered", "feed_first_deaths", "feed_first_untraded"]
ROUND_COLUMNS = ["clutch_tried", "clutch_won", *(f"clutch_{what}_{n}" for n in range(1, CLUTCH_OPPONENTS + 1) for what in ("tried", "won")), "adv_rounds", "adv_won", "disadv_rounds", "disadv_won", "thrown_deaths", "feed_snd_rounds"]


def _summed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.filter("player is not null").groupBy("game", "player").agg(*(F.sum(c).cast("double").alias(c) for c in columns))


def trade_counts(deaths: DataFrame, teams: DataFrame) -> DataFrame:
    """game, player and FEED_COLUMNS: deaths, kills and trades of each player; deaths are the normal ones."""
    zero, one = F.lit(0), F.lit(1)
    first = opening_deaths(deaths).select("game", "ord", F.lit(True).alias("opening"))
    rows = trades(deaths, teams).join(first, ["game", "ord"], "left")
    traded, answered, opening = (F.coalesce(c, F.lit(False)).cast("int") for c in ("traded", "answered", "opening"))
    part = lambda player, *values: F.struct(F.col(player).alias("player"), *(v.alias(c) for v, c in zip(values, FEED_COLUMNS)))
    parts = F.array(
        part("victim", one, zero, traded, zero, zero, opening, opening * (1 - traded)),
        part("killer", zero, one, zero, zero, answered, zero, zero),
        part("trader", zero, zero, zero, one, zero, zero, zero),
    )
    return _summed(rows.select("game", F.inline(parts)), FEED_COLUMNS)


def round_counts(deaths: DataFrame, teams: DataFrame, winners: DataFrame) -> DataFrame:
    """game, player and ROUND_COLUMNS: clutches, man advantages, thrown deaths and rounds played, on games with winners.

    Every player of a side has the side's advantage; thrown deaths and rounds need no winner of their own round.
    """
    games = winners.select("game").distinct()
    deaths, teams = deaths.join(games, "game", "left_semi"), teams.join(games, "game", "left_semi")
    zero, won = F.lit(0), F.col("won").cast("int")
    row = lambda rows, **values: rows.select("game", "player", *(values.get(c, zero).cast("int").alias(c) for c in ROUND_COLUMNS))
    by_opponents = {f"clutch_{what}_{n}": F.when(F.col("opponents") == n, v).otherwise(0) for n in range(1, CLUTCH_OPPONENTS + 1) for what, v in (("tried", F.lit(1)), ("won", won))}
    clutch = row(clutches(deaths, teams, winners), clutch_tried=F.lit(1), clutch_won=won, **by_opponents)
    sides = advantages(deaths, teams, winners).filter("won is not null").join(teams, ["game", "team"])
    up = F.col("sign") == 1
    edge = row(sides, adv_rounds=up, adv_won=up & F.col("won"), disadv_rounds=~up, disadv_won=~up & F.col("won"))
    thrown = row(alive_after(deaths, teams).filter("own + 1 > opponents").withColumn("player", F.col("victim")), thrown_deaths=F.lit(1))
    played = row(deaths.select("game", "round").distinct().join(teams.select("game", "player"), "game"), feed_snd_rounds=F.lit(1))
    return _summed(clutch.unionByName(edge).unionByName(thrown).unionByName(played), ROUND_COLUMNS)


def with_feed(lines: DataFrame, deaths: DataFrame, teams: DataFrame, winners: DataFrame, search_mode: str = "snd") -> DataFrame:
    """The lines (game, player, mode, deaths, ...) with FEED_COLUMNS and ROUND_COLUMNS.

    A line whose box deaths equal its feed deaths reports the feed: what it has none of counts as 0. All other lines
    report nothing (null), and ROUND_COLUMNS are null outside search mode and on games without winners.
    """
    agrees = reconciled(lines, deaths.withColumn("kind", F.lit("normal"))).filter("matches").select("game", "player", F.lit(True).alias("__fed"))
    known = winners.select("game").distinct().withColumn("__known", F.lit(True))
    out = lines.join(agrees, ["game", "player"], "left").join(known, "game", "left")
    out = out.join(trade_counts(deaths, teams), ["game", "player"], "left").join(round_counts(deaths, teams, winners), ["game", "player"], "left")
    rounds = F.col("__fed") & F.col("__known") & (F.col("mode") == search_mode)
    filled = {c: F.when(F.col("__fed"), F.coalesce(c, F.lit(0.0))) for c in FEED_COLUMNS} | {c: F.when(rounds, F.coalesce(c, F.lit(0.0))) for c in ROUND_COLUMNS}
    return out.withColumns(filled).drop("__fed", "__known")
