"""The player and team metric layer: sums first, one division, then cohort scores."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.cohort import scored
from matchloom.operators.hierarchy import same

#: A column is tracked for a title once so many of its rows are not zero.
TRACKED_ROWS = 20
#: What a metric is scored among.
COHORT = ["metric", "season", "mode"]


@dataclass(frozen=True)
class Metric:
    """A key, its value and denominator over the sums of a player's maps, and the least denominator that qualifies."""

    key: str
    value: str
    denominator: str
    least: int
    rising: bool
    mode: str | None

    @property
    def sources(self) -> set[str]:
        """The box-score columns the value needs."""
        made = {"greatest", "maps", "nullif", "damage_maps", "damage_duration_s", "dist_kills", "dist_weighted"}
        made |= {"team_kills_on_maps", "team_hill_on_maps", "feed_maps", "feed_duration_s"}
        found = set(re.findall(r"[a-z_][a-z0-9_]*", self.value)) | set(re.findall(r"[a-z_][a-z0-9_]*", self.denominator))
        extra = {"damage"} if "damage_" in self.value else {"avg_kill_dist"} if "dist_" in self.value else set()
        return (found - made) | extra


#: Key, value, denominator, least denominator, whether higher is better, mode (None for all). Names stand for
#: sums over a player's maps; p10 is per ten minutes.
BOX_METRICS = [
    Metric("kd", "kills / greatest(deaths, 1)", "maps", 8, True, None),
    Metric("kills_p10", "kills / duration_s * 600", "maps", 8, True, None),
    Metric("deaths_p10", "deaths / duration_s * 600", "maps", 8, False, None),
    Metric("plus_minus_p10", "(kills - deaths) / duration_s * 600", "maps", 8, True, None),
    Metric("engagement_p10", "(kills + deaths) / duration_s * 600", "maps", 8, True, None),
    Metric("assists_p10", "assists / duration_s * 600", "maps", 8, True, None),
    Metric("ekia_p10", "ekia / duration_s * 600", "maps", 8, True, None),
    Metric("damage_p10", "damage / damage_duration_s * 600", "damage_maps", 8, True, None),
    Metric("kill_share", "kills / team_kills_on_maps", "maps", 8, True, None),
    Metric("headshot_rate", "headshots / kills", "kills", 100, True, None),
    Metric("accuracy", "hits / shots", "shots", 1000, True, None),
    Metric("avg_kill_dist_m", "dist_weighted / dist_kills", "kills", 100, True, None),
    Metric("time_per_life_s", "time_alive_s / num_lives", "maps", 8, True, None),
    Metric("lives_p10", "num_lives / duration_s * 600", "maps", 8, False, None),
    Metric("clean_kill_rate", "kills_stayed_alive / kills", "kills", 100, True, None),
    Metric("traded_back_rate", "1 - kills_stayed_alive / kills", "kills", 100, False, None),
    Metric("suicides_pm", "suicides / maps", "maps", 8, False, None),
    Metric("teamkills_total", "team_kills", "maps", 8, False, None),
    Metric("two_piece_p10", "pieces_2 / duration_s * 600", "maps", 8, True, None),
    Metric("three_piece_p10", "pieces_3 / duration_s * 600", "maps", 8, True, None),
    Metric("four_piece_p10", "pieces_4 / duration_s * 600", "maps", 8, True, None),
    Metric("blitz_index_p10", "(pieces_2 + 2 * pieces_3 + 4 * pieces_4) / duration_s * 600", "maps", 8, True, None),
    Metric("streak4_pm", "streak_4 / maps", "maps", 8, True, None),
    Metric("streak5_pm", "streak_5 / maps", "maps", 8, True, None),
    Metric("streak6_pm", "streak_6 / maps", "maps", 8, True, None),
    Metric("streak7_pm", "streak_7 / maps", "maps", 8, True, None),
    Metric("streak8plus_pm", "streak_8plus / maps", "maps", 8, True, None),
    Metric("deep_streak_rate", "(streak_6 + streak_7 + streak_8plus) / maps", "maps", 8, True, None),
    Metric("eight_plus_streaks_total", "streak_8plus", "maps", 8, True, None),
    Metric("hill_time_p10", "hill_time / duration_s * 600", "maps", 8, True, "hp"),
    Metric("hill_time_share", "hill_time / team_hill_on_maps", "maps", 8, True, "hp"),
    Metric("hill_caps_p10", "hill_captures / duration_s * 600", "maps", 8, True, "hp"),
    Metric("hill_defends_p10", "hill_defends / duration_s * 600", "maps", 8, True, "hp"),
    Metric("snd_kpr", "kills / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("snd_dpr", "deaths / snd_rounds", "snd_rounds", 50, False, "snd"),
    Metric("snd_fb_rate", "first_bloods / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("snd_fd_rate", "snd_firstdeaths / snd_rounds", "snd_rounds", 50, False, "snd"),
    Metric("snd_fb_net_pr", "(first_bloods - snd_firstdeaths) / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("snd_opening_involvement", "(first_bloods + snd_firstdeaths) / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("snd_opening_duel_win", "first_bloods / (first_bloods + snd_firstdeaths)", "snd_rounds", 50, True, "snd"),
    Metric("snd_survival_rate", "snd_survives / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("snd_plants_pr", "plants / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("snd_defuses_pr", "defuses / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("snd_pickups_pr", "bomb_pickups / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("sneak_defuses_total", "bomb_sneak_defuses", "snd_rounds", 50, True, "snd"),
    Metric("snd_ace_total", "snd_4_kill_round", "snd_rounds", 50, True, "snd"),
    Metric("snd_ace_rate", "snd_4_kill_round / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("snd_3k_round_rate", "snd_3_kill_round / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("snd_multi_kill_round_rate", "(snd_2_kill_round + snd_3_kill_round + snd_4_kill_round) / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("snd_zero_kill_round_rate", "1 - (snd_1_kill_round + snd_2_kill_round + snd_3_kill_round + snd_4_kill_round) / snd_rounds", "snd_rounds", 50, False, "snd"),
    Metric("ctf_caps_pm", "ctf_captures / maps", "maps", 8, True, "ctf"),
    Metric("ctf_returns_pm", "ctf_returns / maps", "maps", 8, True, "ctf"),
    Metric("ctf_defends_pm", "ctf_defends / maps", "maps", 8, True, "ctf"),
    Metric("ctf_carrier_kills_pm", "ctf_kill_carriers / maps", "maps", 8, True, "ctf"),
    Metric("ctf_pickups_pm", "ctf_pickups / maps", "maps", 8, True, "ctf"),
    Metric("ctf_carry_time_pm_s", "ctf_flag_carry_time_s / maps", "maps", 8, True, "ctf"),
    Metric("ctf_carry_efficiency", "ctf_captures / ctf_pickups", "maps", 8, True, "ctf"),
    Metric("ctf_flag_involvement_pm", "(ctf_captures + ctf_returns + ctf_kill_carriers) / maps", "maps", 8, True, "ctf"),
    Metric("uplink_points_pm", "uplink_points / maps", "maps", 8, True, "uplink"),
    Metric("uplink_points_p10", "uplink_points / duration_s * 600", "maps", 8, True, "uplink"),
    Metric("uplink_dunk_rate", "uplink_dunks / (uplink_dunks + uplink_throws)", "maps", 8, True, "uplink"),
    Metric("uplink_dunks_pm", "uplink_dunks / maps", "maps", 8, True, "uplink"),
    Metric("uplink_throws_pm", "uplink_throws / maps", "maps", 8, True, "uplink"),
    Metric("ctrl_caps_pm", "ctrl_captures / maps", "maps", 8, True, "ctrl"),
    Metric("ctrl_fb_rate", "ctrl_firstbloods / ctrl_rounds", "ctrl_rounds", 50, True, "ctrl"),
    Metric("ctrl_fd_rate", "ctrl_firstdeaths / ctrl_rounds", "ctrl_rounds", 50, False, "ctrl"),
    Metric("ctrl_fb_net_pr", "(ctrl_firstbloods - ctrl_firstdeaths) / ctrl_rounds", "ctrl_rounds", 50, True, "ctrl"),
    Metric("ctrl_opening_duel_win", "ctrl_firstbloods / (ctrl_firstbloods + ctrl_firstdeaths)", "ctrl_rounds", 50, True, "ctrl"),
    Metric("streaks_earned_p10", "scorestreaks_earned / duration_s * 600", "maps", 8, True, None),
    Metric("streak_conversion", "scorestreaks_used / scorestreaks_earned", "maps", 8, True, None),
    Metric("streak_kills_p10", "scorestreaks_kills / duration_s * 600", "maps", 8, True, None),
    Metric("streak_assists_p10", "scorestreaks_assists / duration_s * 600", "maps", 8, True, None),
    Metric("payloads_earned_p10", "payloads_earned / duration_s * 600", "maps", 8, True, None),
    Metric("score_pm", "player_score / (duration_s / 60)", "maps", 8, True, None),
    Metric("kills_pm", "kills / maps", "maps", 8, True, None),
    Metric("deaths_pm", "deaths / maps", "maps", 8, False, None),
    Metric("plus_minus_pm", "(kills - deaths) / maps", "maps", 8, True, None),
    Metric("engagement_pm", "(kills + deaths) / maps", "maps", 8, True, None),
    Metric("assists_pm", "assists / maps", "maps", 8, True, None),
    Metric("damage_pm", "damage / damage_maps", "damage_maps", 8, True, None),
    Metric("non_traded_kill_rate", "non_traded_kills / kills", "kills", 100, True, None),
    Metric("hill_time_pm", "hill_time / maps", "maps", 8, True, "hp"),
    Metric("contested_hill_share", "contested_hill_time / hill_time", "maps", 8, True, "hp"),
    Metric("clutch_wins_pr", "(clutch_1v1 + clutch_1v2 + clutch_1v3 + clutch_1v4) / snd_rounds", "snd_rounds", 50, True, "snd"),
    Metric("dom_caps_pm", "captures / maps", "maps", 8, True, "dom"),
    Metric("blitz_caps_pm", "blitz_caps / maps", "maps", 8, True, "blitz"),
]

#: Fixed values, in the same form, over the sums of feed counts on reconciled maps (see matchloom.operators.feed).
FEED_METRICS = [
    Metric("untraded_death_rate", "(feed_deaths - feed_traded) / feed_deaths", "feed_deaths", 100, False, None),
    Metric("traded_death_rate", "feed_traded / feed_deaths", "feed_deaths", 100, True, None),
    Metric("trade_kills_p10", "feed_trade_kills / feed_duration_s * 600", "feed_maps", 8, True, None),
    Metric("kill_answered_rate", "feed_answered / feed_kills", "feed_kills", 100, False, None),
    Metric("first_death_untraded_rate", "feed_first_untraded / feed_first_deaths", "feed_first_deaths", 20, False, None),
    Metric("clutch_win_rate", "clutch_won / clutch_tried", "clutch_tried", 15, True, "snd"),
    Metric("snd_adv_conversion", "adv_won / adv_rounds", "adv_rounds", 25, True, "snd"),
    Metric("snd_adv_rounds_lost", "1 - adv_won / adv_rounds", "adv_rounds", 25, False, "snd"),
    Metric("snd_disadv_steal_rate", "disadv_won / disadv_rounds", "disadv_rounds", 25, True, "snd"),
    Metric("snd_adv_thrown_deaths_pr", "thrown_deaths / feed_snd_rounds", "feed_snd_rounds", 50, False, "snd"),
]


def _by_number() -> list[Metric]:
    """Shares of rounds by kills, and clutches by opponents."""
    none = "1 - (snd_1_kill_round + snd_2_kill_round + snd_3_kill_round + snd_4_kill_round) / snd_rounds"
    rounds = [Metric(f"snd_rounds_{n}k_share", f"snd_{n}_kill_round / snd_rounds" if n else none, "snd_rounds", 50, n > 0, "snd") for n in range(5)]
    return rounds + [Metric(f"clutch_1v{n}_win_rate", f"clutch_won_{n} / clutch_tried_{n}", f"clutch_tried_{n}", 5, True, "snd") for n in range(1, 5)]


FEED_METRICS += [m for m in _by_number() if m.key.startswith("clutch")]
PLAYER_METRICS: list[Metric] = BOX_METRICS + FEED_METRICS + [m for m in _by_number() if m not in FEED_METRICS]


def guarded(expression: str) -> str:
    """The expression with every divisor that may be 0 or negative made null, so that the row is then left out."""
    return re.sub(r"/ (\([^()]*\)|(?!greatest)[a-z_][a-z0-9_]*)", r"/ if(\1 > 0, \1, null)", expression)


def coverage(lines: DataFrame, columns: list[str], title: str = "title") -> DataFrame:
    """title, column, present, tracked: how many rows report each column, and whether enough of them are not zero."""
    counts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("present"), F.count_if(F.col(c) != 0).alias("nonzero")) for c in columns]
    return lines.groupBy(title).agg(F.array(*counts).alias("c")).select(title, F.inline("c")).select(title, "column", "present", (F.col("nonzero") >= TRACKED_ROWS).alias("tracked"))


def folded(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Sums by player, season and mode, and by player and season (mode null); lines are player-maps.

    A column that a map does not report is null and adds nothing. Damage rates use only the maps that report damage,
    feed rates only those that report feed_deaths, the kill distance is weighted by kills, and shares are of the team's
    total on the same maps. The pooled rows are sums of the rows by mode, not of the lines anew.
    """
    keys = ["player", "season", "mode"]
    hill = ["hill_time"] if "hill_time" in columns else []
    team = Window.partitionBy("game", "team")
    narrow = lines.select(*keys, "game", "team", "kills", *hill)  # the other columns are summed where they lie
    shares = narrow.withColumns({f"__{c}": F.sum(c).over(team) for c in ("kills", *hill)})
    totals = [F.sum("__kills").cast("double").alias("team_kills_on_maps")]
    if hill:
        totals.append(F.sum(F.when(F.col("hill_time").isNotNull(), F.col("__hill_time"))).cast("double").alias("team_hill_on_maps"))
    on_maps = shares.groupBy(*keys).agg(*totals)
    sums = [F.sum(c).cast("double").alias(c) for c in columns]
    sums.append(F.count(F.lit(1)).cast("double").alias("maps"))
    if "damage" in columns:
        sums += [F.count("damage").cast("double").alias("damage_maps"), F.sum(F.when(F.col("damage").isNotNull(), F.col("duration_s"))).cast("double").alias("damage_duration_s")]
    if "avg_kill_dist" in columns:
        reports = F.col("avg_kill_dist").isNotNull()
        sums += [F.sum(F.when(reports, F.col("kills"))).cast("double").alias("dist_kills"), F.sum(F.col("avg_kill_dist") * F.col("kills")).cast("double").alias("dist_weighted")]
    if "feed_deaths" in columns:
        fed = F.col("feed_deaths").isNotNull()
        sums += [F.count("feed_deaths").cast("double").alias("feed_maps"), F.sum(F.when(fed, F.col("duration_s"))).cast("double").alias("feed_duration_s")]
    by_mode = lines.groupBy(*keys).agg(*sums).alias("a").join(on_maps.alias("b"), same("a", "b", keys)).select("a.*", *(F.col(f"b.{c}") for c in on_maps.columns if c not in keys))
    names = [c for c in by_mode.columns if c not in ("player", "season", "mode")]
    sets = by_mode.groupingSets([["player", "season", "mode"], ["player", "season"]], "player", "season", "mode")
    return sets.agg(F.grouping("mode").alias("pooled"), *(F.sum(c).alias(c) for c in names))


def metric_rows(sums: DataFrame, metrics: list[Metric]) -> DataFrame:
    """player, season, mode, metric, value, denom, qualified, z, pctl from the sums of folded(): long_rows(), scored in their cohorts by one window."""
    return scored(long_rows(sums, metrics), COHORT).select("player", "season", "mode", "metric", "value", "denom", "qualified", "z", "pctl")


def long_rows(sums: DataFrame, metrics: list[Metric]) -> DataFrame:
    """player, season, mode, metric, value, denom, qualified from the sums of folded().

    Only the metrics asked for are made, and only those whose columns the sums have. Metrics of one mode are given for that mode only. A missing or not positive divisor, or a value that is not
    finite, leaves the row out. One pass makes all metrics long.
    """
    here = [m for m in metrics if m.sources <= set(sums.columns)]
    cell = lambda m: F.struct(F.lit(m.key).alias("metric"), F.expr(guarded(m.value)).cast("double").alias("value"), F.expr(m.denominator).cast("double").alias("denom"), F.lit(float(m.least)).alias("least"))
    everywhere = F.array(*(cell(m) for m in here if m.mode is None))
    if not any(m.mode is None for m in here):
        everywhere = F.slice(F.array(*map(cell, here)), 1, 0)
    own = F.slice(everywhere, 1, 0)  # a row makes the metrics of its own mode alone
    for mode in sorted({m.mode for m in here if m.mode is not None}):
        own = F.when(F.col("mode") == mode, F.array(*(cell(m) for m in here if m.mode == mode))).otherwise(own)
    long = sums.select("player", "season", "mode", F.inline(F.concat(everywhere, own)))
    rows = long.filter("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return rows.select("player", "season", "mode", "metric", "value", "denom", F.coalesce(F.col("denom") >= F.col("least"), F.lit(False)).alias("qualified"))


def split_metric(rows: DataFrame) -> DataFrame:
    """hp_obj_slay_split: z of hill_time_share less z of kills_p10, or of kills_pm where no map time is known."""
    z = rows.filter(F.col("metric").isin("hill_time_share", "kills_p10", "kills_pm") & (F.col("mode") == "hp")).groupBy("player", "season", "mode")
    of = lambda k: F.max(F.when(F.col("metric") == k, F.col("z")))
    wide = z.agg(of("hill_time_share").alias("hill"), F.coalesce(of("kills_p10"), of("kills_pm")).alias("slay"))
    return wide.filter("hill is not null and slay is not null").select("player", "season", "mode", F.lit("hp_obj_slay_split").alias("metric"), (F.col("hill") - F.col("slay")).alias("value"))


def team_metrics(lines: DataFrame, games: DataFrame) -> DataFrame:
    """team, season, mode, metric, value, denom: results, kill balance and spread of teams on their maps.

    lines: player-maps (game, team, player, season, mode, kills, hill_time, first_bloods); games: game, team,
    opponent, score, opponent_score, won. Spread metrics are means of one value per map.
    """
    side = lines.groupBy("game", "team", "season", "mode").agg(
        F.sum("kills").alias("kills"), F.stddev_pop("kills").alias("sd"), F.sum("hill_time").alias("hill"), F.sum(F.col("hill_time") * F.col("hill_time")).alias("hill2"), F.count("hill_time").alias("n")
    )
    ranked = lines.filter("hill_time is not null").withColumn("i", F.row_number().over(Window.partitionBy("game", "team").orderBy("hill_time", "player")))
    total = ranked.groupBy("game", "team").agg(F.sum(F.col("i") * F.col("hill_time")).alias("weighted"), F.sum("hill_time").alias("t"), F.count(F.lit(1)).alias("m"))
    gini = total.filter("t > 0").select("game", "team", ((2 * F.col("weighted") / F.col("t") - F.col("m") - 1) / F.col("m")).alias("gini"))
    other = side.select("game", F.col("team").alias("opponent"), F.col("kills").alias("opponent_kills"))
    maps = games.join(side, ["game", "team"]).join(other, ["game", "opponent"]).join(gini, ["game", "team"], "left")
    sets = maps.groupingSets([["team", "season", "mode"], ["team", "season"]], "team", "season", "mode")
    wide = sets.agg(
        F.count(F.lit(1)).cast("double").alias("maps"),
        F.avg(F.col("won").cast("int")).alias("map_win_rate"),
        F.avg(F.col("kills") - F.col("opponent_kills")).alias("kill_diff_per_map"),
        F.avg(F.try_divide(F.col("sd"), F.col("kills").cast("double"))).alias("slay_balance"),
        F.avg(F.when(F.col("mode") == "hp", F.col("score") - F.col("opponent_score"))).alias("hp_avg_margin"),
        F.try_divide(F.sum(F.when(F.col("mode") == "snd", F.col("score"))).cast("double"), F.sum(F.when(F.col("mode") == "snd", F.col("score") + F.col("opponent_score")))).alias("snd_round_win_rate"),
        F.avg(F.when(F.col("mode") == "hp", F.col("gini"))).alias("hill_time_gini"),
    )
    keys = ["map_win_rate", "kill_diff_per_map", "slay_balance", "hp_avg_margin", "snd_round_win_rate", "hill_time_gini"]
    return wide.unpivot(["team", "season", "mode", "maps"], keys, "metric", "value").filter("value is not null").withColumnRenamed("maps", "denom")


def concentration(lines: DataFrame, value: str) -> DataFrame:
    """team, season, herfindahl: how far a season's total is one player's."""
    own = lines.groupBy("team", "season", "player").agg(F.sum(value).alias("x"))
    share = F.col("x") / F.sum("x").over(Window.partitionBy("team", "season"))
    return own.withColumn("s", share).groupBy("team", "season").agg(F.sum(F.col("s") * F.col("s")).alias("herfindahl"))


def series_metrics(games: DataFrame) -> DataFrame:
    """team, season, series_win_rate, series, decider_win_rate, deciders from maps in series order.

    games: series, ordinal, team, season, won. A series is decided by its side with more maps; its target is the
    winner's count, at least 2, and a decider is a map before which both sides are one short of the target.
    """
    before = Window.partitionBy("series", "team").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("series", "team")
    w = games.withColumns({
        "w0": F.coalesce(F.sum(F.col("won").cast("int")).over(before), F.lit(0)),
        "l0": F.coalesce(F.sum((~F.col("won")).cast("int")).over(before), F.lit(0)),
        "w": F.sum(F.col("won").cast("int")).over(whole),
        "l": F.sum((~F.col("won")).cast("int")).over(whole),
    }).withColumn("target", F.greatest("w", "l"))
    decider = (F.col("target") >= 2) & (F.col("w0") == F.col("target") - 1) & (F.col("l0") == F.col("target") - 1)
    per = w.groupBy("series", "team", "season").agg((F.max("w") > F.max("l")).alias("took"), (F.max("w") != F.max("l")).alias("decided"), F.count_if(decider).alias("d"), F.count_if(decider & F.col("won")).alias("dw"))
    return per.groupBy("team", "season").agg(
        F.try_divide(F.count_if(F.col("took")).cast("double"), F.count_if(F.col("decided"))).alias("series_win_rate"), F.count_if(F.col("decided")).alias("series"),
        F.try_divide(F.sum("dw").cast("double"), F.sum("d")).alias("decider_win_rate"), F.sum("d").alias("deciders"),
    )


def per(numerator: Column, denominator: Column) -> Column:
    """A rate that is null rather than infinite."""
    return F.when(denominator > 0, numerator / denominator)
