"""Golden timelines of the kill-feed operators."""

import pytest

from matchloom.operators import feed

DEATH = "game int, round int, time_ms long, seq int, victim int, killer int"
TEAMS = [(1, p, 100 if p <= 4 else 200) for p in range(1, 9)]


def deaths(spark, *rows):
    return spark.createDataFrame([(1, r, t, i, v, k) for i, (r, t, v, k) in enumerate(rows)], DEATH)


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame(TEAMS, "game int, player int, team int")


def flags(df):
    return {(r["round"], r["seq"]): (r["traded"], r["answered"], r["trader"]) for r in df.collect()}


def test_trade_inside_the_window(spark, teams):
    got = flags(feed.trades(deaths(spark, (1, 1000, 1, 5), (1, 3000, 5, 2)), teams))
    assert got[(1, 0)] == (True, True, 2)
    assert got[(1, 1)] == (False, False, None)


def test_window_ends_and_rounds(spark, teams):
    assert flags(feed.trades(deaths(spark, (1, 1000, 1, 5), (1, 6000, 5, 2)), teams))[(1, 0)][0]
    assert not flags(feed.trades(deaths(spark, (1, 1000, 1, 5), (1, 6001, 5, 2)), teams))[(1, 0)][1]
    assert not flags(feed.trades(deaths(spark, (1, 1000, 1, 5), (2, 2000, 5, 2)), teams))[(1, 0)][1]


def test_answered_by_the_other_side_is_no_trade(spark, teams):
    assert flags(feed.trades(deaths(spark, (1, 1000, 1, 5), (1, 2000, 5, 6)), teams))[(1, 0)] == (False, True, None)


def test_unknown_players_share_a_side_and_an_unknown_time_ends_the_search(spark, teams):
    assert flags(feed.trades(deaths(spark, (1, 1000, 90, 5), (1, 2000, 5, 91)), teams))[(1, 0)][0]
    got = flags(feed.trades(deaths(spark, (1, None, 1, 5), (1, 1000, 2, 5), (1, 1500, 5, 3)), teams))
    assert got[(1, 1)][0] and got[(1, 0)] == (False, False, None)


def test_clutch_counts_once_at_the_first_moment(spark, teams):
    feed_rows = deaths(spark, (1, 1000, 5, 1), (1, 2000, 1, 6), (1, 3000, 2, 6), (1, 4000, 3, 7), (1, 5000, 6, 4), (1, 6000, 7, 4), (1, 7000, 8, 4))
    winners = spark.createDataFrame([(1, 1, 100)], "game int, round int, team int")
    got = {(r.team, r.player, r.opponents, r.won) for r in feed.clutches(feed_rows, teams, winners).collect()}
    assert (100, 4, 3, True) in got and len([g for g in got if g[0] == 100]) == 1


def test_advantage_and_thrown_deaths(spark, teams):
    rows = deaths(spark, (1, 1000, 5, 1), (1, 2000, 1, 6))
    winners = spark.createDataFrame([(1, 1, 100)], "game int, round int, team int")
    got = {(r.team, r.sign, r.won) for r in feed.advantages(rows, teams, winners).collect()}
    assert got == {(100, 1, True), (200, -1, False)}
    assert {(r.player, r.thrown) for r in feed.thrown_deaths(rows, teams).collect()} == {(1, 1)}
    unknown = feed.advantages(rows, teams, winners.filter("false")).collect()
    assert {(r.team, r.sign, r.won) for r in unknown} == {(100, 1, None), (200, -1, None)}


@pytest.mark.parametrize(("scores", "box", "want"), [([(1, 0), (1, 1), (0, 0)], (2, 1, 100), {1: 100, 2: 200, 3: 100}), ([(1, 0), (2, 0), (2, 1)], (1, 2, 200), {1: 200, 2: 200, 3: 100})])
def test_round_winners(spark, scores, box, want):
    rounds = spark.createDataFrame([(1, i + 1, a, b) for i, (a, b) in enumerate(scores)], "game int, round int, score1 int, score2 int")
    boxes = spark.createDataFrame([(1, 100, 200, *box)], "game int, team1 int, team2 int, box1 int, box2 int, winner int")
    assert {r["round"]: r["team"] for r in feed.round_winners(rounds, boxes).collect()} == want


def test_state_table_is_symmetric_and_values_telescope(spark, teams):
    rows = deaths(spark, (1, 1000, 5, 1), (1, 2000, 1, 6), (1, 3000, 6, 2))
    states = feed.alive_after(rows, teams)
    from pyspark.sql import functions as F

    table = feed.state_table(feed.both_views(states.withColumn("won", F.col("team") == 100)))
    p = {(r.own, r.opponents): r.p for r in table.collect()}
    assert all(abs(p[s] + p[s[::-1]] - 1) < 1e-12 for s in p)
    values = feed.kill_values(states, table).collect()
    assert len(values) == 3


def test_reconciliation_keeps_unknown_apart(spark):
    lines = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, None), (2, 1, 0)], "game int, player int, deaths int")
    rows = deaths(spark, (1, 1, 1, 2)).selectExpr("*", "'normal' as kind")
    assert {(r.game, r.player): r.matches for r in feed.reconciled(lines, rows).collect()} == {(1, 1): True, (1, 2): True, (1, 3): None}
