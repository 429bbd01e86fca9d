"""Ordered windows and history features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import ordered
from tallyfield.plans import features, records
from tallyfield.plans.adapters import CONTESTS_SQL, OUTINGS_SQL, contest_table, outings, stored, table
from tallyfield.registry import query

FORM_SQL = """CAST(sum({won}) OVER {w} AS DOUBLE) / nullif(count({won}) OVER {w}, 0)"""


def _series(spark, folder):
    return ordered.in_ranges(outings(spark, folder), ["entity"], ["ts", "event_id"])


@query(
    "sequence_number",
    f"WITH {OUTINGS_SQL} SELECT event_id, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS number FROM outings",
)
def sequence_number(spark, folder):
    numbered = ordered.number_rows(_series(spark, folder), ["entity"], ["ts", "event_id"], "number")
    return numbered.select("event_id", "number")


@query(
    "rolling_avg_5",
    f"""WITH {OUTINGS_SQL} SELECT event_id, entity, CAST(sum(value) OVER w AS DOUBLE) / count(value) OVER w AS rolling_mean
        FROM outings WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def rolling_avg_5(spark, folder):
    rolled = ordered.rolling(
        _series(spark, folder), ["entity"], ["ts", "event_id"], "value", (-4, 0), {"rolling_mean": ordered.mean_of("value")}
    )
    return rolled.select("event_id", "entity", "rolling_mean")


@query(
    "position_in_run",
    f"""WITH {OUTINGS_SQL}, marked AS (
          SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS fresh
          FROM outings WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)),
        islands AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY ts, event_id) AS island FROM marked)
        SELECT event_id, kind, row_number() OVER (PARTITION BY entity, island ORDER BY ts, event_id) AS position FROM islands""",
)
def position_in_run(spark, folder):
    placed = ordered.run_position(_series(spark, folder), ["entity"], ["ts", "event_id"], ["kind"], "position")
    return placed.select("event_id", "kind", "position")


@query(
    "history_before",
    f"""WITH {OUTINGS_SQL} SELECT event_id, count(*) OVER w AS earlier,
          CAST(coalesce(sum(CAST(value * 100 AS BIGINT)) OVER w, 0) AS BIGINT) AS earlier_cents
        FROM outings WINDOW w AS (PARTITION BY entity, kind ORDER BY CAST(ts AS DATE)
          RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
)
def history_before(spark, folder):
    dated = outings(spark, folder).select(
        "event_id", "entity", "kind", F.col("ts").cast("date").alias("day"), (F.col("value") * 100).cast("long").alias("cents")
    )
    measures = {"earlier": F.lit(1), "earlier_cents": F.col("cents")}
    totals = ordered.totals_before(dated, ["entity", "kind"], "day", measures)
    return dated.join(totals, ["entity", "kind", "day"]).select("event_id", "earlier", "earlier_cents")


@query(
    "form_shifted_5",
    f"""WITH {CONTESTS_SQL} SELECT contest_id, coalesce({FORM_SQL.format(won="side1_won", w="w")}, -1) AS form FROM contests
        WINDOW w AS (PARTITION BY side1 ORDER BY contest_date, contest_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def form_shifted_5(spark, folder):
    df = features.add_form(contest_table(spark, folder), "side1", "form")
    return df.select("contest_id", F.coalesce("form", F.lit(-1.0)).alias("form"))


@query(
    "form_over_all",
    f"""WITH {CONTESTS_SQL}, long AS (
          SELECT contest_id, contest_date, side1 AS side, 1 AS role, side1_won AS won FROM contests
          UNION ALL SELECT contest_id, contest_date, side2, 2, 1 - side1_won FROM contests)
        SELECT contest_id, side, role, coalesce({FORM_SQL.format(won="won", w="w")}, -1) AS form FROM long
        WINDOW w AS (PARTITION BY side ORDER BY contest_date, contest_id, role ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def form_over_all(spark, folder):
    df = features.form_over_all(contest_table(spark, folder))
    return df.withColumn("form", F.coalesce("form", F.lit(-1.0)))


DAY_RANGE = "ORDER BY contest_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"

PAIRS_SQL = """paired AS (SELECT *, least(side1, side2) AS low, greatest(side1, side2) AS high,
    CASE WHEN winner = least(side1, side2) THEN 1 ELSE 0 END AS low_won,
    CASE WHEN winner = greatest(side1, side2) THEN 1 ELSE 0 END AS high_won FROM contests)"""

H2H_SQL = """CASE WHEN count(*) OVER h = 0 THEN 0.5 ELSE CAST(CASE WHEN side1 = low THEN sum(low_won) OVER h
    ELSE sum(high_won) OVER h END AS DOUBLE) / count(*) OVER h END"""

VENUE_SQL = """CASE WHEN count(*) OVER v = 0 THEN 0.5
    ELSE CAST(coalesce(sum(side1_won) OVER v, 0) AS DOUBLE) / count(*) OVER v END"""

WINDOWS_SQL = f"""h AS (PARTITION BY low, high {DAY_RANGE}), v AS (PARTITION BY side1, venue {DAY_RANGE}),
    f1 AS (PARTITION BY side1 ORDER BY contest_date, contest_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
    f2 AS (PARTITION BY side2 ORDER BY contest_date, contest_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""

NEUTRAL_SQL = "CASE WHEN contains(lower(venue), lower(side1)) OR contains(lower(venue), lower(side2)) THEN 0 ELSE 1 END"

FORM1_SQL = FORM_SQL.format(won="side1_won", w="f1")
FORM2_SQL = FORM_SQL.format(won="(1 - side1_won)", w="f2")


@query(
    "h2h_before",
    f"""WITH {CONTESTS_SQL}, {PAIRS_SQL} SELECT contest_id, count(*) OVER h AS met,
          CAST(coalesce(sum(low_won) OVER h, 0) AS BIGINT) AS low_wins,
          CAST(coalesce(sum(high_won) OVER h, 0) AS BIGINT) AS high_wins
        FROM paired WINDOW h AS (PARTITION BY low, high {DAY_RANGE})""",
)
def h2h_before(spark, folder):
    df = contest_table(spark, folder).withColumns({"low": F.least("side1", "side2"), "high": F.greatest("side1", "side2")})
    measures = {
        "met": F.lit(1),
        "low_wins": F.when(F.col("winner") == F.col("low"), 1).otherwise(0),
        "high_wins": F.when(F.col("winner") == F.col("high"), 1).otherwise(0),
    }
    totals = ordered.totals_before(df, ["low", "high"], "contest_date", measures)
    return df.join(totals, ["low", "high", "contest_date"]).select("contest_id", "met", "low_wins", "high_wins")


@query(
    "venue_before",
    f"""WITH {CONTESTS_SQL} SELECT contest_id, count(*) OVER v AS played,
          CAST(coalesce(sum(side1_won) OVER v, 0) AS BIGINT) AS wins
        FROM contests WINDOW v AS (PARTITION BY side1, venue {DAY_RANGE})""",
)
def venue_before(spark, folder):
    df = contest_table(spark, folder)
    measures = {"played": F.lit(1), "wins": F.coalesce("side1_won", F.lit(0))}
    totals = ordered.totals_before(df, ["side1", "venue"], "contest_date", measures)
    return df.join(totals, ["side1", "venue", "contest_date"]).select("contest_id", "played", "wins")


@query(
    "f_base",
    f"""WITH {CONTESTS_SQL} SELECT CAST(contest_id AS VARCHAR) AS contest_id, side1, side2,
          coalesce(side1_won, -1) AS side1_won, venue, strftime(contest_date, '%Y-%m-%d') AS day FROM contests""",
)
def f_base(spark, folder):
    """From the conformed tables: contests with team keys, joined to the team dimension by role."""
    games = contest_table(spark, folder).select(
        F.col("contest_id").cast("string").alias("match_id"), F.col("side1").alias("team1"), F.col("side2").alias("team2"),
        "winner", F.col("venue").alias("ground"), F.col("contest_date").cast("string").alias("matchDate"),
    )
    teams = records.build_teams(games)
    base = records.contests_from_star(records.build_matches(games, teams, ["matchDate"]), teams)
    return base.select(
        "contest_id", "side1", "side2", F.coalesce("side1_won", F.lit(-1)).alias("side1_won"), "venue",
        F.date_format("contest_date", "yyyy-MM-dd").alias("day"),
    )


@query(
    "f_form",
    f"""WITH {CONTESTS_SQL} SELECT contest_id, coalesce({FORM1_SQL}, -1) AS side1_form, coalesce({FORM2_SQL}, -1) AS side2_form
        FROM (SELECT *, least(side1, side2) AS low, greatest(side1, side2) AS high FROM contests) WINDOW {WINDOWS_SQL}""",
)
def f_form(spark, folder):
    df = features.add_form(contest_table(spark, folder), "side1", "side1_form")
    df = features.add_form(df, "side2", "side2_form")
    known = [F.coalesce(name, F.lit(-1.0)).alias(name) for name in ("side1_form", "side2_form")]
    return df.select("contest_id", *known)


@query(
    "f_h2h",
    f"WITH {CONTESTS_SQL}, {PAIRS_SQL} SELECT contest_id, {H2H_SQL} AS head_to_head FROM paired WINDOW {WINDOWS_SQL}",
)
def f_h2h(spark, folder):
    return features.add_head_to_head(contest_table(spark, folder)).select("contest_id", "head_to_head")


@query(
    "f_venue",
    f"WITH {CONTESTS_SQL}, {PAIRS_SQL} SELECT contest_id, {VENUE_SQL} AS venue_record FROM paired WINDOW {WINDOWS_SQL}",
)
def f_venue(spark, folder):
    return features.add_venue_record(contest_table(spark, folder)).select("contest_id", "venue_record")


@query("f_neutral", f"WITH {CONTESTS_SQL} SELECT contest_id, {NEUTRAL_SQL} AS neutral_venue FROM contests")
def f_neutral(spark, folder):
    return features.add_neutral_flag(contest_table(spark, folder)).select("contest_id", "neutral_venue")


@query(
    "f_training",
    f"""WITH {CONTESTS_SQL}, {PAIRS_SQL}, featured AS (
          SELECT contest_id, side1, side2, {FORM1_SQL} AS side1_form, {FORM2_SQL} AS side2_form, {H2H_SQL} AS head_to_head,
                 {VENUE_SQL} AS venue_record, CAST({NEUTRAL_SQL} AS DOUBLE) AS neutral_venue, side1_won
          FROM paired WINDOW {WINDOWS_SQL})
        SELECT * FROM featured WHERE side1_won IS NOT NULL AND side1_form IS NOT NULL AND side2_form IS NOT NULL""",
)
def f_training(spark, folder):
    return features.training_frame(contest_table(spark, folder)).drop("venue", "contest_date")


def training_table(spark, folder):
    return stored(spark, folder, "training-frame", lambda: features.training_frame(contest_table(spark, folder)))


def candidates(spark, folder):
    """One possible contest per order: the customer's nation against the part of the world the order key points to."""
    nation = table(spark, folder, "nation")
    one = F.broadcast(nation.select(F.col("n_nationkey").alias("key1"), F.col("n_name").alias("side1")))
    two = F.broadcast(nation.select(F.col("n_nationkey").alias("key2"), F.col("n_name").alias("side2")))
    place = F.broadcast(nation.select(F.col("n_nationkey").alias("key3"), F.concat(F.lit("Ground "), "n_name").alias("venue")))
    return (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(one, F.col("c_nationkey") == F.col("key1"))
        .join(two, (F.col("o_orderkey") % 25).cast("int") == F.col("key2"))
        .join(place, (F.col("o_custkey") % 25).cast("int") == F.col("key3"))
        .where("side1 <> side2")
        .select(
            F.col("o_orderkey").alias("candidate_id"), "side1", "side2", "venue", F.col("o_orderdate").cast("date").alias("as_of")
        )
    )


CANDIDATES_SQL = """candidates AS (
  SELECT o_orderkey AS candidate_id, n1.n_name AS side1, n2.n_name AS side2, concat('Ground ', n3.n_name) AS venue,
         CAST(o_orderdate AS DATE) AS as_of, least(n1.n_name, n2.n_name) AS low, greatest(n1.n_name, n2.n_name) AS high
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey
  JOIN nation n2 ON o_orderkey % 25 = n2.n_nationkey JOIN nation n3 ON o_custkey % 25 = n3.n_nationkey
  WHERE n1.n_name <> n2.n_name)"""


def _after_sql(side: str, won: str) -> str:
    """Form after the last contest of each day."""
    return f"""SELECT {side} AS side, contest_date, form FROM (
      SELECT {side}, contest_date, CAST(sum({won}) OVER w AS DOUBLE) / nullif(count({won}) OVER w, 0) AS form,
        row_number() OVER (PARTITION BY {side}, contest_date ORDER BY contest_id DESC) AS rn FROM contests
      WINDOW w AS (PARTITION BY {side} ORDER BY contest_date, contest_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
      WHERE rn = 1"""


CANDIDATE_FEATURES_SQL = f"""WITH {CONTESTS_SQL}, {PAIRS_SQL}, {CANDIDATES_SQL},
        after1 AS ({_after_sql("side1", "side1_won")}), after2 AS ({_after_sql("side2", "(1 - side1_won)")}),
        pair_days AS (SELECT low, high, contest_date, sum(count(*)) OVER w AS met, sum(sum(low_won)) OVER w AS low_wins,
            sum(sum(high_won)) OVER w AS high_wins FROM paired GROUP BY low, high, contest_date
          WINDOW w AS (PARTITION BY low, high ORDER BY contest_date)),
        venue_days AS (SELECT side1, venue, contest_date, sum(count(*)) OVER w AS played,
            sum(sum(coalesce(side1_won, 0))) OVER w AS wins FROM contests GROUP BY side1, venue, contest_date
          WINDOW w AS (PARTITION BY side1, venue ORDER BY contest_date))
        SELECT candidate_id, c.side1, c.side2, coalesce(a1.form, -1) AS side1_form, coalesce(a2.form, -1) AS side2_form,
          CASE WHEN met IS NULL THEN 0.5 ELSE CAST(CASE WHEN c.side1 = c.low THEN low_wins ELSE high_wins END AS DOUBLE)
            / CAST(met AS DOUBLE) END AS head_to_head,
          CASE WHEN played IS NULL THEN 0.5 ELSE CAST(wins AS DOUBLE) / CAST(played AS DOUBLE) END AS venue_record,
          CAST(CASE WHEN contains(lower(c.venue), lower(c.side1)) OR contains(lower(c.venue), lower(c.side2)) THEN 0 ELSE 1 END
            AS DOUBLE) AS neutral_venue
        FROM candidates c
        ASOF LEFT JOIN after1 a1 ON c.side1 = a1.side AND c.as_of > a1.contest_date
        ASOF LEFT JOIN after2 a2 ON c.side2 = a2.side AND c.as_of > a2.contest_date
        ASOF LEFT JOIN pair_days p ON c.low = p.low AND c.high = p.high AND c.as_of > p.contest_date
        ASOF LEFT JOIN venue_days v ON c.side1 = v.side1 AND c.venue = v.venue AND c.as_of > v.contest_date"""


@query("p_candidate_features", CANDIDATE_FEATURES_SQL)
def p_candidate_features(spark, folder):
    df = features.candidate_features(contest_table(spark, folder), candidates(spark, folder))
    known = {name: F.coalesce(name, F.lit(-1.0)) for name in ("side1_form", "side2_form")}
    return df.withColumns(known).drop("venue", "as_of")
