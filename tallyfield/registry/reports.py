"""Joins, aggregates, orderings and the named reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import numbers
from tallyfield.operators import aggregates, keys, ordered
from tallyfield.plans import reports
from tallyfield.plans.adapters import (
    CONTESTS_SQL,
    OUTINGS_SQL,
    PERFORMANCES_SQL,
    contests,
    outings,
    performances,
    table,
)
from tallyfield.registry import query


def _percent(top: str, bottom: str, scale: int = 100, places: int = 2) -> str:
    """Half-up rounding on integers, as SQL."""
    unit = 10**places
    return f"CAST(({2 * scale * unit} * {top} + {bottom}) // (2 * {bottom}) AS DOUBLE) / {unit}"


# --- joins -----------------------------------------------------------------------------------------------


@query(
    "join_fact_dims",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority, c_name, p_brand FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
)
def join_fact_dims(spark, folder):
    lines = table(spark, folder, "lineitem")
    return (
        lines.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority", "c_name", "p_brand")
    )


@query(
    "join_role_dims",
    """SELECT l_orderkey, l_linenumber, l_partkey, n1.n_name AS side1, n2.n_name AS side2 FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey""",
)
def join_role_dims(spark, folder):
    keyed = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    nation = table(spark, folder, "nation")
    for key, name in (("c_nationkey", "side1"), ("s_nationkey", "side2")):
        keyed = keys.lookup_key(keyed, nation, {key: "n_nationkey"}, "n_name", name)
    known = keyed.where("side1 IS NOT NULL AND side2 IS NOT NULL")
    return known.select("l_orderkey", "l_linenumber", "l_partkey", "side1", "side2")


@query(
    "left_join_coalesce",
    """SELECT c_custkey, coalesce(n, 0) AS urgent FROM customer LEFT JOIN (
         SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey""",
)
def left_join_coalesce(spark, folder):
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    counts = urgent.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    customers = table(spark, folder, "customer").select("c_custkey")
    return customers.join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("urgent"))


@query(
    "either_role_stats",
    f"""WITH {CONTESTS_SQL} SELECT n_name AS side, venue, count(*) AS contests,
          CAST(sum(CASE WHEN winner = n_name THEN 1 ELSE 0 END) AS BIGINT) AS wins,
          CAST(count(*) - sum(CASE WHEN winner = n_name THEN 1 ELSE 0 END) AS BIGINT) AS not_won
        FROM contests JOIN nation ON side1 = n_name OR side2 = n_name GROUP BY 1, 2""",
)
def either_role_stats(spark, folder):
    record = reports.side_venue_record(contests(spark, folder))
    return record.withColumn("not_won", F.col("contests") - F.col("wins"))


# --- aggregates ------------------------------------------------------------------------------------------


@query(
    "sum_count_by_key",
    f"""WITH {PERFORMANCES_SQL} SELECT venue, entity, CAST(sum(score) AS BIGINT) AS total, count(*) AS innings
        FROM performances GROUP BY 1, 2""",
)
def sum_count_by_key(spark, folder):
    return aggregates.sum_and_count(performances(spark, folder), ["venue", "entity"], "score", "total", "innings")


@query(
    "conditional_counts",
    """SELECT l_suppkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned,
         count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY 1""",
)
def conditional_counts(spark, folder):
    conditions = {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"}
    return aggregates.count_where(table(spark, folder, "lineitem"), ["l_suppkey"], conditions, "lines")


@query(
    "having_min_count",
    "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1 HAVING count(*) >= 12",
)
def having_min_count(spark, folder):
    grouped = aggregates.count_where(table(spark, folder, "orders"), ["o_custkey"], {}, "orders")
    return aggregates.at_least(grouped, "orders", 12)


@query(
    "safe_ratio",
    """SELECT l_partkey, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE)
         / nullif(count(*) FILTER (l_returnflag = 'A'), 0) AS returned_per_accepted,
         CAST((200 * count(*) FILTER (l_returnflag = 'R') + nullif(count(*) FILTER (l_returnflag = 'A'), 0))
           // (2 * nullif(count(*) FILTER (l_returnflag = 'A'), 0)) AS DOUBLE) / 100 AS rounded
       FROM lineitem GROUP BY 1""",
)
def safe_ratio(spark, folder):
    conditions = {"r": F.col("l_returnflag") == "R", "a": F.col("l_returnflag") == "A"}
    grouped = aggregates.count_where(table(spark, folder, "lineitem"), ["l_partkey"], conditions, "n")
    return grouped.select(
        "l_partkey",
        numbers.safe_ratio(F.col("r"), F.col("a")).alias("returned_per_accepted"),
        numbers.rounded_ratio(F.col("r"), F.col("a")).alias("rounded"),
    )


@query(
    "top1_per_group",
    f"""WITH {PERFORMANCES_SQL}, totals AS (SELECT venue, entity, CAST(sum(score) AS BIGINT) AS total FROM performances GROUP BY 1, 2)
        SELECT venue, entity, total FROM (
          SELECT *, row_number() OVER (PARTITION BY venue ORDER BY total DESC, entity) AS rn FROM totals) WHERE rn = 1""",
)
def top1_per_group(spark, folder):
    totals = performances(spark, folder).groupBy("venue", "entity").agg(F.sum("score").alias("total"))
    return aggregates.best_per_group(totals, ["venue"], "total", ["entity"])


@query("value_counts", "SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY 1")
def value_counts(spark, folder):
    return aggregates.value_counts(table(spark, folder, "lineitem"), "l_returnflag")


@query(
    "mean_std_pop",
    """SELECT l_returnflag, CAST(s AS DOUBLE) / n AS quantity_mean,
         sqrt(CAST(n * q - s * s AS DOUBLE) / CAST(n * n AS DOUBLE)) AS quantity_std
       FROM (SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS s,
               sum(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1)""",
)
def mean_std_pop(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("quantity"))
    return aggregates.mean_and_spread(lines, ["l_returnflag"], ["quantity"])


@query(
    "confusion_matrix",
    f"""WITH {CONTESTS_SQL} SELECT side1_won, count(*) FILTER (margin <= 25) AS predicted_0,
          count(*) FILTER (margin > 25) AS predicted_1 FROM contests WHERE side1_won IS NOT NULL GROUP BY 1""",
)
def confusion_matrix(spark, folder):
    decided = contests(spark, folder).where("side1_won IS NOT NULL")
    guessed = decided.select("side1_won", F.when(F.col("margin") > 25, 1).otherwise(0).alias("guess"))
    return aggregates.confusion_matrix(guessed, "side1_won", "guess")


# --- orderings, top-k, set operations --------------------------------------------------------------------


@query(
    "topk_per_group",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY l_returnflag
           ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem)
       WHERE rank <= 25""",
)
def topk_per_group(spark, folder):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, folder, "lineitem").select("l_returnflag", *columns, "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in columns]]
    return aggregates.top_per_group(lines, ["l_returnflag"], order, 25, rank="rank")


@query(
    "order_multi",
    """SELECT r_name, s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey ORDER BY r_name, s_acctbal DESC, s_name""",
)
def order_multi(spark, folder):
    joined = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select("r_name", "s_name", "s_acctbal").orderBy("r_name", F.desc("s_acctbal"), "s_name")


@query(
    "top_n_global",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def top_n_global(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return aggregates.top_rows(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100)


@query(
    "rank_by_abs",
    """WITH lines AS (SELECT *, row_number() OVER () AS line FROM lineitem),
       parts AS (SELECT line, l_orderkey, l_linenumber, l_partkey, l_suppkey, u.feature, u.contribution FROM lines,
         LATERAL (SELECT unnest([{'feature': 'discount', 'contribution': CAST(round(l_discount * 100) AS BIGINT)},
           {'feature': 'size', 'contribution': CAST(l_linenumber - 10 AS BIGINT)},
           {'feature': 'tax', 'contribution': CAST(-round(l_tax * 100) AS BIGINT)}]) AS u))
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, feature, contribution, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY line ORDER BY abs(contribution) DESC, feature) AS rank FROM parts)""",
)
def rank_by_abs(spark, folder):
    parts = F.array(
        F.struct(F.lit("discount").alias("feature"), F.round(F.col("l_discount") * 100).cast("long").alias("contribution")),
        F.struct(F.lit("size").alias("feature"), (F.col("l_linenumber") - 10).cast("long").alias("contribution")),
        F.struct(F.lit("tax").alias("feature"), (-F.round(F.col("l_tax") * 100)).cast("long").alias("contribution")),
    )
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ranked = table(spark, folder, "lineitem").select(*key, F.posexplode(aggregates.rank_by_size(parts)).alias("r", "p"))
    return ranked.select(*key, "p.*", (F.col("r") + 1).alias("rank"))


@query("set_union", "SELECT c_nationkey AS nation_key FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation_key"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation_key"))
    return customers.union(suppliers).distinct()


@query(
    "append_candidates",
    f"""WITH {CONTESTS_SQL} SELECT contest_id, side1, side2, coalesce(side1_won, -1) AS side1_won FROM contests
        UNION ALL SELECT -c_custkey - 1, c_name, c_mktsegment, -1 FROM customer""",
)
def append_candidates(spark, folder):
    history = contests(spark, folder).select("contest_id", "side1", "side2", "side1_won")
    asked = table(spark, folder, "customer").select(
        (-F.col("c_custkey") - 1).alias("contest_id"), F.col("c_name").alias("side1"), F.col("c_mktsegment").alias("side2")
    )
    both = history.unionByName(asked, allowMissingColumns=True)
    return both.withColumn("side1_won", F.coalesce("side1_won", F.lit(-1)))


# --- named reports ---------------------------------------------------------------------------------------


@query(
    "q_top5_by_venue",
    f"""WITH {PERFORMANCES_SQL}, totals AS (
          SELECT venue, entity, team, CAST(sum(score) AS BIGINT) AS total, count(*) AS innings FROM performances GROUP BY 1, 2, 3)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY total DESC, entity, team) AS rank FROM totals)
        WHERE rank <= 5""",
)
def q_top5_by_venue(spark, folder):
    return reports.top_scorers_by_venue(performances(spark, folder), "venue", ["entity", "team"], "score")


_WIN_RATE = """SELECT side, contests, wins, {pct} AS win_percentage FROM (
  SELECT n_name AS side, (SELECT count(*) FROM contests WHERE side1 = n_name{extra}) AS contests,
         (SELECT count(*) FROM contests WHERE winner = n_name) AS wins FROM nation) WHERE contests > 0"""


WIN_RATE_SQL = _WIN_RATE.format(pct=_percent("wins", "contests"), extra=" OR side2 = n_name")


@query("q_win_pct", f"WITH {CONTESTS_SQL} {WIN_RATE_SQL}")
def q_win_pct(spark, folder):
    return reports.win_rates(contests(spark, folder))


@query("q_win_pct_side1", f"WITH {CONTESTS_SQL} {_WIN_RATE.format(pct=_percent('wins', 'contests'), extra='')}")
def q_win_pct_side1(spark, folder):
    return reports.win_rates(contests(spark, folder), denominator="side1")


@query(
    "q_decision_outcome",
    f"""WITH {PERFORMANCES_SQL} SELECT team, l_linestatus AS decision, count(*) AS contests,
          count(*) FILTER (l_returnflag = 'A') AS wins,
          {_percent("count(*) FILTER (l_returnflag = 'A')", "count(*)")} AS win_percentage
        FROM performances GROUP BY 1, 2""",
)
def q_decision_outcome(spark, folder):
    chosen = performances(spark, folder).select(
        "team", F.col("l_linestatus").alias("decision"), F.when(F.col("l_returnflag") == "A", F.col("team")).alias("won_by")
    )
    return reports.decision_outcomes(chosen, "team", "decision", "won_by")


@query(
    "q_economy",
    f"""WITH {PERFORMANCES_SQL}, t AS (SELECT team, CAST(sum(conceded) AS BIGINT) AS total_runs,
          CAST(sum(score) AS BIGINT) AS tenths, count(*) FILTER (l_returnflag = 'R') AS total_wickets,
          count(*) AS spells FROM performances GROUP BY 1)
        SELECT team, total_runs, CAST(tenths AS DOUBLE) / 10 AS total_overs, total_wickets, spells,
          {_percent("total_runs", "tenths", 10)} AS economy, {_percent("total_wickets", "tenths", 60)} AS wickets_per_6_overs
        FROM t""",
)
def q_economy(spark, folder):
    """Overs with a fraction: a tenth of the quantity."""
    wicket = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    spells = performances(spark, folder).withColumn("overs", F.col("score") / 10.0)
    return reports.economy(spells, "team", "conceded", "overs", wicket)


@query(
    "q_phase_rates",
    f"""WITH {PERFORMANCES_SQL}, t AS (SELECT team, CASE WHEN l_linenumber <= 2 THEN 'powerplay' ELSE 'death' END AS phase,
          CAST(sum(score) AS BIGINT) AS runs, count(*) FILTER (l_returnflag = 'R') AS wickets, count(*) AS balls
          FROM performances WHERE l_linenumber <= 2 OR l_linenumber >= 6 GROUP BY 1, 2)
        SELECT *, {_percent("runs", "balls", 6)} AS run_rate, {_percent("wickets", "balls", 6)} AS wicket_rate FROM t""",
)
def q_phase_rates(spark, folder):
    over, wicket = F.col("l_linenumber"), F.col("l_returnflag") == "R"
    return reports.phase_rates(performances(spark, folder), "team", over, "score", wicket, early=2, late=6)


_FORM_TREND = """SELECT event_id, entity, CAST(value AS DOUBLE) AS value, number, CAST(s AS DOUBLE) / n AS rolling_mean FROM (
  SELECT *, row_number() OVER w AS number, sum(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s,
    count(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n
  FROM outings WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id))"""


def _form_trend(spark, folder, who=None):
    trend = reports.form_trend(outings(spark, folder), "entity", ["ts", "event_id"], "value", who=who)
    return trend.select("event_id", "entity", F.col("value").cast("double").alias("value"), "number", "rolling_mean")


@query("q_form_trend", f"WITH {OUTINGS_SQL} {_FORM_TREND}")
def q_form_trend(spark, folder):
    return _form_trend(spark, folder)


@query("q_form_trend_of_one", f"WITH {OUTINGS_SQL} {_FORM_TREND} WHERE entity = 7")
def q_form_trend_of_one(spark, folder):
    """The report as asked for by name: one entity."""
    return _form_trend(spark, folder, 7)


@query(
    "q_head_to_head",
    f"""WITH {CONTESTS_SQL}, t AS (SELECT side1, side2, count(*) AS contests, count(*) FILTER (winner = side1) AS side1_wins,
          count(*) FILTER (winner = side2) AS side2_wins, count(*) FILTER (winner NOT IN (side1, side2)) AS no_results
          FROM contests WHERE side1 IN ('NATION_3', 'NATION_8') AND side2 IN ('NATION_3', 'NATION_8') GROUP BY 1, 2)
        SELECT *, {_percent("side1_wins", "contests")} AS side1_percentage,
          {_percent("side2_wins", "contests")} AS side2_percentage FROM t""",
)
def q_head_to_head(spark, folder):
    return reports.head_to_head(contests(spark, folder), "NATION_3", "NATION_8")


@query(
    "q_recent_results",
    f"""WITH {CONTESTS_SQL} SELECT contest_id, side1, side2,
          CASE WHEN winner IN (side1, side2) THEN winner ELSE 'No Result' END AS winner, margin,
          strftime(contest_date, '%Y-%m-%d') AS day
        FROM contests WHERE side1 IN ('NATION_3', 'NATION_8') AND side2 IN ('NATION_3', 'NATION_8')
        ORDER BY contest_date DESC, contest_id DESC LIMIT 10""",
)
def q_recent_results(spark, folder):
    recent = reports.recent_results(spark, contests(spark, folder), "NATION_3", "NATION_8")
    day = F.date_format("contest_date", "yyyy-MM-dd").alias("day")
    return recent.select("contest_id", "side1", "side2", "winner", "margin", day)


@query(
    "d_top_scorer",
    f"""WITH {PERFORMANCES_SQL}, totals AS (SELECT venue, entity, CAST(sum(score) AS BIGINT) AS total FROM performances GROUP BY 1, 2)
        SELECT venue, entity, total FROM (
          SELECT *, row_number() OVER (PARTITION BY venue ORDER BY total DESC, entity) AS rn FROM totals)
        WHERE rn = 1 ORDER BY venue LIMIT 10""",
)
def d_top_scorer(spark, folder):
    return reports.top_scorer_by_venue(performances(spark, folder), "venue", "entity", "score")


@query(
    "d_pairings",
    f"""WITH {CONTESTS_SQL} SELECT side1, side2, count(*) AS contests, count(*) FILTER (winner = side1) AS side1_wins,
          count(*) FILTER (winner NOT IN (side1, side2)) AS no_results,
          count(*) - count(*) FILTER (winner = side1) AS side2_wins, concat(side1, ' vs ', side2) AS label
        FROM contests GROUP BY side1, side2 HAVING count(*) >= 2 ORDER BY contests DESC, side1, side2 LIMIT 10""",
)
def d_pairings(spark, folder):
    return reports.common_pairings(contests(spark, folder))


@query(
    "d_team_venue",
    f"""WITH {CONTESTS_SQL}, t AS (SELECT n_name AS side, venue, count(*) AS contests, count(*) FILTER (winner = n_name) AS wins
          FROM contests JOIN nation ON side1 = n_name OR side2 = n_name GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT *, {_percent("wins", "contests", 100, 1)} AS win_pct FROM t ORDER BY contests DESC, side, venue LIMIT 15""",
)
def d_team_venue(spark, folder):
    return reports.best_venues(contests(spark, folder))
