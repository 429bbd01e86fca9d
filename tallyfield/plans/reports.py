"""The analytical reports; all names of entities, venues and measures are columns of the input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.numbers import rounded_ratio
from tallyfield.functions.outcomes import same_pair
from tallyfield.operators import aggregates, ordered
from tallyfield.sources.tables import run_sql


def top_scorers_by_venue(scores: DataFrame, venue: str, entity: Sequence[str], score: str, count: int = 5) -> DataFrame:
    """Highest total scores per venue with the number of innings."""
    totals = aggregates.sum_and_count(scores, [venue, *entity], score, "total", "innings")
    ranked = [F.col("total").desc(), *[F.col(name) for name in entity]]
    return aggregates.top_per_group(totals, [venue], ranked, count, rank="rank")


def _sides(contests: DataFrame) -> DataFrame:
    return aggregates.both_roles(contests, "side1", "side2", "side", "role", ["winner"])


def win_rates(contests: DataFrame, denominator: str = "all") -> DataFrame:
    """Win percentage per side.

    ``denominator="all"`` divides by all contests of a side. ``"side1"`` divides by those it was listed first in,
    which can exceed 100 %, and leaves out sides that never were.
    """
    # Both columns come out of one pass: wins are counted in either role, contests in the wanted ones.
    counted = F.lit(True) if denominator == "all" else F.col("role") == 1
    grouped = _sides(contests).groupBy("side").agg(
        F.count_if(counted).alias("contests"), F.count_if(F.col("winner") == F.col("side")).alias("wins")
    )
    pct = rounded_ratio(F.col("wins"), F.col("contests"), 100)
    return grouped.where("contests > 0").withColumn("win_percentage", pct)


def decision_outcomes(contests: DataFrame, chooser: str, decision: str, winner: str) -> DataFrame:
    """How often the side that took a decision went on to win, per side and decision."""
    grouped = aggregates.count_where(contests, [chooser, decision], {"wins": F.col(winner) == F.col(chooser)}, "contests")
    return grouped.withColumn("win_percentage", rounded_ratio(F.col("wins"), F.col("contests"), 100))


def economy(spells: DataFrame, team: str, runs: str, overs: str, wickets: Column, digits: int = 1) -> DataFrame:
    """Runs per over and wickets per six overs, per team; overs have up to ``digits`` decimals and are summed exactly."""
    exact = F.sum(F.col(overs).cast(f"decimal(18,{digits})"))
    grouped = spells.groupBy(team).agg(
        F.sum(runs).alias("total_runs"), exact.alias("total_overs"), F.sum(wickets).alias("total_wickets"),
        F.count(F.lit(1)).alias("spells"),
    )
    rated = grouped.withColumns(
        {
            "economy": rounded_ratio(F.col("total_runs"), F.col("total_overs"), digits=digits),
            "wickets_per_6_overs": rounded_ratio(F.col("total_wickets"), F.col("total_overs"), 6, digits=digits),
        }
    )
    return rated.withColumn("total_overs", F.col("total_overs").cast("double"))


# Names of the phases and the overs that end the first and begin the last.
def phase(over: Column, early: int = 6, late: int = 16) -> Column:
    return F.when(over <= early, "powerplay").when(over >= late, "death").otherwise("middle")


def phase_rates(balls: DataFrame, team: str, over: Column, runs: str, wicket: Column, early: int = 6, late: int = 16):
    """Runs and wickets per over in the first and the last phase."""
    phased = balls.withColumn("phase", phase(over, early, late)).where("phase <> 'middle'")
    grouped = phased.groupBy(team, "phase").agg(
        F.sum(runs).alias("runs"), F.count_if(wicket).alias("wickets"), F.count(F.lit(1)).alias("balls")
    )
    return grouped.withColumns(
        {
            "run_rate": rounded_ratio(F.col("runs"), F.col("balls"), 6),
            "wicket_rate": rounded_ratio(F.col("wickets"), F.col("balls"), 6),
        }
    )


def form_trend(
    outings: DataFrame, entity: str, order: Sequence[str], value: str, length: int = 5, who=None,
    partitions: int | None = None,
) -> DataFrame:
    """Outings of every entity, or of ``who`` alone, in order: their number and the mean of the last five including
    the current one."""
    own = outings if who is None else outings.where(F.col(entity) == F.lit(who))
    ranges = ordered.in_ranges(own, [entity], order, partitions)
    numbered = ordered.number_rows(ranges, [entity], order, "number")
    means = {"rolling_mean": ordered.mean_of(value)}
    return ordered.whole(ordered.rolling(numbered, [entity], order, value, (1 - length, 0), means))


def head_to_head(contests: DataFrame, one: str, other: str, oriented: bool = True) -> DataFrame:
    """Record of two sides. ``oriented`` keeps "A against B" apart from "B against A"."""
    met = contests.where(same_pair(F.col("side1"), F.col("side2"), one, other))
    if not oriented:
        met = met.select(F.least("side1", "side2").alias("side1"), F.greatest("side1", "side2").alias("side2"), "winner")
    won1, won2 = F.col("winner") == F.col("side1"), F.col("winner") == F.col("side2")
    neither = ~F.coalesce(won1 | won2, F.lit(False))
    grouped = aggregates.count_where(
        met, ["side1", "side2"], {"side1_wins": won1, "side2_wins": won2, "no_results": neither}, "contests"
    )
    return grouped.withColumns(
        {
            "side1_percentage": rounded_ratio(F.col("side1_wins"), F.col("contests"), 100),
            "side2_percentage": rounded_ratio(F.col("side2_wins"), F.col("contests"), 100),
        }
    )


def recent_results(spark: SparkSession, contests: DataFrame, one: str, other: str, count: int = 10) -> DataFrame:
    """Latest contests of two sides, newest first."""
    return run_sql(
        spark,
        """SELECT contest_id, side1, side2,
                  CASE WHEN winner IN (side1, side2) THEN winner ELSE 'No Result' END AS winner, margin, contest_date
           FROM {contests}
           WHERE (side1 = :one AND side2 = :other) OR (side1 = :other AND side2 = :one)
           ORDER BY contest_date DESC, contest_id DESC LIMIT :count""",
        {"one": one, "other": other, "count": count},
        contests=contests,
    )


def top_scorer_by_venue(scores: DataFrame, venue: str, entity: str, score: str, venues: int = 10) -> DataFrame:
    """Highest total per venue, for the first venues by name."""
    totals = aggregates.sum_and_count(scores, [venue, entity], score, "total", "innings").drop("innings")
    return aggregates.best_per_group(totals, [venue], "total", [entity]).orderBy(venue).limit(venues)


def common_pairings(contests: DataFrame, minimum: int = 2, count: int = 10) -> DataFrame:
    """Most played pairings. ``side2_wins`` is what side 1 did not win, so it includes contests without a result;
    ``no_results`` says how many those are."""
    won1, won2 = F.col("winner") == F.col("side1"), F.col("winner") == F.col("side2")
    neither = ~F.coalesce(won1 | won2, F.lit(False))
    grouped = aggregates.count_where(contests, ["side1", "side2"], {"side1_wins": won1, "no_results": neither}, "contests")
    kept = aggregates.at_least(grouped, "contests", minimum)
    named = kept.withColumns(
        {"side2_wins": F.col("contests") - F.col("side1_wins"), "label": F.concat_ws(" vs ", "side1", "side2")}
    )
    return aggregates.top_rows(named, [F.col("contests").desc(), F.col("side1"), F.col("side2")], count)


def side_venue_record(contests: DataFrame) -> DataFrame:
    """Contests and wins of every side at every venue, in either role."""
    views = aggregates.both_roles(contests, "side1", "side2", "side", "role", ["winner", "venue"])
    return aggregates.count_where(views, ["side", "venue"], {"wins": F.col("winner") == F.col("side")}, "contests")


def best_venues(contests: DataFrame, minimum: int = 2, count: int = 15) -> DataFrame:
    """Side and venue combinations with the most contests, with the win percentage to one place."""
    kept = aggregates.at_least(side_venue_record(contests), "contests", minimum)
    rated = kept.withColumn("win_pct", rounded_ratio(F.col("wins"), F.col("contests"), 100, places=1))
    return aggregates.top_rows(rated, [F.col("contests").desc(), F.col("side"), F.col("venue")], count)
