"""What was known before a contest: form, head-to-head, venue record, neutral venue.

Input: contests with ``contest_id, side1, side2, side1_won, venue, contest_date``; ``side1_won`` is NULL where the
outcome is unknown. Such contests count as played, never as won.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.outcomes import neutral_flag
from tallyfield.operators import ordered
from tallyfield.session import materialise

FEATURES = ("side1_form", "side2_form", "head_to_head", "venue_record", "neutral_venue")
LABEL = "side1_won"
NO_HISTORY = 0.5
FORM_LENGTH = 5


def own_outcome(side: str) -> Column:
    """Outcome from the point of view of the side in column ``side1`` or ``side2``."""
    return F.col("side1_won") if side == "side1" else 1 - F.col("side1_won")


def add_form(
    df: DataFrame,
    side: str,
    into: str,
    partitions: int | None = None,
    length: int = FORM_LENGTH,
    tiebreak: str = "contest_id",
) -> DataFrame:
    """Mean outcome of the last five contests the side was listed in the same column for, this one left out."""
    dated = df.withColumn("_won", own_outcome(side))
    order = ["contest_date", tiebreak]
    partitions = partitions or ordered.tasks_for(df.sparkSession, df.count())
    ranges = ordered.in_ranges(dated, [side], order, partitions)
    rolled = ordered.rolling(
        ranges, [side], order, "_won", (-length, -1), {into: ordered.mean_of("_won")}, partitions
    )
    return ordered.whole(rolled).drop("_won")


def listed_appearances(df: DataFrame) -> DataFrame:
    """One row per side and contest with the side's own outcome, whichever column it was listed in."""
    views = F.array(
        F.struct(F.col("side1").alias("side"), own_outcome("side1").alias("won"), F.lit(1).alias("role")),
        F.struct(F.col("side2").alias("side"), own_outcome("side2").alias("won"), F.lit(2).alias("role")),
    )
    return df.select("contest_id", "contest_date", "venue", F.inline(views))


def form_over_all(df: DataFrame, partitions: int | None = None, length: int = FORM_LENGTH) -> DataFrame:
    """Form over all contests of a side, in either column: (contest_id, side, role, form)."""
    long = listed_appearances(df)
    partitions = partitions or ordered.tasks_for(df.sparkSession, 2 * df.count())
    order = ["contest_date", "contest_id", "role"]
    return ordered.rolling(
        ordered.in_ranges(long, ["side"], order, partitions), ["side"], order, "won", (-length, -1), {"form": ordered.mean_of("won")}, partitions
    ).select("contest_id", "side", "role", "form")


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumns({"_low": F.least("side1", "side2"), "_high": F.greatest("side1", "side2")})


def _pair_totals() -> dict[str, Column]:
    low_is_first = F.col("side1") == F.col("_low")
    low_won = F.col("side1_won") == F.when(low_is_first, 1).otherwise(0)
    high_won = F.col("side1_won") == F.when(low_is_first, 0).otherwise(1)
    return {
        "_met": F.lit(1),
        "_low_wins": F.when(low_won, 1).otherwise(0),
        "_high_wins": F.when(high_won, 1).otherwise(0),
    }


def _venue_totals() -> dict[str, Column]:
    return {"_played": F.lit(1), "_wins": F.coalesce(F.col("side1_won"), F.lit(0))}


def _share(wins: Column, played: Column) -> Column:
    """Share of wins; the neutral default where nothing was played, which a NULL venue also counts as."""
    return F.when(F.coalesce(played, F.lit(0)) == 0, F.lit(NO_HISTORY)).otherwise(
        wins.cast("double") / F.nullif(played, F.lit(0))
    )


def _dealt(df: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    return df.repartition(partitions, *keys) if partitions else df


def _with_pair_share(df: DataFrame, totals: DataFrame, into: str, partitions: int | None = None) -> DataFrame:
    keys = ["_low", "_high", "contest_date"]
    joined = _dealt(df, keys, partitions).join(totals, keys, "left")
    wins = F.when(F.col("side1") == F.col("_low"), F.col("_low_wins")).otherwise(F.col("_high_wins"))
    return joined.withColumn(into, _share(wins, F.col("_met"))).drop("_low", "_high", "_met", "_low_wins", "_high_wins")


def _with_venue_share(df: DataFrame, totals: DataFrame, into: str, partitions: int | None = None) -> DataFrame:
    keys = ["side1", "venue", "contest_date"]
    joined = _dealt(df, keys, partitions).join(totals, keys, "left")
    return joined.withColumn(into, _share(F.col("_wins"), F.col("_played"))).drop("_played", "_wins")


def add_head_to_head(df: DataFrame, into: str = "head_to_head") -> DataFrame:
    """Share of earlier contests of the same two sides, in either order, that side 1 won."""
    paired = _pair(df)
    return _with_pair_share(
        paired, ordered.totals_before(paired, ["_low", "_high"], "contest_date", _pair_totals()), into
    )


def add_venue_record(df: DataFrame, into: str = "venue_record") -> DataFrame:
    """Share of side 1's earlier contests at this venue, as side 1, that it won."""
    return _with_venue_share(df, ordered.totals_before(df, ["side1", "venue"], "contest_date", _venue_totals()), into)


def add_neutral_flag(df: DataFrame, into: str = "neutral_venue") -> DataFrame:
    return df.withColumn(into, neutral_flag(F.col("venue"), F.col("side1"), F.col("side2")))


def add_all_features(contests: DataFrame, partitions: int | None = None) -> DataFrame:
    """All five features on every contest. ``contests`` is read several times: hand in a stored table."""
    partitions = partitions or ordered.tasks_for(contests.sparkSession, contests.count())
    df = add_form(contests, "side1", "side1_form", partitions)
    if partitions:  # stored, since a range sort reads its rows twice
        df = materialise(df, "form")
    df = add_form(df, "side2", "side2_form", partitions)
    paired = _pair(contests)
    pairs = ordered.totals_before(paired, ["_low", "_high"], "contest_date", _pair_totals())
    venues = ordered.totals_before(contests, ["side1", "venue"], "contest_date", _venue_totals())
    df = _with_pair_share(_pair(df), pairs, "head_to_head", partitions)
    df = _with_venue_share(df, venues, "venue_record", partitions)
    return add_neutral_flag(df)


def training_frame(contests: DataFrame, partitions: int | None = None) -> DataFrame:
    """Contests with a known outcome and complete features, in the types the models expect."""
    used = contests.select("contest_id", "side1", "side2", LABEL, "venue", "contest_date")
    full = add_all_features(used, partitions).dropna(subset=[LABEL, *FEATURES])
    numbers = [F.col(name).cast("double").alias(name) for name in FEATURES]
    return full.select(
        "contest_id", "side1", "side2", "venue", "contest_date", *numbers, F.col(LABEL).cast("int").alias(LABEL)
    )


def candidate_features(contests: DataFrame, candidates: DataFrame, length: int = FORM_LENGTH) -> DataFrame:
    """Features of contests that have not been played, as of a date each.

    ``candidates`` has ``candidate_id, side1, side2, venue, as_of``. Everything strictly before ``as_of`` counts;
    candidates never count for each other. Look-ups are made once per distinct question (side, pair or venue and
    date), not once per candidate.
    """
    asked = candidates.withColumn("contest_date", F.col("as_of"))
    out = asked
    for side in ("side1", "side2"):
        history = contests.withColumn("_won", own_outcome(side))
        recent = ordered.recent_as_of(
            history, asked, [side], "contest_date", ["contest_date", "contest_id"], "_won", length, "_recent"
        )
        known = recent.select(side, "contest_date", ordered.mean_of_array(F.col("_recent")).alias(f"{side}_form"))
        out = out.join(known, [side, "contest_date"], "left")
    asked_pairs = _pair(asked)
    pairs = ordered.totals_as_of(_pair(contests), asked_pairs, ["_low", "_high"], "contest_date", _pair_totals())
    venues = ordered.totals_as_of(contests, asked, ["side1", "venue"], "contest_date", _venue_totals())
    out = _with_pair_share(_pair(out), pairs, "head_to_head")
    out = _with_venue_share(out, venues, "venue_record")
    numbers = [F.col(name).cast("double").alias(name) for name in FEATURES]
    return add_neutral_flag(out).select("candidate_id", "side1", "side2", "venue", "as_of", *numbers)


def impute(df: DataFrame) -> DataFrame:
    """Replace missing form by the neutral default and say so."""
    missing = F.lit(False)
    for name in FEATURES:
        missing = missing | F.col(name).isNull()
    return df.withColumn("was_imputed", missing).fillna(NO_HISTORY, subset=list(FEATURES))
