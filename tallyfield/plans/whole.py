"""The whole path in one call: raw files, clean tables, keys, a version of the star schema, features, a model.

Only the contests are needed; other files that are missing are left out with a warning. Score rows whose contest nobody
knows cannot be loaded: they are handed back, not dropped.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators import keys
from tallyfield.plans import features, models, records, versions
from tallyfield.session import materialise
from tallyfield.sources import tables

RAW = {
    "matches": tables.RAW_MATCHES, "players": tables.RAW_PLAYERS, "batting": tables.RAW_BATTING, "bowling": tables.RAW_BOWLING,
}
# A contest that is listed twice with different texts: the last in this order stays.
MATCH_ORDER = ["matchDate", "winner", "margin", "ground", "team1", "team2"]


@dataclass(frozen=True)
class Outcome:
    version: int
    star: dict[str, DataFrame]
    absent: list[str]
    unresolved: dict[str, DataFrame]
    trained: models.Trained | None


def load_files(spark: SparkSession, raw: Mapping[str, str], target: str) -> Outcome:
    """Clean, key and load the files of ``raw`` (by the names of ``RAW``) as the next version below ``target``."""
    there, absent = tables.present_inputs(spark, {name: raw[name] for name in RAW if name in raw})
    absent += [name for name in RAW if name not in raw]
    if "matches" in absent:
        raise tables.MissingInput(raw.get("matches", "matches"))

    def read(name: str) -> DataFrame:
        if name in there:
            found = tables.read_delimited(spark, there[name], RAW[name])
        else:
            found = spark.createDataFrame([], tables.text_schema(RAW[name]))
        lacking = [F.lit(None).cast("string").alias(c) for c in RAW[name] if c not in found.columns]
        return found.select("*", *lacking)

    matches = materialise(records.clean_matches(read("matches")), "whole-matches")
    arrival = read("players").withColumn("ingest_seq", F.monotonically_increasing_id())
    players = records.clean_players(arrival, ["ingest_seq"])
    bridge = keys.pair_key_bridge(matches, "team1", "team2", "match_id", ["matchDate"])
    scores, unresolved = {}, {}
    for name, clean in (("batting", records.clean_batting), ("bowling", records.clean_bowling)):
        keyed = materialise(records.add_match_key(clean(read(name)), bridge), f"whole-{name}")
        scores[name], unresolved[name] = keyed.where("match_id IS NOT NULL"), keyed.where("match_id IS NULL")
    version = versions.load_version(
        spark, target, matches, players, scores["batting"], scores["bowling"], MATCH_ORDER, ["ingest_seq"]
    )
    return Outcome(version, versions.read_version(spark, target, version), absent, unresolved, None)


def run(spark: SparkSession, raw: Mapping[str, str], target: str, model_path: str) -> Outcome:
    """``load_files``, then train on all contests of the new version and save the model."""
    done = load_files(spark, raw, target)
    frame = features.training_frame(records.contests_from_star(done.star["matches"], done.star["teams"]))
    trained = models.train(frame)
    models.save(trained, model_path)
    return Outcome(done.version, done.star, done.absent, done.unresolved, trained)
