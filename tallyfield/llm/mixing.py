"""Mixing sources to target weights: whole repeats plus one Bernoulli copy, drawn systematically.

A document's extra copy has probability equal to the fraction of its source's rate, but the draws of a source are not
independent: documents are ordered by size and hash, a hash of the source gives one offset, and document number p gets the
copy where floor(p * fraction + offset) rises. Every document keeps its probability, and documents of like size take turns, so
the words taken differ from the target by about one document, however uneven the sizes are. Numbers are given in
ranges of the order, so a hot source is spread over many tasks.

Sizes are summed per source first, so a source that holds a third of all rows costs one partial sum per task. The
table of sources has one row each; it is written to the shared folder, so the planner knows its size and broadcasts
it only if it is small, or else joins by shuffle and lets skewed sources be split.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; repeated rows are drawn
alike: equal ids of one size in a source share one draw; a null ``doc_id`` hashes as the text "null". Documents of size 0
take nothing whatever their copies. An empty table gives an empty table. Other columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import free_name, query, table, unit_hash, word_count
from tallyfield.operators.ordered import in_ranges, number_rows, whole
from tallyfield.session import materialise

#: Weights of the sources in order, how often a document may be taken, seed of the draws.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 20240


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source of ``sizes(source, size)``: source, source_size, target (double).

    Targets share the sum of all sizes by weight. Where a share is above ``most`` times its source's size it stops
    there, and the rest is shared anew by weight. In order of cap over weight, a source is capped exactly if the
    level that remains for it and all later ones reaches its cap, so one ordered pass over the sources settles all.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * most
    by_level = Window.orderBy("reach", "place")
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        totals.withColumn("place", place)
        .withColumn("weight", weight)
        .withColumn("reach", cap.cast("double") / F.col("weight"))
        .withColumn("level", left.cast("double") / weights_left)
        .withColumn("capped", F.col("reach") <= F.col("level"))
        .withColumn("common", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
        .select(
            "source",
            "source_size",
            F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("common") * F.col("weight")).alias("target"),
        )
    )


def repetition_rate(target: Column, source_size: Column, most: int = MOST_REPEATS) -> Column:
    """How often a source's documents are taken on average."""
    return F.when(source_size > 0, F.least(target / source_size, F.lit(float(most)))).otherwise(0.0)


def extra_copies(each: DataFrame, targets: DataFrame, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """Those of ``each(source, doc_id, size)``, all different, that get one more copy."""
    order = ["size", "draw", "doc_id"]
    drawn = each.select("source", "doc_id", "size", unit_hash(seed, F.col("doc_id")).alias("draw"))
    placed = whole(number_rows(in_ranges(drawn, ["source"], order), ["source"], order, "place"))
    rate = repetition_rate(F.col("target"), F.col("source_size"), most)
    offsets = targets.select(
        F.col("source").alias("of"), (rate - F.floor(rate)).alias("fraction"), unit_hash(seed, F.col("source")).alias("offset")
    )
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("of")))
    upto = lambda place: F.floor(place * F.col("fraction") + F.col("offset"))
    place = F.col("place").cast("double")
    return joined.where(upto(place) > upto(place - 1)).select("source", "doc_id", "size")


def with_copies(
    docs: DataFrame, sized: Column, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target and copies; second, the names these columns got."""
    own = ("size", "source_size", "target", "copies", "mix_source", "mix_from", "mix_id", "mix_size", "mix_extra")
    names = {n: free_name(docs, n) for n in own}
    # Sizes of all texts, read once for the totals and the draws.
    each = docs.select("source", "doc_id", sized.alias("size")).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"))
    each = materialise(each, "mix-sizes")
    sizes = each.select("source", (F.col("size") * F.col("rows")).alias("size"))
    targets = materialise(source_targets(sizes, weights, most), "mix-targets")
    extra = materialise(extra_copies(each, targets, most, seed), "mix-extra").select(
        F.col("source").alias(names["mix_from"]), F.col("doc_id").alias(names["mix_id"]), F.col("size").alias(names["mix_size"]),
        F.lit(1).alias(names["mix_extra"]),
    )
    of_source = targets.select(
        F.col("source").alias(names["mix_source"]),
        F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
    )
    same = (
        F.col("source").eqNullSafe(F.col(names["mix_from"]))
        & F.col("doc_id").eqNullSafe(F.col(names["mix_id"]))
        & F.col(names["size"]).eqNullSafe(F.col(names["mix_size"]))
    )
    joined = (
        docs.withColumn(names["size"], sized)
        .join(of_source, F.col("source").eqNullSafe(F.col(names["mix_source"])))
        .join(extra, same, "left")
    )
    rate = repetition_rate(F.col(names["target"]), F.col(names["source_size"]), most)
    number = (F.floor(rate) + F.coalesce(F.col(names["mix_extra"]), F.lit(0))).cast("long")
    helpers = [names[n] for n in own[4:]]
    return joined.withColumn(names["copies"], number).drop(*helpers), names


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with each row as often as the mix takes it; columns as they were."""
    drawn, names = with_copies(docs, word_count(), weights, most, seed)
    number = names["copies"]
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col(number)))
    taken = drawn.filter(F.col(number) > 0)
    return taken.select(*[taken[c] for c in docs.columns], repeats.alias(names["copies"])).drop(names["copies"])


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][(place % {len(WEIGHTS)} + 1)::INT] AS weight FROM totals
), levelled AS (
  SELECT *, {MOST_REPEATS} * source_size::DOUBLE / weight AS reach,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM weighed
), cut AS (
  SELECT *, (total - coalesce(sum({MOST_REPEATS} * source_size) OVER before, 0))::DOUBLE
    / (weights - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM levelled WINDOW before AS (ORDER BY reach, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN reach <= level THEN ({MOST_REPEATS} * source_size)::DOUBLE
    ELSE weight * max(CASE WHEN reach > level THEN level END) OVER () END AS target
  FROM cut
), rated AS (
  SELECT doc_id, sized.source, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(target / source_size, {MOST_REPEATS}.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), drawn AS (
  SELECT *, rate - floor(rate) AS fraction,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 13))::BIGINT / {2**52}.0::DOUBLE AS draw,
    ('0x' || substr(md5(coalesce(source, 'null') || ':{SEED}'), 1, 13))::BIGINT / {2**52}.0::DOUBLE AS start
  FROM rated
), placed AS (
  SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY size, draw, doc_id NULLS FIRST)::DOUBLE AS place FROM drawn
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + floor(place * fraction + start) - floor((place - 1) * fraction + start)))::BIGINT AS taken
FROM placed
"""


@query("op10_source_mixing", SQL)
def op10_source_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    drawn, names = with_copies(docs, word_count())
    return drawn.select(
        "doc_id", "size", "source_size", "target", (F.col(names["copies"]) * F.col("size")).alias("taken")
    )
