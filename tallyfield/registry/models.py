"""Model queries. The comparison SQL fits the same models, by recursive queries."""

from __future__ import annotations

from math import factorial

import numpy as np
from pyspark.sql import functions as F

from tallyfield.operators import aggregates
from tallyfield.plans import boosting, features, models
from tallyfield.plans.adapters import CONTESTS_SQL, contest_table, stored
from tallyfield.registry import query
from tallyfield.registry.history import (
    CANDIDATE_FEATURES_SQL,
    FORM1_SQL,
    FORM2_SQL,
    H2H_SQL,
    NEUTRAL_SQL,
    PAIRS_SQL,
    VENUE_SQL,
    WINDOWS_SQL,
    candidates,
    training_table,
)

_fitted: dict[tuple[str, str, str], object] = {}


def _once(spark, folder, name, build):
    """Built once per application and folder; only models are kept, which are small."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _fitted:
        _fitted[key] = build()
    return _fitted[key]


def _cv_frame(spark, folder):
    def build():
        return models.in_time_order(training_table(spark, folder), "contest_date", "contest_id")

    return stored(spark, folder, "cv-frame", build)


def _folds_of_frame(spark, folder):
    return _once(spark, folder, "folds", lambda: models.time_folds(_cv_frame(spark, folder).count()))


def linear_models(spark, folder):
    """Logistic regressions on all rows and on every fold's training part."""
    return _once(spark, folder, "linear", lambda: models.fit_linear_parts(_cv_frame(spark, folder), _folds_of_frame(spark, folder)))


def tree_models(spark, folder):
    return _once(spark, folder, "trees", lambda: models.fit_tree_parts(_cv_frame(spark, folder), _folds_of_frame(spark, folder)))


def linear_model(spark, folder):
    return linear_models(spark, folder)[models.ALL_ROWS]


def tree_model(spark, folder):
    return tree_models(spark, folder)[models.ALL_ROWS]


def unfilled_questions(spark, folder):
    """Features of the candidates; a form without history stays missing."""
    return stored(spark, folder, "unfilled-questions", lambda: features.candidate_features(contest_table(spark, folder), candidates(spark, folder)))


def questions(spark, folder):
    return features.impute(unfilled_questions(spark, folder))


def _numbered(spark, folder):
    def build():
        keep = ["contest_id", "contest_date", "side1_won", "margin"]
        return models.in_time_order(contest_table(spark, folder).select(*keep), "contest_date", "contest_id")

    return stored(spark, folder, "numbered", build)


def _folds(spark, folder):
    numbered = _numbered(spark, folder)
    return models.fold_rows(numbered, models.time_folds(numbered.count()), ["contest_id", "side1_won", "margin"])


FOLDS_SQL = f"""WITH {CONTESTS_SQL}, numbered AS (
  SELECT contest_id, side1_won, margin, row_number() OVER (ORDER BY contest_date, contest_id) AS seq,
         count(*) OVER () AS n FROM contests),
folded AS (SELECT contest_id, side1_won, margin, seq, k + 1 AS fold, n - (5 - k) * (n // 6) AS train_rows, n // 6 AS size
  FROM numbered, (SELECT unnest(range(5)) AS k)),
fold_rows AS (SELECT contest_id, side1_won, margin, seq, fold, CASE WHEN seq <= train_rows THEN 'train' ELSE 'valid' END AS part
  FROM folded WHERE seq <= train_rows + size)"""


@query("m_time_folds", f"{FOLDS_SQL} SELECT contest_id, seq, fold, part FROM fold_rows")
def m_time_folds(spark, folder):
    return _folds(spark, folder).select("contest_id", "seq", "fold", "part")


@query(
    "m_standardise",
    f"""{FOLDS_SQL}, stats AS (SELECT fold, CAST(s AS DOUBLE) / n AS mean,
          sqrt(CAST(n * q - s * s AS DOUBLE) / CAST(n * n AS DOUBLE)) AS std FROM (
            SELECT fold, count(*) AS n, sum(margin) AS s, sum(margin * margin) AS q FROM fold_rows WHERE part = 'train' GROUP BY 1))
        SELECT contest_id, fold, part, (margin - mean) / std AS margin_scaled, CAST(0 AS DOUBLE) AS constant_scaled
        FROM fold_rows JOIN stats USING (fold)""",
)
def m_standardise(spark, folder):
    rows = _folds(spark, folder).withColumn("constant", F.lit(3))
    scaled = models.standardise_folds(rows, ["margin", "constant"])
    return scaled.select("contest_id", "fold", "part", "margin_scaled", "constant_scaled")


@query(
    "m_accuracy",
    f"""{FOLDS_SQL} SELECT fold, count(*) FILTER (CASE WHEN margin > 25 THEN 1 ELSE 0 END = side1_won) AS hits, count(*) AS rows,
          CAST(count(*) FILTER (CASE WHEN margin > 25 THEN 1 ELSE 0 END = side1_won) AS DOUBLE) / count(*) AS accuracy
        FROM fold_rows WHERE part = 'valid' AND side1_won IS NOT NULL GROUP BY 1""",
)
def m_accuracy(spark, folder):
    valid = _folds(spark, folder).where("part = 'valid' AND side1_won IS NOT NULL")
    guessed = valid.withColumn("prediction", F.when(F.col("margin") > 25, 1).otherwise(0))
    return models.accuracy(guessed, ["fold"])


WEIGHTS = {"side1_form": 0.5, "side2_form": -0.25, "head_to_head": 0.75, "venue_record": 0.125, "neutral_venue": -1.5}


@query(
    "m_linear_contrib",
    f"""WITH {CONTESTS_SQL}, {PAIRS_SQL}, featured AS (
          SELECT contest_id, {FORM1_SQL} AS side1_form, {FORM2_SQL} AS side2_form, {H2H_SQL} AS head_to_head,
                 {VENUE_SQL} AS venue_record, CAST({NEUTRAL_SQL} AS DOUBLE) AS neutral_venue, side1_won
          FROM paired WINDOW {WINDOWS_SQL})
        SELECT contest_id, {", ".join(f"CAST({w} AS DOUBLE) * {n} AS {n}_phi" for n, w in WEIGHTS.items())},
               CAST(0.1 AS DOUBLE) AS base
        FROM featured WHERE side1_won IS NOT NULL AND side1_form IS NOT NULL AND side2_form IS NOT NULL""",
)
def m_linear_contrib(spark, folder):
    return models.linear_contributions(training_table(spark, folder), WEIGHTS, 0.1, ["contest_id"])


@query(
    "m_top_drivers_fixed",
    f"""WITH {CONTESTS_SQL}, {PAIRS_SQL}, featured AS (
          SELECT contest_id, {FORM1_SQL} AS side1_form, {FORM2_SQL} AS side2_form, {H2H_SQL} AS head_to_head,
                 {VENUE_SQL} AS venue_record, CAST({NEUTRAL_SQL} AS DOUBLE) AS neutral_venue, side1_won
          FROM paired WINDOW {WINDOWS_SQL}),
        parts AS ({" UNION ALL ".join(
            f"SELECT contest_id, '{n}' AS feature, CAST({w} AS DOUBLE) * {n} AS contribution FROM featured "
            "WHERE side1_won IS NOT NULL AND side1_form IS NOT NULL AND side2_form IS NOT NULL" for n, w in WEIGHTS.items())})
        SELECT contest_id, feature, contribution FROM (
          SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY abs(contribution) DESC, feature) AS rank FROM parts)
        WHERE rank <= 2""",
)
def m_top_drivers_fixed(spark, folder):
    """The two features that move each prediction most, for fixed coefficients."""
    drivers = models.top_drivers(m_linear_contrib(spark, folder), ["contest_id"])
    return drivers.select("contest_id", "feature", "contribution")


# --- fitted models ---------------------------------------------------------------------------------------
#
# The comparison SQL fits the same models: Newton steps and boosting rounds are recursive queries. Sums of doubles depend on
# their order in the last digits, so the queries return fitted numbers to six places.


def six_places(value):
    return F.round(value * 1_000_000).cast("long") / F.lit(1_000_000.0)


SIX = "CAST(round(({}) * 1000000) AS BIGINT) / CAST(1000000 AS DOUBLE)"
_NAMES = list(features.FEATURES)
_SIZE = len(_NAMES) + 1

FRAME_SQL = f"""{CONTESTS_SQL}, {PAIRS_SQL}, featured AS (
  SELECT contest_id, contest_date, {FORM1_SQL} AS side1_form, {FORM2_SQL} AS side2_form, {H2H_SQL} AS head_to_head,
         {VENUE_SQL} AS venue_record, CAST({NEUTRAL_SQL} AS DOUBLE) AS neutral_venue, side1_won
  FROM paired WINDOW {WINDOWS_SQL}),
frame AS (SELECT *, row_number() OVER (ORDER BY contest_date, contest_id) AS seq, count(*) OVER () AS rows FROM featured
  WHERE side1_won IS NOT NULL AND side1_form IS NOT NULL AND side2_form IS NOT NULL),
all_uses AS (SELECT frame.*, k AS fold, CASE WHEN k = 0 OR seq <= rows - (6 - k) * (rows // 6) THEN 'train'
    WHEN seq <= rows - (5 - k) * (rows // 6) THEN 'valid' END AS part
  FROM frame, (SELECT unnest(range(6)) AS k))"""


def _eliminated() -> str:
    """Nested selects that solve the normal equations h * x = g of each fold by Gauss-Jordan steps."""
    names = [[f"h{i}_{j}" for j in range(_SIZE)] for i in range(_SIZE)]
    found = "sums"
    for k in range(_SIZE):
        columns = []
        for i in range(_SIZE):
            pivot = f"h{k}_{k}"
            for j, name in [*enumerate(names[i]), (None, f"g{i}")]:
                top = f"g{k}" if j is None else names[k][j]
                columns.append(f"{top} / {pivot} AS {name}" if i == k else f"{name} - h{i}_{k} * {top} / {pivot} AS {name}")
        found = f"(SELECT fold, {', '.join(columns)} FROM {found})"
    return found


def _newton_sql(steps: int = 15) -> str:
    """CTEs ``stats`` and ``weights(step, fold, w0, ...)``; needs WITH RECURSIVE."""
    stats = ", ".join(f"avg({n}) AS m{j}, CASE WHEN stddev_pop({n}) <= 1e-12 THEN 1.0 ELSE stddev_pop({n}) END AS d{j}" for j, n in enumerate(_NAMES))
    scaled = ", ".join(f"({n} - m{j}) / d{j} AS z{j}" for j, n in enumerate(_NAMES))
    margin = " + ".join(f"w{j} * z{j}" for j in range(_SIZE))
    ridge = lambda i, j: " + 1" if i == j < _SIZE - 1 else ""
    pull = lambda j: f" + any_value(w{j})" if j < _SIZE - 1 else ""
    products = [f"sum(p * (1 - p) * z{i} * z{j}){ridge(i, j)} AS h{i}_{j}" for i in range(_SIZE) for j in range(_SIZE)]
    sums = ", ".join([*[f"sum((p - side1_won) * z{j}){pull(j)} AS g{j}" for j in range(_SIZE)], *products])
    return f"""stats AS (SELECT fold, {stats} FROM all_uses WHERE part = 'train' GROUP BY fold),
scaled AS MATERIALIZED (SELECT fold, side1_won, {scaled}, CAST(1 AS DOUBLE) AS z{_SIZE - 1}
  FROM all_uses JOIN stats USING (fold) WHERE part = 'train'),
weights AS (
  SELECT 0 AS step, fold, {", ".join(f"CAST(0 AS DOUBLE) AS w{j}" for j in range(_SIZE))} FROM stats
  UNION ALL
  (WITH sums AS (SELECT fold, {sums} FROM (
      SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM scaled JOIN weights USING (fold)) GROUP BY fold)
  SELECT weights.step + 1, weights.fold, {", ".join(f"w{j} - g{j}" for j in range(_SIZE))}
  FROM weights JOIN {_eliminated()} solved USING (fold) WHERE weights.step < {steps})),
linear AS (SELECT * FROM weights JOIN stats USING (fold) WHERE step = {steps})"""


def _bins_sql(values: list[str]) -> str:
    """Bins of equal width as a list; null and negative values are missing."""
    bins = boosting.BINS
    return "[" + ", ".join(f"CASE WHEN {v} IS NULL OR {v} < 0 THEN -1 ELSE least(floor({v} * {bins}), {bins - 1})::INT END" for v in values) + "]"


def _boost_sql(cells: str, trees: int) -> str:
    """CTE ``boost`` over ``cells(fold, bins, n, positives)``: the margin of every cell after all trees; needs WITH RECURSIVE.

    A step is one level of one tree: derivatives per node, feature and bin, the best cut of each node, and the rows' way.
    Beside the cells it keeps a row for each node, marked by two numbers in place of the bins: step and place.
    """
    depth, rate, ridge, least = boosting.TREE_DEPTH, boosting.TREE_RATE, boosting.RIDGE, boosting.LEAST_WEIGHT
    width = len(_NAMES)
    nothing = ", ".join(f"CAST(NULL AS {kind})" for kind in ["INT"] * 3 + ["DOUBLE"] * 4)
    return f"""boost(step, fold, bins, n, positives, margin, place, f, cut, side, left_value, right_value, left_rows, right_rows)
    USING KEY (fold, bins) AS (
  SELECT 0, fold, bins, n, positives, CAST(0 AS DOUBLE), 0, {nothing} FROM {cells}
  UNION ALL
  (WITH spread AS (
    SELECT fold, place, unnest(range(1, {width + 1})) AS f, unnest(bins) AS bin, n, n / (1 + exp(-margin)) - positives AS g,
      n / (1 + exp(-margin)) * (1 - 1 / (1 + exp(-margin))) AS h FROM boost WHERE n > 0
  ), sums AS (SELECT fold, place, f, bin, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM spread GROUP BY ALL
  ), totals AS (
    SELECT *, sum(CASE WHEN bin >= 0 THEN n ELSE 0 END) OVER upto AS nl, sum(n) OVER whole AS nt,
      coalesce(sum(n) FILTER (bin < 0) OVER whole, 0) AS nm, sum(CASE WHEN bin >= 0 THEN g ELSE 0 END) OVER upto AS gl, sum(CASE WHEN bin >= 0 THEN h ELSE 0 END) OVER upto AS hl,
      sum(g) OVER whole AS gt, sum(h) OVER whole AS ht,
      coalesce(sum(g) FILTER (bin < 0) OVER whole, 0) AS gm, coalesce(sum(h) FILTER (bin < 0) OVER whole, 0) AS hm
    FROM sums WINDOW upto AS (PARTITION BY fold, place, f ORDER BY bin), whole AS (PARTITION BY fold, place, f)
  ), sided AS (
    SELECT fold, place, f, bin + 1 AS cut, side, gl + side * gm AS gl, hl + side * hm AS hl, nl + side * nm AS nl, gt, ht
    FROM totals, (SELECT unnest([0, 1]) AS side) WHERE bin >= 0
  ), gained AS (
    SELECT *, gl * gl / (hl + {ridge}) + (gt - gl) * (gt - gl) / (ht - hl + {ridge}) - gt * gt / (ht + {ridge}) AS gain
    FROM sided WHERE hl >= {least} AND ht - hl >= {least}
  ), ranked AS (SELECT *, max(gain) OVER (PARTITION BY fold, place) AS most FROM gained
  ), best AS (
    SELECT *, row_number() OVER (PARTITION BY fold, place ORDER BY f, cut, side) AS rank FROM ranked
    WHERE gain >= most * (1 - {boosting.SAME_GAIN!r}) AND most > {boosting.LEAST_GAIN!r}
  ), nodes AS (SELECT fold, place, any_value(gt) AS gt, any_value(ht) AS ht, any_value(nt) AS nt FROM totals WHERE f = 1 GROUP BY ALL
  ), split AS (
    SELECT nodes.fold, nodes.place, f, cut, side, coalesce(gl, nodes.gt) AS gl, coalesce(hl, nodes.ht) AS hl,
      nodes.gt - coalesce(gl, nodes.gt) AS gr, nodes.ht - coalesce(hl, nodes.ht) AS hr, coalesce(nl, nodes.nt) AS nl, nodes.nt
    FROM nodes LEFT JOIN best ON nodes.fold = best.fold AND nodes.place = best.place AND rank = 1
  ), moved AS (
    SELECT boost.step, boost.fold, bins, n, positives, margin, boost.place, gl, hl, gr, hr,
      CASE WHEN split.f IS NULL THEN true WHEN bins[split.f] < 0 THEN split.side = 1 ELSE bins[split.f] < split.cut END AS to_left
    FROM boost LEFT JOIN split ON boost.fold = split.fold AND boost.place = split.place WHERE len(bins) = {width})
  SELECT step + 1, fold, bins, n, positives, CASE WHEN (step + 1) % {depth} = 0 THEN margin
      - {rate} * coalesce(CASE WHEN to_left THEN gl / (hl + {ridge}) ELSE gr / (hr + {ridge}) END, 0) ELSE margin END,
    CASE WHEN (step + 1) % {depth} = 0 THEN 0 ELSE 2 * place + CASE WHEN to_left THEN 0 ELSE 1 END END,
    {nothing} FROM moved WHERE step < {trees * depth}
  UNION ALL
  SELECT step + 1, fold, [step, place], 0, 0, 0, 0, f, cut, side, -{rate} * gl / (hl + {ridge}), -{rate} * gr / (hr + {ridge}), nl, nt - nl
  FROM split, (SELECT max(step) AS step FROM boost) WHERE step < {trees * depth}))"""


_USED_BINS = f"SELECT *, {_bins_sql(_NAMES)} AS bins FROM all_uses"
CELLS_SQL = f"""binned AS MATERIALIZED ({_USED_BINS}),
cells AS (SELECT fold, bins, count(*) FILTER (part = 'train') AS n, coalesce(sum(side1_won) FILTER (part = 'train'), 0)::BIGINT AS positives
  FROM binned WHERE part IS NOT NULL GROUP BY ALL)"""
#: As above, but only the model of all rows.
ONE_FOLD_SQL = CELLS_SQL.replace("FROM all_uses", "FROM all_uses WHERE fold = 0")

LOGREG_SQL = f"""WITH RECURSIVE {FRAME_SQL}, {_newton_sql()}"""


@query(
    "m_logreg",
    f"{LOGREG_SQL} "
    + " UNION ALL ".join(f"SELECT '{n}' AS feature, {SIX.format(f'w{j}')} AS coefficient FROM linear WHERE fold = 0" for j, n in enumerate(_NAMES)),
)
def m_logreg(spark, folder):
    """Fitted coefficients."""
    table = models.coefficient_table(spark, linear_model(spark, folder)).where("feature IS NOT NULL")
    return table.select("feature", six_places(F.col("coefficient")).alias("coefficient"))


GBT_SQL = f"""WITH RECURSIVE {FRAME_SQL}, {ONE_FOLD_SQL}, {_boost_sql("cells", boosting.TREE_COUNT)},
predicted AS (SELECT contest_id, side1_won, CASE WHEN margin > 0 THEN 1 ELSE 0 END AS prediction FROM binned JOIN boost USING (fold, bins))"""


@query("m_gbt", f"{GBT_SQL} SELECT * FROM predicted")
def m_gbt(spark, folder):
    """Predictions of the boosted trees on the rows they were fitted on."""
    guess = (boosting.margin_of(tree_model(spark, folder)) > 0).cast("int")
    return training_table(spark, folder).select("contest_id", "side1_won", guess.alias("prediction"))


@query(
    "m_confusion",
    f"""{GBT_SQL} SELECT side1_won, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1
        FROM predicted GROUP BY 1""",
)
def m_confusion(spark, folder):
    """Confusion matrix of the boosted trees on the rows they were fitted on."""
    return aggregates.confusion_matrix(m_gbt(spark, folder), "side1_won", "prediction")


_LINEAR_MARGIN = " + ".join([*[f"w{j} * ({n} - m{j}) / d{j}" for j, n in enumerate(_NAMES)], f"w{_SIZE - 1}"])
SCORES_SQL = f"""{LOGREG_SQL}, {CELLS_SQL}, {_boost_sql("cells", boosting.TREE_COUNT)},
guesses AS (
  SELECT 'logistic' AS model, fold, side1_won, ({_LINEAR_MARGIN}) > 0 AS first FROM all_uses JOIN linear USING (fold) WHERE part = 'valid'
  UNION ALL SELECT 'trees', fold, side1_won, margin > 0 FROM binned JOIN boost USING (fold, bins) WHERE part = 'valid'),
scores AS (SELECT model, fold::INT AS fold, count(*) FILTER (first = (side1_won = 1)) AS hits, count(*) AS rows FROM guesses GROUP BY ALL)"""


def _fold_scores(spark, folder):
    def build():
        fitted = {models.LINEAR: linear_models(spark, folder), models.TREES: tree_models(spark, folder)}
        return models.fold_scores(_cv_frame(spark, folder), fitted, _folds_of_frame(spark, folder))

    return stored(spark, folder, "fold-scores", build)


@query("m_fold_scores", f"{SCORES_SQL} SELECT model, fold, hits, rows FROM scores")
def m_fold_scores(spark, folder):
    """Validation rows that each fold's models get right."""
    return _fold_scores(spark, folder).select("model", "fold", "hits", "rows")


@query(
    "m_select",
    f"""{SCORES_SQL}, summary AS (SELECT model, avg(hits / rows) AS cv_mean, stddev_pop(hits / rows) AS cv_std, count(*) AS folds FROM scores GROUP BY 1)
        SELECT model, {SIX.format("cv_mean")} AS cv_mean, {SIX.format("cv_std")} AS cv_std, folds,
          CASE WHEN row_number() OVER (ORDER BY cv_mean DESC, model) = 1 THEN 1 ELSE 0 END AS selected FROM summary""",
)
def m_select(spark, folder):
    """Cross-validated accuracy of both classifiers and the choice."""
    summary = models.summarise(_fold_scores(spark, folder))
    chosen = models.select_model(summary).select(F.col("model").alias("chosen"))
    joined = summary.join(F.broadcast(chosen), F.col("model") == F.col("chosen"), "left")  # one row of two
    return joined.select(
        "model", six_places(F.col("cv_mean")).alias("cv_mean"), six_places(F.col("cv_std")).alias("cv_std"), "folds",
        F.col("chosen").isNotNull().cast("int").alias("selected"),
    )


QUESTIONS_SQL = CANDIDATE_FEATURES_SQL.removeprefix("WITH ").split(PAIRS_SQL + ",", 1)[1]
_QUESTION_CTES, _QUESTION_SELECT = QUESTIONS_SQL.rsplit("SELECT candidate_id, c.side1", 1)
ASKED_SQL = f"{_QUESTION_CTES.rstrip()}, asked AS (SELECT candidate_id, c.side1{_QUESTION_SELECT})"


@query(
    "m_score",
    f"""WITH RECURSIVE {FRAME_SQL}, {ASKED_SQL}, {ONE_FOLD_SQL}, questions AS (SELECT *, {_bins_sql(_NAMES)} AS bins FROM asked),
        wanted AS (SELECT fold, bins, n, positives FROM cells UNION ALL
          SELECT DISTINCT 0, bins, 0, 0 FROM questions WHERE bins NOT IN (SELECT bins FROM cells)),
        {_boost_sql("wanted", boosting.TREE_COUNT)}
        SELECT candidate_id, side1, side2, side1_form < 0 OR side2_form < 0 AS form_missing,
          {SIX.format("1 / (1 + exp(-margin))")} AS side1_win, {SIX.format("1 - 1 / (1 + exp(-margin))")} AS side2_win
        FROM questions JOIN boost USING (bins)""",
)
def m_score(spark, folder):
    """Win probability of every candidate contest; a missing form takes the trees' branch for missing values."""
    missing = F.col("side1_form").isNull() | F.col("side2_form").isNull()
    asked = unfilled_questions(spark, folder).withColumn("form_missing", missing)
    scored = models.score(tree_model(spark, folder), asked, ["candidate_id", "side1", "side2", "form_missing"])
    return scored.withColumns({n: six_places(F.col(n)) for n in ("side1_win", "side2_win")})


NEWTON_TREES = 10
ALL_FEATURED_SQL = f"""{FRAME_SQL}, labelled AS (SELECT 0 AS fold, contest_id, side1_won, {_bins_sql(_NAMES)} AS bins FROM featured WHERE side1_won IS NOT NULL),
cells AS (SELECT fold, bins, count(*) AS n, sum(side1_won)::BIGINT AS positives FROM labelled GROUP BY ALL)"""


@query(
    "m_newton_trees",
    f"""WITH RECURSIVE {ALL_FEATURED_SQL}, {_boost_sql("cells", NEWTON_TREES)}
        SELECT contest_id, {SIX.format("margin")} AS margin FROM labelled JOIN boost USING (fold, bins)""",
)
def m_newton_trees(spark, folder):
    """Log-odds by trees that also learn from contests whose form is missing."""
    frame = stored(spark, folder, "featured", lambda: features.add_all_features(contest_table(spark, folder)))
    learnt = _once(
        spark, folder, "newton-trees",
        lambda: boosting.fit(frame, features.LABEL, boosting.even_cuts(_NAMES), {0: F.lit(True)}, NEWTON_TREES)[0],
    )
    return frame.where("side1_won IS NOT NULL").select("contest_id", six_places(boosting.margin_of(learnt)).alias("margin"))


def _nodes_sql() -> str:
    """All places of complete trees; those that no training row reaches are leaves of value 0, or inner nodes without a split."""
    depth = boosting.TREE_DEPTH
    names = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
    return f"""kept AS (SELECT bins[1] // {depth} AS tree, (1 << (bins[1] % {depth})) + bins[2] AS node, bins[1] % {depth} = {depth - 1} AS last, * FROM boost WHERE len(bins) = 2),
every AS (SELECT t::INT AS tree, n::INT AS node FROM (SELECT unnest(range({boosting.TREE_COUNT})) AS t), (SELECT unnest(range(1, {2 ** (depth + 1)})) AS n)),
found AS (
  SELECT tree, node, {names}[f] AS feature, CASE WHEN cut = {boosting.BINS} THEN 'inf'::DOUBLE ELSE cut / {boosting.BINS}::DOUBLE END AS threshold,
    CASE WHEN f IS NOT NULL THEN side = 1 END AS missing_left, NULL AS value, left_rows + right_rows AS rows FROM kept
  UNION ALL SELECT tree, 2 * node, NULL, NULL, NULL, left_value, left_rows FROM kept WHERE last
  UNION ALL SELECT tree, 2 * node + 1, NULL, NULL, NULL, right_value, right_rows FROM kept WHERE last)
SELECT tree, node, feature, threshold, missing_left, CASE WHEN node >= {2**depth} THEN {SIX.format("coalesce(value, 0)")} END AS value,
  coalesce(rows, 0)::BIGINT AS rows FROM every LEFT JOIN found USING (tree, node)"""


@query("m_model_nodes", f"WITH RECURSIVE {FRAME_SQL}, {ONE_FOLD_SQL}, {_boost_sql('cells', boosting.TREE_COUNT)}, {_nodes_sql()}")
def m_model_nodes(spark, folder):
    """The boosted trees as a table of nodes."""
    return boosting.node_table(spark, tree_model(spark, folder)).withColumn("value", six_places(F.col("value")))


def _explained_sql() -> str:
    """CTE ``explained(bins, feature, phi)`` and ``base`` from the nodes that ``boost`` kept.

    A leaf tests at most three features. With a_i for "follows the way at feature i" and r_i for the share of training rows
    that do, the worth of a set of known features is a product; features short of three are players that never matter.
    """
    depth, leaves = boosting.TREE_DEPTH, 2**boosting.TREE_DEPTH
    follows = "CASE WHEN f{i} IS NULL THEN 1 WHEN bins[f{i}] < 0 THEN missing{i}::INT ELSE (bins[f{i}] >= low{i} AND bins[f{i}] < high{i})::INT END AS a{i}"
    others = {1: (2, 3), 2: (1, 3), 3: (1, 2)}
    phi = " UNION ALL ".join(
        f"SELECT bins, f{i} AS f, value * (a{i} - r{i}) * (r{j} * r{k} / 3 + (a{j} * r{k} + r{j} * a{k}) / 6 + a{j} * a{k} / 3) AS part FROM met WHERE f{i} IS NOT NULL"
        for i, (j, k) in others.items()
    )
    return f"""nodes AS MATERIALIZED (SELECT bins[1] // {depth} AS tree, bins[1] % {depth} AS level, bins[2] AS place, f, cut, side, left_value, right_value,
    left_rows, right_rows FROM boost WHERE len(bins) = 2),
steps AS (SELECT tree, leaf, level, f, cut, side, (leaf >> ({depth - 1} - level)) & 1 AS way, left_rows, right_rows,
    CASE WHEN level = {depth - 1} THEN CASE WHEN leaf & 1 = 0 THEN left_value ELSE right_value END END AS value
  FROM nodes JOIN (SELECT unnest(range({leaves})) AS leaf) ON leaf >> ({depth} - level) = place),
reached AS (SELECT tree, leaf, max(value) AS value FROM steps GROUP BY ALL HAVING count(*) FILTER (f IS NULL AND way = 1) = 0),
tests AS (SELECT tree, leaf, f, coalesce(max(cut) FILTER (way = 1), -1) AS low, coalesce(min(cut) FILTER (way = 0), 1000) AS high,
    bool_and((side = 1) = (way = 0)) AS missing,
    product(CASE WHEN left_rows + right_rows = 0 THEN 0.5 WHEN way = 0 THEN left_rows / (left_rows + right_rows) ELSE right_rows / (left_rows + right_rows) END) AS r
  FROM steps WHERE f IS NOT NULL GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf ORDER BY f) AS i FROM tests),
leaves AS MATERIALIZED (SELECT tree, leaf, any_value(value) AS value, {", ".join(f"max({c}) FILTER (i = {i}) AS {c}{i}" for i in (1, 2, 3) for c in ("f", "low", "high"))},
    {", ".join(f"bool_and(missing) FILTER (i = {i}) AS missing{i}, coalesce(max(r) FILTER (i = {i}), 1) AS r{i}" for i in (1, 2, 3))}
  FROM reached LEFT JOIN numbered USING (tree, leaf) GROUP BY ALL),
met AS (SELECT bins, value, f1, f2, f3, r1, r2, r3, {", ".join(follows.format(i=i) for i in (1, 2, 3))}
  FROM (SELECT DISTINCT bins FROM questions), leaves),
explained AS (SELECT bins, {", ".join(f"coalesce(sum(part) FILTER (f = {j}), 0) AS {n}_phi" for j, n in enumerate(_NAMES, 1))} FROM ({phi}) GROUP BY bins),
based AS (SELECT sum(value * r1 * r2 * r3) AS base FROM leaves)"""


EXPLAINED_SQL = f"""WITH RECURSIVE {FRAME_SQL}, {ASKED_SQL}, {ONE_FOLD_SQL}, {_boost_sql("cells", boosting.TREE_COUNT)},
questions AS (SELECT *, {_bins_sql(_NAMES)} AS bins FROM asked), {_explained_sql()}"""


def _explained(spark, folder):
    return boosting.explain(tree_model(spark, folder), unfilled_questions(spark, folder), ["candidate_id"])


@query(
    "m_shapley",
    f"""{EXPLAINED_SQL} SELECT candidate_id, {", ".join(f"{SIX.format(f'{n}_phi')} AS {n}_phi" for n in _NAMES)}, {SIX.format("base")} AS base
        FROM questions JOIN explained USING (bins), based""",
)
def m_shapley(spark, folder):
    """What each feature adds to the log-odds of each candidate, unknown features following the training rows at their splits."""
    explained = _explained(spark, folder)
    return explained.select("candidate_id", *[six_places(F.col(c)).alias(c) for c in explained.columns[1:]])


def _fixed_model() -> boosting.Boosted:
    """Two trees by hand: (feature, threshold, missing left) of the inner nodes, and the leaves."""
    trees = [
        ([(0, 0.5, True), (2, 0.45, False), (1, 0.3, True), (3, 0.25, True), (0, 0.2, False), (2, 0.6, True), (1, 0.8, False)], [-0.5, -0.2, 0.1, 0.25, 0.05, 0.4, 0.3, -0.35]),
        ([(4, 0.5, True), (3, 0.5, True), (1, 0.45, False), (0, 0.7, True), (2, 0.5, True), (-1, 0.0, True), (1, 0.9, True)], [0.3, -0.1, 0.2, -0.45, 0.15, 0.0, -0.25, 0.35]),
    ]
    model = boosting.empty_model(_NAMES, len(trees), 3)
    for t, (inner, values) in enumerate(trees):
        for k, (feature, threshold, missing_left) in enumerate(inner):
            model.feature[t, k], model.threshold[t, k], model.missing_left[t, k] = feature, threshold, missing_left
        model.value[t], model.rows[t] = values, 1
    return model


FIXED = _fixed_model()


def _interventional_sql() -> str:
    """All 32 sets of known features, for every combination of split outcomes of a candidate and of a training row."""
    splits = [(t, k) for t, k in np.ndindex(FIXED.feature.shape) if FIXED.feature[t, k] >= 0]

    def outcome(t: int, k: int) -> str:
        name = _NAMES[FIXED.feature[t, k]]
        return f"CASE WHEN {name} IS NULL OR {name} < 0 THEN {bool(FIXED.missing_left[t, k])} ELSE {name} < {float(FIXED.threshold[t, k])!r} END"

    def value(t: int, node: int) -> str:
        inner = FIXED.feature.shape[1]
        if node >= inner:
            return f"CAST({float(FIXED.value[t, node - inner])!r} AS DOUBLE)"
        feature = FIXED.feature[t, node]
        if feature < 0:
            return value(t, 2 * node + 1)
        left = f"CASE WHEN (known >> {feature}) & 1 = 1 THEN own[{splits.index((t, node)) + 1}] ELSE other[{splits.index((t, node)) + 1}] END"
        return f"CASE WHEN {left} THEN {value(t, 2 * node + 1)} ELSE {value(t, 2 * node + 2)} END"

    outcomes = "[" + ", ".join(outcome(t, k) for t, k in splits) + "]"
    margin = " + ".join(value(t, 0) for t in range(len(FIXED.value)))
    size = len(_NAMES)
    weights = [factorial(k) * factorial(size - k - 1) / factorial(size) for k in range(size)]
    parts = ", ".join(
        f"sum(CASE WHEN (known >> {j}) & 1 = 1 THEN [{', '.join(map(repr, [0.0, *weights]))}][bit_count(known::INT) + 1] * worth "
        f"ELSE -[{', '.join(map(repr, [*weights, 0.0]))}][bit_count(known::INT) + 1] * worth END) AS {n}_phi"
        for j, n in enumerate(_NAMES)
    )
    return f"""outside AS (SELECT {outcomes} AS other, count(*) AS n FROM frame GROUP BY 1),
inside AS (SELECT *, {outcomes} AS own FROM asked),
worths AS (SELECT own, known, sum(n * ({margin})) / sum(n) AS worth FROM (SELECT DISTINCT own FROM inside), outside, (SELECT unnest(range(32)) AS known)
  GROUP BY own, known),
explained AS (SELECT own, {parts}, max(worth) FILTER (known = 0) AS base FROM worths GROUP BY own)"""


@query(
    "m_shapley_interventional",
    f"""WITH {FRAME_SQL}, {ASKED_SQL}, {_interventional_sql()}
        SELECT candidate_id, {", ".join(f"{SIX.format(c)} AS {c}" for c in [*[f"{n}_phi" for n in _NAMES], "base"])} FROM inside JOIN explained USING (own)""",
)
def m_shapley_interventional(spark, folder):
    """What each feature adds to the log-odds of a fixed model, unknown features taking the values of all training rows."""
    explained = boosting.explain_against(FIXED, unfilled_questions(spark, folder), training_table(spark, folder), ["candidate_id"])
    return explained.select("candidate_id", *[six_places(F.col(c)).alias(c) for c in explained.columns[1:]])


@query(
    "m_explain_linear",
    f"""{LOGREG_SQL}, {ASKED_SQL}, filled AS (SELECT * REPLACE (CASE WHEN side1_form < 0 THEN 0.5 ELSE side1_form END AS side1_form,
          CASE WHEN side2_form < 0 THEN 0.5 ELSE side2_form END AS side2_form) FROM asked)
        SELECT candidate_id, {", ".join(f"{SIX.format(f'w{j} * ({n} - m{j}) / d{j}')} AS {n}_phi" for j, n in enumerate(_NAMES))},
          {SIX.format(f"w{_SIZE - 1}")} AS base FROM filled, linear WHERE fold = 0""",
)
def m_explain_linear(spark, folder):
    trained = models.Trained(models.LINEAR, linear_model(spark, folder), None)
    explained = models.explain(trained, questions(spark, folder), ["candidate_id"])
    return explained.select("candidate_id", *[six_places(F.col(c)).alias(c) for c in explained.columns[1:]])


_LONG_SQL = " UNION ALL ".join(f"SELECT candidate_id, '{n}' AS feature, {n}_phi AS contribution FROM questions JOIN explained USING (bins)" for n in _NAMES)


@query("m_global_importance", f"{EXPLAINED_SQL} SELECT feature, {SIX.format('avg(abs(contribution))')} AS mean_abs FROM ({_LONG_SQL}) GROUP BY 1")
def m_global_importance(spark, folder):
    return models.global_importance(_explained(spark, folder)).withColumn("mean_abs", six_places(F.col("mean_abs")))


@query(
    "m_top_drivers",
    f"""{EXPLAINED_SQL} SELECT candidate_id, rank::INT AS rank, feature, {SIX.format("contribution")} AS contribution FROM (
          SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY abs(contribution) DESC, feature) AS rank FROM ({_LONG_SQL})) WHERE rank <= 2""",
)
def m_top_drivers(spark, folder):
    drivers = models.top_drivers(_explained(spark, folder), ["candidate_id"])
    return drivers.withColumn("contribution", six_places(F.col("contribution")))
