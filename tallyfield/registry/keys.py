"""Conformed load and key queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import numbers
from tallyfield.operators import cleaning, keys
from tallyfield.plans import records, reports
from tallyfield.plans.adapters import CONTESTS_SQL, contest_table, contests, table
from tallyfield.registry import query
from tallyfield.registry.cleaning import SPOILT_DATE
from tallyfield.registry.reports import WIN_RATE_SQL
from tallyfield.session import fresh_path
from tallyfield.sources import catalogue


@query(
    "entity_dim",
    """SELECT DISTINCT unnest([c_mktsegment, c_name]) AS entity FROM customer""",
)
def entity_dim(spark, folder):
    padded = table(spark, folder, "customer").selectExpr(
        "concat(c_mktsegment, chr(160)) AS one", "concat(' ', c_name) AS two", "' ' AS three"
    )
    return keys.entity_names(padded, ["one", "two", "three"], "entity")


@query("surrogate_keys", "SELECT row_number() OVER (ORDER BY md5(c_name), c_name) AS entity_id, c_name FROM customer")
def surrogate_keys(spark, folder):
    names = table(spark, folder, "customer").select("c_name").distinct()
    return keys.number_names(names, "c_name", "entity_id").select("entity_id", "c_name")


@query(
    "extend_dimension",
    """WITH known AS (SELECT s_name AS name, row_number() OVER (ORDER BY md5(s_name), s_name) AS id FROM supplier),
       new AS (SELECT c_name AS name, row_number() OVER (ORDER BY md5(c_name), c_name) + (SELECT max(id) FROM known) AS id
               FROM customer)
       SELECT id, name FROM known UNION ALL SELECT id, name FROM new""",
)
def extend_dimension(spark, folder):
    suppliers = table(spark, folder, "supplier").select(F.col("s_name").alias("name"))
    customers = table(spark, folder, "customer").select(F.col("c_name").alias("name"))
    known = keys.number_names(suppliers.distinct(), "name", "id").select("id", "name")
    return keys.extend_dimension(known, customers.unionByName(suppliers), "name", "id")


def _existing(spark, folder):
    return table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("key"), F.lit("old").alias("payload"), F.lit(0).cast("long").alias("ingest_seq")
    )


def _incoming(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("payload"), F.col("o_orderkey").alias("ingest_seq")
    )


@query(
    "upsert_ignore",
    """SELECT c_custkey AS key, 'old' AS payload, 0 AS ingest_seq FROM customer WHERE c_mktsegment = 'BUILDING'
       UNION ALL SELECT key, payload, ingest_seq FROM (
         SELECT o_custkey AS key, o_orderpriority AS payload, o_orderkey AS ingest_seq,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders
         WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) WHERE rn = 1""",
)
def upsert_ignore(spark, folder):
    return keys.insert_or_ignore(_existing(spark, folder), _incoming(spark, folder), ["key"], ["ingest_seq"])


@query(
    "upsert_replace",
    """SELECT key, payload, ingest_seq FROM (
         SELECT *, row_number() OVER (PARTITION BY key ORDER BY wave DESC, ingest_seq DESC) AS rn FROM (
           SELECT c_custkey AS key, 'old' AS payload, 0 AS ingest_seq, 0 AS wave FROM customer
           WHERE c_mktsegment = 'BUILDING'
           UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey, 1 FROM orders)) WHERE rn = 1""",
)
def upsert_replace(spark, folder):
    return keys.insert_or_replace(_existing(spark, folder), _incoming(spark, folder), ["key"], ["ingest_seq"])


@query(
    "lookup_keys",
    f"""WITH {CONTESTS_SQL} SELECT contest_id, coalesce(n_nationkey, -1) AS winner_key
        FROM contests LEFT JOIN nation ON winner = n_name""",
)
def lookup_keys(spark, folder):
    nation = table(spark, folder, "nation")
    found = keys.lookup_key(contests(spark, folder), nation, {"winner": "n_name"}, "n_nationkey", "winner_key")
    return found.select("contest_id", F.coalesce("winner_key", F.lit(-1)).alias("winner_key"))


@query(
    "pair_key_bridge",
    f"""WITH {CONTESTS_SQL}, last AS (
          SELECT least(side1, side2) AS low, greatest(side1, side2) AS high,
                 arg_max(contest_id, (contest_date, contest_id)) AS contest_id FROM contests GROUP BY 1, 2)
        SELECT concat(low, ' Vs ', high) AS pair_text, contest_id FROM last
        UNION ALL SELECT concat(high, ' Vs ', low), contest_id FROM last""",
)
def pair_key_bridge(spark, folder):
    return keys.pair_key_bridge(contests(spark, folder), "side1", "side2", "contest_id", ["contest_date"])


@query(
    "match_key_lookup",
    f"""WITH {CONTESTS_SQL}, last AS (
          SELECT least(side1, side2) AS low, greatest(side1, side2) AS high,
                 arg_max(contest_id, (contest_date, contest_id)) AS match_id FROM contests GROUP BY 1, 2)
        SELECT c.contest_id, concat(side2, ' Vs ', side1) AS match, match_id FROM contests c
        JOIN last ON least(side1, side2) = low AND greatest(side1, side2) = high""",
)
def match_key_lookup(spark, folder):
    """Score records that name their contest by text only get its key."""
    games = contest_table(spark, folder)
    bridge = keys.pair_key_bridge(games, "side1", "side2", "contest_id", ["contest_date"])
    scores = games.select("contest_id", F.concat_ws(" Vs ", "side2", "side1").alias("match"))
    return records.add_match_key(scores, bridge.withColumnRenamed("contest_id", "match_id"))


@query(
    "fk_violations",
    """SELECT user_id AS s_suppkey, count(*) AS rows FROM events
       WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
)
def fk_violations(spark, folder):
    return keys.missing_parents(
        table(spark, folder, "events"), "user_id", table(spark, folder, "supplier"), "s_suppkey"
    )


@query(
    "unique_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def unique_violations(spark, folder):
    return keys.repeated_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "null_violations",
    f"""WITH {CONTESTS_SQL} SELECT 'side1_won' AS column_name, count(*) FILTER (side1_won IS NULL) AS nulls FROM contests
        UNION ALL SELECT 'side1', count(*) FILTER (side1 IS NULL) FROM contests""",
)
def null_violations(spark, folder):
    return keys.missing_values(contests(spark, folder), ["side1_won", "side1"])


@query(
    "ambiguous_names",
    "SELECT p_name, p_brand, count(p_partkey) AS keys FROM part GROUP BY 1, 2 HAVING count(p_partkey) > 1",
)
def ambiguous_names(spark, folder):
    return keys.ambiguous_names(table(spark, folder, "part"), ["p_name", "p_brand"], "p_partkey")


@query(
    "step_counts",
    """SELECT 'read' AS step, count(*) AS rows FROM orders
       UNION ALL SELECT 'dated', count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
       UNION ALL SELECT 'first_per_customer', count(DISTINCT o_custkey) FROM orders
         WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
)
def step_counts(spark, folder):
    raw = table(spark, folder, "orders").selectExpr("o_orderkey", "o_custkey", f"{SPOILT_DATE} AS day")
    watched = []

    def watch(df, step):
        seen, observation = keys.count_rows(df, step)
        watched.append((step, observation))
        return seen

    df = watch(raw, "read")
    df = watch(cleaning.require(cleaning.map_columns(df, ["day"], numbers.iso_date), ["day"]), "dated")
    df = watch(cleaning.keep_first(df, ["o_custkey"], ["day", "o_orderkey"]), "first_per_customer")
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(step, seen.get["rows"]) for step, seen in watched], "step string, rows long")


_stars: dict[tuple[str, str], dict] = {}


def star(spark, folder):
    """The five tables of the star schema, written once per application and folder.

    A supplier's line is a batting record of its nation and a bowling record of a side nobody has heard of.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key in _stars:
        return _stars[key]
    games = contest_table(spark, folder).select(
        F.col("contest_id").cast("string").alias("match_id"), F.col("side1").alias("team1"), F.col("side2").alias("team2"),
        "winner", F.col("margin").cast("string").alias("margin"), F.col("venue").alias("ground"),
        F.col("contest_date").cast("string").alias("matchDate"),
    )
    nation = table(spark, folder, "nation")
    supplier = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    players = supplier.select(F.col("s_name").alias("name"), F.col("n_name").alias("team"))
    lines = table(spark, folder, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    batting = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("match_id"),
        F.col("n_name").alias("teamInnings"), F.col("s_name").alias("batsmanName"),
        F.col("l_linenumber").alias("battingPos"), F.col("l_quantity").alias("runs"),
    )
    bowling = batting.select(
        "match_id", F.concat(F.lit("Other "), "teamInnings").alias("bowlingTeam"),
        F.col("batsmanName").alias("bowlerName"), "runs",
    )
    _stars[key] = records.load_star_schema(
        spark, fresh_path(spark, "star"), games, players, batting, bowling, ["matchDate"], ["name"]
    )
    return _stars[key]


@query(
    "load_star_schema",
    f"""WITH {CONTESTS_SQL}, played AS (
          SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT 'teams' AS table_name, count(*) AS rows, 0 AS unresolved FROM
          (SELECT side1 FROM contests UNION SELECT side2 FROM contests)
        UNION ALL SELECT 'matches', count(*), count(*) FILTER (winner = 'no result') FROM contests
        UNION ALL SELECT 'players', count(*), count(*) FILTER (n_name NOT IN
          (SELECT side1 FROM contests UNION SELECT side2 FROM contests)) FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'batting', count(*), 0 FROM lineitem
        UNION ALL SELECT 'bowling', count(*), 0 FROM lineitem""",
)
def load_star_schema(spark, folder):
    """Rows and unresolved names of each of the five written tables."""
    loaded = star(spark, folder)
    unresolved = {
        "teams": "team_id", "matches": "winner_id", "players": "team_id", "batting": "batsman_id", "bowling": "bowler_id",
    }
    parts = [
        loaded[name].agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("unresolved"))
        .select(F.lit(name).alias("table_name"), "rows", "unresolved")
        for name, key in unresolved.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


_KNOWN = "(SELECT side1 FROM contests UNION SELECT side2 FROM contests)"
_SCORES_SQL = """FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""


@query("star_win_pct", f"WITH {CONTESTS_SQL} {WIN_RATE_SQL}")
def star_win_pct(spark, folder):
    """Win percentages from the written tables."""
    loaded = star(spark, folder)
    return reports.win_rates(records.contests_from_star(loaded["matches"], loaded["teams"]))


@query(
    "star_players",
    f"""WITH {CONTESTS_SQL} SELECT s_name AS name, CASE WHEN n_name IN {_KNOWN} THEN n_name END AS team
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def star_players(spark, folder):
    loaded = star(spark, folder)
    teams = loaded["teams"].select("team_id", F.col("team_name").alias("team"))
    return loaded["players"].join(teams, "team_id", "left").select("name", "team")


def _scores(spark, folder, facts, player_id, team_id):
    loaded = star(spark, folder)
    return records.performances_from_star(loaded[facts], loaded["matches"], loaded["players"], loaded["teams"], player_id, team_id)


@query(
    "star_batting",
    f"""WITH {CONTESTS_SQL} SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS match_id, s_name AS player,
          CASE WHEN n_name IN {_KNOWN} THEN n_name END AS team, CAST(l_linenumber AS BIGINT) AS batting_pos,
          CAST(l_quantity AS BIGINT) AS runs {_SCORES_SQL}""",
)
def star_batting(spark, folder):
    scores = _scores(spark, folder, "batting", "batsman_id", "team_innings_id")
    return scores.select("match_id", "player", "team", "batting_pos", "runs")


@query(
    "star_bowling",
    f"""SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS match_id, s_name AS player,
          CAST(l_quantity AS BIGINT) AS runs {_SCORES_SQL}""",
)
def star_bowling(spark, folder):
    """The side is unknown, so every bowler is found by a name that only one player has."""
    return _scores(spark, folder, "bowling", "bowler_id", "bowling_team_id").select("match_id", "player", "runs")


@query(
    "star_top5_by_venue",
    f"""WITH {CONTESTS_SQL}, totals AS (
          SELECT venue, s_name AS player, n_name AS team, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) AS innings
          {_SCORES_SQL} JOIN contests ON contest_id = l_orderkey * 10 + l_linenumber GROUP BY 1, 2, 3)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY total DESC, player, team) AS rank FROM totals)
        WHERE rank <= 5""",
)
def star_top5_by_venue(spark, folder):
    scores = _scores(spark, folder, "batting", "batsman_id", "team_innings_id").where("venue IS NOT NULL")
    return reports.top_scorers_by_venue(scores, "venue", ["player", "team"], "runs")


_catalogues: dict[tuple[str, str], str] = {}


def catalogue_star(spark, folder) -> str:
    """Database that holds the star tables, contests and score rows in buckets."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _catalogues:
        name = f"star_{len(_catalogues)}"
        tables = star(spark, folder)
        catalogue.store_star(spark, name, fresh_path(spark, name), tables, catalogue.bucket_count(tables, least=8))
        _catalogues[key] = name
    return _catalogues[key]


@query(
    "list_tables",
    f"""WITH {CONTESTS_SQL} SELECT 'batting' AS table_name, 'match_id' AS bucketed_by, count(*) AS rows FROM lineitem
        UNION ALL SELECT 'bowling', 'match_id', count(*) FROM lineitem UNION ALL SELECT 'matches', 'match_id', count(*) FROM contests
        UNION ALL SELECT 'players', '', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'teams', '', count(*) FROM (SELECT side1 FROM contests UNION SELECT side2 FROM contests)""",
)
def list_tables(spark, folder):
    """Tables of the catalogue with what they are bucketed by and their rows."""
    database = catalogue_star(spark, folder)
    parts = [
        spark.table(f"{database}.{name}").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(name).alias("table_name"), F.lit(columns).alias("bucketed_by"), "rows")
        for name, columns in catalogue.describe(spark, database)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "bucketed_join",
    f"""WITH {CONTESTS_SQL} SELECT CAST(contest_id AS VARCHAR) AS match_id, venue AS ground, count(l_quantity) AS scores,
          CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS runs
        FROM contests JOIN lineitem ON contest_id = l_orderkey * 10 + l_linenumber GROUP BY 1, 2""",
)
def bucketed_join(spark, folder):
    """Runs of every contest: neither the join nor the sums move a row."""
    database = catalogue_star(spark, folder)
    matches = spark.table(f"{database}.matches").select("match_id", "ground")
    scores = spark.table(f"{database}.batting").select("match_id", "runs")
    both = matches.join(scores.hint("merge"), "match_id")
    return both.groupBy("match_id", "ground").agg(F.count("runs").alias("scores"), F.sum("runs").alias("runs"))
