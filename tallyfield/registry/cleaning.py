"""Cleaning queries. The given tables are clean, so each query first spoils whole columns by an expression and then
cleans them; the comparison SQL starts from the unspoilt column wherever that is the right answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import outcomes, text
from tallyfield.operators import cleaning
from tallyfield.plans import records
from tallyfield.plans.adapters import CONTESTS_SQL, contests, table
from tallyfield.registry import query

SPOILT_NAME = """CASE c_mktsegment WHEN 'BUILDING' THEN concat(chr(160), c_name, ' ')
  WHEN 'HOUSEHOLD' THEN concat('  ', c_name, '†') WHEN 'MACHINERY' THEN concat(c_name, 'â€', chr(160)) ELSE c_name END"""

SPOILT_NUMBER = """CASE c_mktsegment WHEN 'BUILDING' THEN concat(' ', CAST(c_acctbal AS STRING), ' ')
  WHEN 'HOUSEHOLD' THEN '-' WHEN 'MACHINERY' THEN concat(CAST(c_acctbal AS STRING), 'd')
  WHEN 'FURNITURE' THEN 'inf' ELSE CAST(c_acctbal AS STRING) END"""

TRUE_NUMBER = "CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN c_acctbal END"

SPOILT_DATE = """CASE o_orderpriority WHEN '1-URGENT' THEN date_format(o_orderdate, 'MMM d, yyyy')
  WHEN '2-HIGH' THEN date_format(o_orderdate, 'dd-MM-yyyy') WHEN '3-MEDIUM' THEN date_format(o_orderdate, 'yyyy-MM-dd')
  WHEN '4-NOT SPECIFIED' THEN concat('on ', date_format(o_orderdate, 'yyyy-MM-dd')) END"""

TRUE_DATE = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  THEN strftime(o_orderdate, '%Y-%m-%d') END"""


@query("dedup_rows", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def dedup_rows(spark, folder):
    return cleaning.drop_repeats(table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"))


@query(
    "dedup_keep_first",
    """SELECT user_id, event_type, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
       WHERE rn = 1""",
)
def dedup_keep_first(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return cleaning.keep_first(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "strip_text",
    rf"""SELECT c_custkey, regexp_replace({SPOILT_NAME}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g') AS name
         FROM customer""",
)
def strip_text(spark, folder):
    spoilt = table(spark, folder, "customer").selectExpr("c_custkey", f"{SPOILT_NAME} AS name")
    return cleaning.strip_columns(spoilt, ["name", "not_there"])


@query("scrub_text", "SELECT c_custkey, c_name AS name FROM customer")
def scrub_text(spark, folder):
    spoilt = table(spark, folder, "customer").selectExpr("c_custkey", f"{SPOILT_NAME} AS name")
    return cleaning.strip_columns(cleaning.scrub_columns(spoilt, ["name"]), ["name"])


def _spoilt_numbers(spark, folder):
    return table(spark, folder, "customer").selectExpr("c_custkey", f"{SPOILT_NUMBER} AS amount")


@query("coerce_numeric", f"SELECT c_custkey, {TRUE_NUMBER} AS amount FROM customer")
def coerce_numeric(spark, folder):
    return cleaning.numeric_columns(_spoilt_numbers(spark, folder), ["amount"])


@query("fill_counts", f"SELECT c_custkey, coalesce({TRUE_NUMBER}, 0) AS amount FROM customer")
def fill_counts(spark, folder):
    return cleaning.fill_zero(cleaning.numeric_columns(_spoilt_numbers(spark, folder), ["amount"]), ["amount"])


@query("coerce_int", f"SELECT c_custkey, coalesce(CAST(trunc({TRUE_NUMBER}) AS BIGINT), 0) AS amount FROM customer")
def coerce_int(spark, folder):
    return cleaning.whole_columns(_spoilt_numbers(spark, folder), ["amount"])


@query("parse_dates", f"SELECT o_orderkey, {TRUE_DATE} AS iso FROM orders")
def parse_dates(spark, folder):
    spoilt = table(spark, folder, "orders").selectExpr("o_orderkey", f"{SPOILT_DATE} AS iso")
    return cleaning.map_columns(spoilt, ["iso"], records.iso_date)


@query(
    "normalise_category",
    "SELECT lower(o_orderpriority) AS category, count(*) AS orders FROM orders GROUP BY 1",
)
def normalise_category(spark, folder):
    spelling = "CASE o_orderstatus WHEN 'O' THEN concat(o_orderpriority, ' ') WHEN 'F' THEN lower(o_orderpriority)"
    spoilt = table(spark, folder, "orders").selectExpr(f"{spelling} ELSE concat(chr(160), o_orderpriority) END AS raw")
    return spoilt.groupBy(text.fold_category(F.col("raw")).alias("category")).agg(F.count(F.lit(1)).alias("orders"))


TOKENED = """CASE o_orderstatus WHEN 'O' THEN o_orderpriority WHEN 'F' THEN '' ELSE 'nan' END"""


@query("null_tokens", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN o_orderpriority END AS note FROM orders")
def null_tokens(spark, folder):
    spoilt = table(spark, folder, "orders").selectExpr("o_orderkey", f"{TOKENED} AS note")
    return cleaning.null_tokens(spoilt, ["note"])


@query("require_fields", "SELECT o_orderkey, o_orderpriority AS note FROM orders WHERE o_orderstatus = 'O'")
def require_fields(spark, folder):
    spoilt = table(spark, folder, "orders").selectExpr("o_orderkey", f"{TOKENED} AS note")
    return cleaning.require(cleaning.null_tokens(spoilt, ["note"]), ["o_orderkey", "note", "not_there"])


@query("rename_drop", "SELECT s_suppkey AS supplier_id, s_nationkey, s_acctbal FROM supplier")
def rename_drop(spark, folder):
    return cleaning.rename_and_drop(table(spark, folder, "supplier"), {"s_suppkey": "supplier_id"}, ["s_name"])


@query(
    "derive_flag",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'not_out' ELSE 'out' END AS flag, count(*) AS orders
       FROM orders GROUP BY 1""",
)
def derive_flag(spark, folder):
    dismissals = table(spark, folder, "orders").selectExpr(
        "CASE o_orderstatus WHEN 'F' THEN '' ELSE concat('c ', o_orderpriority) END AS dismissal"
    )
    flagged = cleaning.add_present_flag(dismissals, "dismissal", "flag", "out", "not_out")
    return flagged.groupBy("flag").agg(F.count(F.lit(1)).alias("orders"))


@query("filter_eq", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_eq(spark, folder):
    orders = table(spark, folder, "orders")
    return cleaning.equal_to(orders, "o_orderpriority", "1-URGENT").select("o_orderkey", "o_custkey")


@query(
    "filter_pair",
    f"""WITH {CONTESTS_SQL} SELECT contest_id, side1, side2, winner FROM contests
        WHERE (side1 = 'NATION_1' AND side2 = 'NATION_2') OR (side1 = 'NATION_2' AND side2 = 'NATION_1')""",
)
def filter_pair(spark, folder):
    pair = outcomes.same_pair(F.col("side1"), F.col("side2"), "NATION_1", "NATION_2")
    return contests(spark, folder).where(pair).select("contest_id", "side1", "side2", "winner")


@query(
    "filter_not_null",
    f"WITH {CONTESTS_SQL} SELECT contest_id, side1_won FROM contests WHERE side1_won IS NOT NULL",
)
def filter_not_null(spark, folder):
    return contests(spark, folder).where(F.col("side1_won").isNotNull()).select("contest_id", "side1_won")


@query(
    "outcome_label",
    f"""WITH {CONTESTS_SQL} SELECT side1, CASE WHEN winner = side1 THEN 1 WHEN winner = side2 THEN 0 ELSE -1 END AS label,
        count(*) AS contests FROM contests GROUP BY 1, 2""",
)
def outcome_label(spark, folder):
    label = outcomes.outcome_label(F.col("winner"), F.col("side1"), F.col("side2"))
    grouped = contests(spark, folder).groupBy("side1", F.coalesce(label, F.lit(-1)).alias("label"))
    return grouped.agg(F.count(F.lit(1)).alias("contests"))


@query(
    "winner_name",
    f"""WITH {CONTESTS_SQL} SELECT contest_id,
        CASE WHEN winner = side1 THEN side1 WHEN winner = side2 THEN side2 ELSE 'No Result' END AS winner FROM contests""",
)
def winner_name(spark, folder):
    name = outcomes.winner_name(F.col("winner"), F.col("side1"), F.col("side2"), F.col("side1"), F.col("side2"))
    return contests(spark, folder).select("contest_id", name.alias("winner"))


@query(
    "neutral_flag",
    f"""WITH {CONTESTS_SQL} SELECT contest_id,
        CASE WHEN contains(lower(venue), lower(side1)) OR contains(lower(venue), lower(side2)) THEN 0 ELSE 1 END
          AS neutral FROM contests""",
)
def neutral_flag(spark, folder):
    flag = outcomes.neutral_flag(F.col("venue"), F.col("side1"), F.col("side2"))
    return contests(spark, folder).select("contest_id", flag.alias("neutral"))


@query("distinct_values", f"WITH {CONTESTS_SQL} SELECT DISTINCT venue FROM contests ORDER BY venue")
def distinct_values(spark, folder):
    return cleaning.distinct_values(contests(spark, folder), "venue")


def raw_batting(spark, folder):
    """Line items as untidy batting records; lines flagged A arrive twice."""
    return table(spark, folder, "lineitem").selectExpr(
        "concat('Order ', l_orderkey) AS match",
        "CASE l_linestatus WHEN 'O' THEN concat('Side ', l_suppkey, ' ') ELSE concat(chr(160), 'Side ', l_suppkey) END"
        " AS teamInnings",
        "CASE l_linenumber WHEN 7 THEN '-' ELSE concat(l_linenumber, '.0') END AS battingPos",
        "CASE WHEN l_returnflag = 'A' THEN concat('Player ', l_partkey, '†')"
        " WHEN l_returnflag = 'R' OR l_linestatus = 'F' THEN concat('Player ', l_partkey, ' ') END AS batsmanName",
        "CASE l_linestatus WHEN 'O' THEN ' Not Out' ELSE 'c Keeper b Bowler ' END AS dismissal",
        "CASE l_linenumber WHEN 1 THEN '-' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS runs",
        "CASE l_linenumber WHEN 2 THEN '' ELSE CAST(l_partkey AS STRING) END AS balls",
        "CAST(l_linenumber AS STRING) AS `4s`",
        "CAST(NULL AS STRING) AS `6s`",
        "CASE l_linenumber WHEN 1 THEN '-' ELSE CAST(l_extendedprice AS STRING) END AS SR",
        "explode(CASE l_returnflag WHEN 'A' THEN array(0, 0) ELSE array(0) END) AS copy",
    ).drop("copy")


@query(
    "clean_batting",
    """SELECT concat('Order ', l_orderkey) AS match, concat('Side ', l_suppkey) AS "teamInnings",
         CASE l_linenumber WHEN 7 THEN 0 ELSE l_linenumber END AS "battingPos",
         concat('Player ', l_partkey) AS "batsmanName",
         CASE l_linestatus WHEN 'O' THEN 'not out' ELSE 'c keeper b bowler' END AS dismissal,
         CASE l_linenumber WHEN 1 THEN 0 ELSE l_quantity END AS runs,
         CASE l_linenumber WHEN 2 THEN 0 ELSE CAST(l_partkey AS DOUBLE) END AS balls,
         CAST(l_linenumber AS DOUBLE) AS "4s", CAST(0 AS DOUBLE) AS "6s",
         CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS "SR"
       FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber, l_partkey, l_linestatus,
               CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS spelling,
               CASE l_linenumber WHEN 1 THEN 0 ELSE l_quantity END AS l_quantity,
               CASE l_linenumber WHEN 1 THEN 0 ELSE l_extendedprice END AS l_extendedprice
             FROM lineitem WHERE l_returnflag IN ('A', 'R') OR l_linestatus = 'F')""",
)
def clean_batting(spark, folder):
    return records.clean_batting(raw_batting(spark, folder))


@query(
    "clean_bowling",
    """SELECT concat('Order ', l_orderkey) AS match, concat('Side ', l_suppkey) AS "bowlingTeam",
         concat('Player ', l_partkey) AS "bowlerName", l_quantity AS overs, CAST(l_linenumber AS DOUBLE) AS runs,
         CASE WHEN l_linestatus = 'F' THEN l_extendedprice END AS economy
       FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey, l_quantity, l_linenumber, l_linestatus,
               CASE l_linestatus WHEN 'F' THEN l_extendedprice END AS l_extendedprice FROM lineitem)""",
)
def clean_bowling(spark, folder):
    raw = table(spark, folder, "lineitem").selectExpr(
        "concat('Order ', l_orderkey, chr(160)) AS match",
        "concat(' Side ', l_suppkey) AS bowlingTeam",
        "concat('Player ', l_partkey, '†') AS bowlerName",
        "CAST(l_quantity AS STRING) AS overs",
        "concat(' ', l_linenumber) AS runs",
        "CASE l_linestatus WHEN 'F' THEN CAST(l_extendedprice AS STRING) ELSE '-' END AS economy",
    )
    return records.clean_bowling(raw)


@query(
    "clean_players",
    """SELECT c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN NULL ELSE c_mktsegment END AS team,
         1 AS ingest_seq FROM customer
       UNION ALL SELECT c_name, 'later', 2 FROM customer""",
)
def clean_players(spark, folder):
    """First record per player and team: the later records name another team, and of those the first stays too."""
    raw = table(spark, folder, "customer").selectExpr(
        f"{SPOILT_NAME} AS name",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'nan' ELSE concat(c_mktsegment, ' ') END AS team",
        "explode(array(2, 1, 3)) AS ingest_seq",
    )
    again = F.when(F.col("ingest_seq") > 1, F.lit("later")).otherwise(F.col("team"))
    return records.clean_players(raw.withColumn("team", again), ["ingest_seq"])


@query(
    "clean_matches",
    """SELECT concat('M # ', o_orderkey) AS match_id, concat('Side ', o_custkey) AS team1, o_orderpriority AS team2,
         CASE o_orderstatus WHEN 'O' THEN '5 runs' END AS margin, strftime(o_orderdate, '%Y-%m-%d') AS "matchDate"
       FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
)
def clean_matches(spark, folder):
    raw = table(spark, folder, "orders").selectExpr(
        "concat('M # ', o_orderkey) AS match_id",
        "concat(' Side ', o_custkey) AS team1",
        "concat(o_orderpriority, chr(160)) AS team2",
        "CASE o_orderstatus WHEN 'O' THEN '5 runs ' WHEN 'F' THEN 'nan' ELSE ' ' END AS margin",
        f"{SPOILT_DATE} AS matchDate",
    )
    return records.clean_matches(raw)
