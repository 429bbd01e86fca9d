"""Queries of pages read as element trees. Pages are rendered from the given tables, several batters an innings, with
tables inside cells, cells left open, rarer character references and side names without the word for an innings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyfield.plans.adapters import stored, table
from tallyfield.registry import query
from tallyfield.sources import elements

SITE = "https://site.example"
PARTS_A_CORE = 4
PAGES_AT_ONCE, PAGES_A_TASK = 1024, 50_000

_BATTER = (
    '<tr><td><a href="/player/%s"><span><span>Andr&eacute; O&#8217;Brien&nbsp;%s</span></span></a></td><td><span><span>b %s<table><tbody>'
    "<tr><td>x</td><td>y</td></tr></tbody></table></span></span><td><strong>%s</strong><td>%s</td><td>-</td><td>4</td><td>6</td><td>%s.5</td></tr>"
)
_BOWLER = '<tr><td><a href="/player/%s"><span>P&ouml;&#x142; %s</span></a></td>' + "".join(f"<td>{i}</td>" for i in range(10)) + "</tr>"
_INNINGS = (
    '<div><span><span>%s</span></span><div><table class="wide ds-table ci-scorecard-table"><thead><tr><th>Batting</th></tr></thead><tbody>'
    '%s<tr><td>Extras</td><td>9</td></tr></tbody></table></div><div><table class="ds-table"><tbody>%s</tbody></table></div></div>'
)
_PAGE = "<html><body><section><div><span><span>%s</span></span></div></li>" + _INNINGS + _INNINGS + "</section></body></html>"


def rendered(template, *values):
    """The template with each value in the place of a ``%s``; a missing one is written as null, as by a formatter."""
    first, *others = template.split("%s")
    pieces = [F.lit(first)]
    for value, text in zip(values, others, strict=True):
        pieces += [F.coalesce(value.cast("string"), F.lit("null")), F.lit(text)]
    return F.concat(*pieces)


def _dealt(spark, folder, name, key):
    """The table dealt out by order to tasks of ``PAGES_A_TASK`` pages; the shuffled numbers are small, so Spark would make a few tasks of them."""
    tasks = max(PARTS_A_CORE * spark.sparkContext.defaultParallelism, -(-table(spark, folder, "orders").count() // PAGES_A_TASK))
    return table(spark, folder, name).withColumnRenamed(key, "o_orderkey").repartition(tasks, "o_orderkey")


def _sheets(spark, folder):
    """The lines of each order, a handful, as numbers; markup is made after they were shuffled."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lines = _dealt(spark, folder, "lineitem", "l_orderkey").groupBy("o_orderkey")
    return lines.agg(F.sort_array(F.collect_list(line)).alias("lines"))


def _page_of(heading, first, second, lines):
    """Pages as Arrow text, from their headings and sides and from the lists of their lines; all of them in one pass a piece."""
    starts, lines = lines.offsets.to_numpy(), lines.values.slice(lines.offsets[0].as_py(), lines.offsets[-1].as_py() - lines.offsets[0].as_py())
    number, part, supplier = (lines.field(n) for n in range(3))
    odd = np.fmod(number.fill_null(-1).to_numpy(), 2)
    written = [written_out(_BATTER, part, part, supplier, part, number, part), written_out(_BOWLER, supplier, supplier)]

    def joined(remainder):
        chosen = odd == remainder
        bounds = np.concatenate([[0], np.cumsum(chosen)])[starts - starts[0]]
        mine = [fragments.filter(pa.array(chosen)) for fragments in written]
        return [pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), fragments), "") for fragments in mine]

    return written_out(_PAGE, heading, first, *joined(1), second, *joined(0))


def written_out(template, *values):
    """As ``rendered``, for Arrow arrays."""
    first, *others = template.split("%s")
    pieces = [first]
    for value, text in zip(values, others, strict=True):
        pieces += [value.cast(pa.string()).fill_null("null"), text]
    return pc.binary_join_element_wise(*pieces, "")


def score_pages(spark, folder):
    """A page per order; its odd lines bat first, its even ones second. Orders of the lowest priority lack the heading."""

    def build():
        heading = F.when(F.col("o_orderpriority") == "5-LOW", "Overview").otherwise("Match Details")
        sides = [F.concat(F.lit("Side "), F.col("o_custkey").cast("string")), F.concat("o_orderpriority", F.lit(" Innings"))]
        orders = _dealt(spark, folder, "orders", "o_orderkey").join(_sheets(spark, folder), "o_orderkey")
        orders = orders.select("o_orderkey", heading.alias("heading"), sides[0].alias("first"), sides[1].alias("second"), "lines")

        def write(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                    key, *parts = batch.slice(start, PAGES_AT_ONCE).columns
                    yield pa.RecordBatch.from_arrays([key, _page_of(*parts)], names=["o_orderkey", "html"])

        target = StructType([orders.schema["o_orderkey"], StructField("html", StringType())])
        return orders.mapInArrow(write, target)

    return stored(spark, folder, "tree-pages", build)


_LINES = """WITH good AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'), placed AS (
         SELECT o_orderkey, concat('Side ', o_custkey) AS side1, o_orderpriority AS side2, l_linenumber, l_partkey, l_suppkey,
           l_linenumber % 2 = 1 AS odd, count(*) FILTER (l_linenumber % 2 = 1) OVER (PARTITION BY o_orderkey) AS odds,
           row_number() OVER (PARTITION BY o_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) AS place
         FROM good JOIN lineitem ON o_orderkey = l_orderkey),
       lines AS (SELECT *, place - 1 + CASE WHEN odd THEN 0 ELSE odds END AS seq FROM placed)"""


@query(
    "tree_batting_rows",
    f"""{_LINES} SELECT o_orderkey, seq AS ingest_seq, concat(side1, ' Vs ', side2) AS match, CASE WHEN odd THEN side1 ELSE side2 END AS "teamInnings",
         CAST(place AS VARCHAR) AS "battingPos", concat('André O’Brien', l_partkey) AS "batsmanName", concat('b ', l_suppkey, 'xy') AS dismissal,
         CAST(l_partkey AS VARCHAR) AS runs, CAST(l_linenumber AS VARCHAR) AS balls, '4' AS "4s", '6' AS "6s", concat(l_partkey, '.5') AS "SR"
       FROM lines""",
)
def tree_batting_rows(spark, folder):
    records = elements.batting_records(score_pages(spark, folder), "html", ["o_orderkey"])
    return records.where("parse_error IS NULL").drop("parse_error")


@query(
    "tree_bowling_rows",
    f"""{_LINES} SELECT o_orderkey, seq AS ingest_seq, concat(side1, ' Vs ', side2) AS match, CASE WHEN odd THEN side2 ELSE side1 END AS "bowlingTeam",
         concat('Pöł ', l_suppkey) AS "bowlerName", '0' AS overs, '1' AS maiden, '2' AS runs, '3' AS wickets, '4' AS economy, '5' AS "0s",
         '6' AS "4s", '7' AS "6s", '8' AS wides, '9' AS "noBalls" FROM lines""",
)
def tree_bowling_rows(spark, folder):
    records = elements.bowling_records(score_pages(spark, folder), "html", ["o_orderkey"])
    return records.where("parse_error IS NULL").drop("parse_error")


@query(
    "tree_rejects",
    """SELECT o_orderkey, 'no side names' AS parse_error FROM orders
       WHERE o_orderpriority = '5-LOW' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def tree_rejects(spark, folder):
    checked = elements.batting_pages(score_pages(spark, folder), "html", ["o_orderkey"])
    return checked.where("parse_error IS NOT NULL").select("o_orderkey", "parse_error")


@query(
    "tree_player_links",
    f"""{_LINES} SELECT concat('André O’Brien', l_partkey) AS name, CASE WHEN odd THEN side1 ELSE side2 END AS team,
          concat('{SITE}/player/', l_partkey) AS link FROM lines
        UNION SELECT concat('Pöł ', l_suppkey), CASE WHEN odd THEN side2 ELSE side1 END, concat('{SITE}/player/', l_suppkey) FROM lines""",
)
def tree_player_links(spark, folder):
    return elements.player_links(score_pages(spark, folder), "html", SITE)


_RESULT = (
    '<table class="engineTable"><tbody><tr class="data1"><td>Side %s<td>%s<td><b>Side %s</b><td>%s &lt;runs&gt; &frac12;<td>Ground<td>%s'
    '<td><a href="/match/%s?a=1&amp;b=2">T # %s</a><tr class="data1"><td>short row<tr class="head"><td>1<td>2<td>3<td>4<td>5<td>6<td>7</table>'
)


@query(
    "tree_match_rows",
    """SELECT o_orderkey, 0 AS ingest_seq, concat('Side ', o_custkey) AS team1, o_orderpriority AS team2, concat('Side ', o_custkey) AS winner,
         concat(o_custkey, ' <runs> ½') AS margin, 'Ground' AS ground, strftime(o_orderdate, '%b %-d, %Y') AS "matchDate",
         concat('T # ', o_orderkey) AS scorecard, concat('/match/', o_orderkey, '?a=1&b=2') AS link FROM orders""",
)
def tree_match_rows(spark, folder):
    day = F.date_format("o_orderdate", "MMM d, yyyy")
    custom, order = F.col("o_custkey"), F.col("o_orderkey")
    page = rendered(_RESULT, custom, F.col("o_orderpriority"), custom, custom, day, order, order)
    # One file of few row groups would be parsed by as many tasks; the columns that a page is made of are dealt out first.
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    dealt = orders.repartition(PARTS_A_CORE * spark.sparkContext.defaultParallelism)
    made = dealt.select("o_orderkey", page.alias("html"))
    return elements.result_records(made, "html", ["o_orderkey"])


_PROFILE = (
    '<div class="x ds-grid"><div><p class="label">Batting Style</p><span><p>%s</p></span></div><div><p>Other</p><span>o</span></div><div>'
    "<p>Playing Role</p><div><span>%s &hellip; more</span></div></div></div><div class='ci-player-bio-content'><div><p>About %s&mdash;x</p><p>More</p></div></div>"
)


@query(
    "tree_player_profiles",
    """SELECT c_custkey, c_mktsegment AS "battingStyle", '' AS "bowlingStyle", concat(c_name, ' … more') AS "playingRole",
         concat('About ', c_name, '—x') AS description FROM customer""",
)
def tree_player_profiles(spark, folder):
    page = F.format_string(_PROFILE, "c_mktsegment", "c_name", "c_name")
    rendered = table(spark, folder, "customer").select("c_custkey", page.alias("html"))
    return elements.profile_fields(rendered, "html", ["c_custkey"])
