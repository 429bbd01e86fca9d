"""Source queries. Score and profile pages are rendered row by row from the given tables, because the given pages
have no tables; reading them back must give the columns they were rendered from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.plans.adapters import stored, table
from tallyfield.registry import query
from tallyfield.session import fresh_path
from tallyfield.sources import nested, pages, tables

SITE = "https://site.example"


@query(
    "scan_csv",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
         CASE WHEN c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') THEN c_mktsegment END AS c_mktsegment FROM customer""",
)
def scan_csv(spark, folder):
    text = table(spark, folder, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS c_custkey",
        "c_name",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'nan' WHEN 'HOUSEHOLD' THEN '' ELSE c_mktsegment END AS c_mktsegment",
        "'x' AS unread",
    )
    path = fresh_path(spark, "customer-csv")
    tables.write_delimited(text, path)
    return tables.read_delimited(spark, path, ["c_custkey", "c_name", "c_mktsegment", "not_there"])


@query("json_props", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def json_props(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", nested.json_field(F.col("props"), "k").cast("int").alias("k"))


NESTED_COLUMNS = ["batsmanName", "runs"]
NESTED = """concat('[{"battingSummary":[{"batsmanName":"A', o_orderkey, '","runs":"', o_custkey,
  '"},{"batsmanName":"B', o_orderkey, '","runs":null}]},{"battingSummary":[{"batsmanName":"C', o_orderkey,
  '","runs":"', o_orderpriority, '"}]},{"battingSummary":[]}]')"""


def _documents(spark, folder):
    return table(spark, folder, "orders").selectExpr("o_orderkey", f"{NESTED} AS document")


@query(
    "inline_records",
    """SELECT o_orderkey, 0 AS ingest_seq, concat('A', o_orderkey) AS "batsmanName", CAST(o_custkey AS VARCHAR) AS runs FROM orders
       UNION ALL SELECT o_orderkey, 1, concat('B', o_orderkey), NULL FROM orders
       UNION ALL SELECT o_orderkey, 2, concat('C', o_orderkey), o_orderpriority FROM orders""",
)
def inline_records(spark, folder):
    return nested.all_records(_documents(spark, folder), "document", "battingSummary", NESTED_COLUMNS, ["o_orderkey"])


@query(
    "first_records",
    """SELECT o_orderkey, 0 AS ingest_seq, concat('A', o_orderkey) AS "batsmanName", CAST(o_custkey AS VARCHAR) AS runs FROM orders
       UNION ALL SELECT o_orderkey, 1, concat('B', o_orderkey), NULL FROM orders""",
)
def first_records(spark, folder):
    return nested.first_records(_documents(spark, folder), "document", "battingSummary", NESTED_COLUMNS, ["o_orderkey"])


HREFS = """regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1, 'i')"""


@query(
    "page_links",
    f"""SELECT page_id, i AS ingest_seq, concat('{SITE}', found[i + 1]) AS link
        FROM (SELECT page_id, {HREFS} AS found FROM pages), LATERAL (SELECT unnest(range(len(found))) AS i)""",
)
def page_links(spark, folder):
    return pages.links(table(spark, folder, "pages"), "html", SITE, ["page_id"])


@query(
    "page_links_distinct",
    f"""SELECT DISTINCT split_part(split_part(url, '//', 2), '/', 1) AS host, concat('{SITE}', unnest({HREFS})) AS link FROM pages
        UNION SELECT split_part(split_part(url, '//', 2), '/', 1), url FROM pages""",
)
def page_links_distinct(spark, folder):
    source = table(spark, folder, "pages").withColumn("host", F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)))
    inside = pages.links(source, "html", SITE, ["host"]).select("host", "link")
    return inside.unionByName(source.select("host", F.col("url").alias("link"))).distinct()


def _unescape(text: str) -> str:
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return text


_HEADING = "regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"


@query("page_title", f"SELECT page_id, replace({_unescape(_HEADING)}, ' the', '') AS title FROM pages")
def page_title(spark, folder):
    return pages.titled(table(spark, folder, "pages"), "html", r"(?s)<h1\b[^>]*>(.*?)</h1>", " the", ["page_id"])


@query(
    "page_profile",
    """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
         regexp_extract(html, 'charset="([^"]*)"', 1) AS charset, regexp_extract(html, '<footer>([^<]*)</footer>', 1) AS footer
       FROM pages""",
)
def page_profile(spark, folder):
    patterns = {"lang": '<html lang="([^"]*)"', "charset": 'charset="([^"]*)"', "footer": "<footer>([^<]*)</footer>"}
    return pages.pattern_fields(table(spark, folder, "pages"), "html", patterns, ["page_id"])


_BATTER = (
    '<tr><td><a href="/player/%s"><span><span>%s&nbsp;%s</span></span></a></td>'
    "<td><span><span>c &amp; b %s</span></span></td><td><strong>%s</strong></td><td>%s</td><td>-</td><td>4</td><td>6</td>"
    "<td>%s.5</td></tr>"
)
_BOWLER = (
    '<tr><td><a href="/player/%s"><span>%s</span></a></td><td>4</td><td>0</td><td>%s</td><td>1</td><td>%s.25</td>'
    "<td>9</td><td>2</td><td>1</td><td>3</td><td>0</td></tr>"
)
_INNINGS = (
    '<div><span><span>%s Innings</span></span><div><table class="wide ds-table ci-scorecard-table"><thead><tr><th>Batting</th>'
    "</tr></thead><tbody>" + _BATTER + '<tr><td>Extras</td><td>9</td></tr></tbody></table></div><div><table class="ds-table">'
    "<tbody>" + _BOWLER + "</tbody></table></div></div>"
)
_PAGE = "<html><body><div><span><span>%s</span></span></div>" + _INNINGS + _INNINGS + "</body></html>"


def score_pages(spark, folder):
    """One score page per order; orders of the lowest priority lack the heading."""

    def build():
        orders = table(spark, folder, "orders")
        key, who, priority = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
        heading = F.when(priority == "5-LOW", F.lit("Overview")).otherwise(F.lit("Match Details"))

        def innings(side, mark):
            word = F.lit(f"{mark}at")
            batter = [who, word, who, key, key, who, key]
            return [side, *batter, key, F.concat(F.lit(f"{mark}owl"), who.cast("string")), who, key]

        first, second = F.concat(F.lit("Side "), who.cast("string")), priority
        page = F.format_string(_PAGE, heading, *innings(first, "B"), *innings(second, "C"))
        # Reading pages is work for the processor, so the stored pages are spread over all cores.
        pages_per_core = orders.repartition(spark.sparkContext.defaultParallelism)
        return pages_per_core.select("o_orderkey", page.alias("html"))

    return stored(spark, folder, "score-pages", build)


@query(
    "page_rows",
    """WITH good AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW')
       SELECT o_orderkey, innings * 1000000 AS ingest_seq, concat('Side ', o_custkey, ' Vs ', o_orderpriority) AS match,
         CASE innings WHEN 0 THEN concat('Side ', o_custkey) ELSE o_orderpriority END AS "teamInnings", '1' AS "battingPos",
         concat(CASE innings WHEN 0 THEN 'Bat' ELSE 'Cat' END, o_custkey) AS "batsmanName", concat('c & b ', o_orderkey) AS dismissal,
         CAST(o_orderkey AS VARCHAR) AS runs, CAST(o_custkey AS VARCHAR) AS balls, '4' AS "4s", '6' AS "6s",
         concat(o_orderkey, '.5') AS "SR"
       FROM good, (SELECT unnest([0, 1]) AS innings)""",
)
def page_rows(spark, folder):
    records = pages.batting_records(score_pages(spark, folder), "html", ["o_orderkey"])
    return records.where("parse_error IS NULL").drop("parse_error")


@query(
    "page_bowling_rows",
    """WITH good AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW')
       SELECT o_orderkey, innings * 1000000 AS ingest_seq, concat('Side ', o_custkey, ' Vs ', o_orderpriority) AS match,
         CASE innings WHEN 0 THEN o_orderpriority ELSE concat('Side ', o_custkey) END AS "bowlingTeam",
         concat(CASE innings WHEN 0 THEN 'Bowl' ELSE 'Cowl' END, o_custkey) AS "bowlerName", '4' AS overs, '0' AS maiden,
         CAST(o_custkey AS VARCHAR) AS runs, '1' AS wickets, concat(o_orderkey, '.25') AS economy, '9' AS "0s", '2' AS "4s",
         '1' AS "6s", '3' AS wides, '0' AS "noBalls"
       FROM good, (SELECT unnest([0, 1]) AS innings)""",
)
def page_bowling_rows(spark, folder):
    records = pages.bowling_records(score_pages(spark, folder), "html", ["o_orderkey"])
    return records.where("parse_error IS NULL").drop("parse_error")


@query(
    "page_rejects",
    "SELECT o_orderkey, 'no side names' AS parse_error FROM orders WHERE o_orderpriority = '5-LOW'",
)
def page_rejects(spark, folder):
    checked = pages.batting_pages(score_pages(spark, folder), "html", ["o_orderkey"])
    return pages.rejected_pages(checked, ["o_orderkey"])


@query(
    "page_player_links",
    f"""WITH good AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW')
        SELECT concat('Bat', o_custkey) AS name, concat('Side ', o_custkey) AS team, concat('{SITE}/player/', o_custkey) AS link FROM good
        UNION SELECT concat('Cat', o_custkey), o_orderpriority, concat('{SITE}/player/', o_custkey) FROM good
        UNION SELECT concat('Bowl', o_custkey), o_orderpriority, concat('{SITE}/player/', o_orderkey) FROM good
        UNION SELECT concat('Cowl', o_custkey), concat('Side ', o_custkey), concat('{SITE}/player/', o_orderkey) FROM good""",
)
def page_player_links(spark, folder):
    return pages.player_links(score_pages(spark, folder), "html", SITE)


_RESULTS = (
    '<table class="engineTable"><tbody><tr class="data1"><td>Side %s</td><td>%s</td><td><b>Side %s</b></td><td>%s &lt;runs&gt;</td>'
    '<td>Ground</td><td>%s</td><td><a href="/match/%s">T # %s</a></td></tr><tr class="data1"><td>short row</td></tr>'
    '<tr class="head"><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td><td>7</td></tr></tbody></table>'
)


def _result_pages(spark, folder):
    day = F.date_format("o_orderdate", "MMM d, yyyy")
    page = F.format_string(
        _RESULTS, "o_custkey", "o_orderpriority", "o_custkey", "o_custkey", day, "o_orderkey", "o_orderkey"
    )
    return table(spark, folder, "orders").select("o_orderkey", page.alias("html"))


@query(
    "page_match_rows",
    """SELECT o_orderkey, 0 AS ingest_seq, concat('Side ', o_custkey) AS team1, o_orderpriority AS team2,
         concat('Side ', o_custkey) AS winner, concat(o_custkey, ' <runs>') AS margin, 'Ground' AS ground,
         strftime(o_orderdate, '%b %-d, %Y') AS "matchDate", concat('T # ', o_orderkey) AS scorecard FROM orders""",
)
def page_match_rows(spark, folder):
    return pages.result_records(_result_pages(spark, folder), "html", ["o_orderkey"])


@query(
    "page_contest_links",
    f"SELECT o_orderkey, 0 AS ingest_seq, concat('{SITE}/match/', o_orderkey) AS link FROM orders",
)
def page_contest_links(spark, folder):
    return pages.contest_links(_result_pages(spark, folder), "html", SITE, ["o_orderkey"])


_PROFILE = (
    '<div class="ds-grid"><div><p class="label">Batting Style</p><span><p>%s</p></span></div><div><p>Playing Role</p><span>%s &amp; more'
    '</span></div></div><div class="ci-player-bio-content"><p>About %s</p><p>More</p></div>'
)


@query(
    "page_player_profiles",
    """SELECT c_custkey, c_mktsegment AS "battingStyle", '' AS "bowlingStyle", concat(c_name, ' & more') AS "playingRole",
         concat('About ', c_name) AS description FROM customer""",
)
def page_player_profiles(spark, folder):
    page = F.format_string(_PROFILE, "c_mktsegment", "c_name", "c_name")
    rendered = table(spark, folder, "customer").select("c_custkey", page.alias("html"))
    return pages.profile_fields(rendered, "html", ["c_custkey"])
