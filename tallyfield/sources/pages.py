"""Records out of HTML pages, with expressions that stay inside the JVM.

Pages that do not have the expected shape are not an error for the job: they are reported with a reason and the
other pages go on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import scrub, visible_text

# Classes, headings and column numbers of the score pages.
RESULTS_TABLE = "engineTable"
RESULTS_ROW = "data1"
BATTING_TABLE = "ci-scorecard-table"
BOWLING_TABLE = "ds-table"
PROFILE_GRID = "ds-grid"
PROFILE_TEXT = "ci-player-bio-content"
HEADING = "Match Details"
INNINGS_WORD = " Innings"
NO_BREAK_SPACE = "\u00a0"
BATTING_CELLS = {"dismissal": 1, "runs": 2, "balls": 3, "4s": 5, "6s": 6, "SR": 7}
BOWLING_CELLS = {
    "overs": 1, "maiden": 2, "runs": 3, "wickets": 4, "economy": 5, "0s": 6, "4s": 7, "6s": 8, "wides": 9,
    "noBalls": 10,
}
RESULT_CELLS = {
    "team1": 0, "team2": 1, "winner": 2, "margin": 3, "ground": 4, "matchDate": 5, "scorecard": 6,
}
PROFILE_LABELS = {"battingStyle": "Batting Style", "bowlingStyle": "Bowling Style", "playingRole": "Playing Role"}


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match or NULL; Spark's own extract gives empty text when nothing matches.

    The match takes the rest of the text along, so the text is searched once and there is one match at most.
    """
    return F.get(all_matches(text, rf"(?:{pattern})(?s:.*)", group), F.lit(0))


def _up_to_end(tag: str) -> str:
    """Group of all text before the next end tag, and the end tag. Matches what ``(.*?)</tag>`` does, but in leaps from
    tag to tag: it looks for the end tag at each ``<`` only."""
    return rf"([^<]*(?:<(?!/{tag}>)[^<]*)*+)</{tag}>"


def _once(df: DataFrame, **computed: Column) -> DataFrame:
    """``df`` with computed columns that are evaluated once a row; a filter above a plain column would repeat its patterns."""
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in computed.items()]))))


def _with_class(tag: str, name: str) -> str:
    return rf'<{tag}\b[^>]*\bclass="(?:[^"]*\s)?{re.escape(name)}(?:\s[^"]*)?"[^>]*>'


def tables_of_class(html: Column, name: str) -> Column:
    """Inner HTML of every table with the class."""
    return all_matches(html, rf"(?is){_with_class('table', name)}{_up_to_end('table')}")


def body_rows(table: Column, row_class: str | None = None) -> Column:
    """Inner HTML of the rows in the table's body."""
    opening = _with_class("tr", row_class) if row_class else r"<tr\b[^>]*>"
    bodies = F.array_join(all_matches(table, rf"(?is)<tbody\b[^>]*>{_up_to_end('tbody')}"), "")
    return all_matches(bodies, rf"(?is){opening}{_up_to_end('tr')}")


def row_cells(row: Column) -> Column:
    return all_matches(row, rf"(?is)<td\b[^>]*>{_up_to_end('td')}")


def link_target(cell: Column) -> Column:
    return first_match(cell, r'(?is)<a\b[^>]*\bhref="([^"]*)"')


def links(df: DataFrame, html: str, site: str, keep: Sequence[str]) -> DataFrame:
    """Every link of a page as a full address, with its position."""
    targets = all_matches(F.col(html), r'(?is)<a\b[^>]*\bhref="([^"]*)"')
    exploded = df.select(*keep, F.posexplode(targets).alias("ingest_seq", "_target"))
    return exploded.select(*keep, "ingest_seq", F.concat(F.lit(site), "_target").alias("link"))


def _result_rows(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Cells of the full rows of the results table, with their position."""
    rows = F.flatten(F.transform(tables_of_class(F.col(html), RESULTS_TABLE), lambda t: body_rows(t, RESULTS_ROW)))
    cells = F.transform(
        rows, lambda row, i: F.struct(i.cast("long").alias("ingest_seq"), row_cells(row).alias("_cells"))
    )
    return df.select(*keep, F.inline(F.filter(cells, lambda r: F.size(r["_cells"]) >= len(RESULT_CELLS))))


def contest_links(df: DataFrame, html: str, site: str, keep: Sequence[str], cell: int = 6) -> DataFrame:
    """Score page addresses from the results table: the link in the seventh cell of each row."""
    found = _result_rows(df, html, keep).withColumn("_target", link_target(F.get("_cells", F.lit(cell))))
    return found.where(F.length("_target") > 0).select(*keep, "ingest_seq", F.concat(F.lit(site), "_target").alias("link"))


def result_records(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Rows of the results table as seven text fields."""
    return _result_rows(df, html, keep).select(*keep, "ingest_seq", *_fields(RESULT_CELLS))


def _fields(cells: Mapping[str, int]) -> list[Column]:
    return [visible_text(F.get("_cells", F.lit(i))).alias(name) for name, i in cells.items()]


def _sides(html: Column) -> Column:
    """Side names in the innings headings after the details heading, in page order."""
    after = F.regexp_extract(html, rf"(?s)>\s*{re.escape(HEADING)}\s*<(.*)$", 1)
    headings = all_matches(after, rf"(?s)<span\b[^>]*>\s*<span\b[^>]*>([^<]*?{INNINGS_WORD})[^<]*</span>")
    return F.transform(headings, lambda h: F.replace(visible_text(h), F.lit(INNINGS_WORD), F.lit("")))


def _checked(df: DataFrame, html: str, keep: Sequence[str], table_class: str, minimum: int) -> DataFrame:
    page = df.select(
        *keep, _sides(F.col(html)).alias("_sides"), tables_of_class(F.col(html), table_class).alias("_tables")
    )
    heading = F.coalesce(F.size("_sides") < 2, F.lit(True))
    return page.withColumn(
        "parse_error",
        F.when(heading, F.lit("no side names")).when(F.size("_tables") < minimum, F.lit("too few tables")),
    )


def _score_rows(page: DataFrame, keep: Sequence[str], pick: Sequence[tuple[int, int]], cells: int) -> DataFrame:
    """Rows of the chosen tables, each with the side it belongs to.

    ``pick`` lists (table number, side number) pairs. ``ingest_seq`` counts through the page, so the order of
    records survives. Bad pages and short rows are left out inside the arrays: a filter above them would be pushed
    down and evaluate every pattern a second time.
    """

    def placed(innings: int) -> Callable[[Column, Column], Column]:
        start = F.lit(innings * 1_000_000)
        return lambda row, i: F.struct((start + i).cast("long").alias("ingest_seq"), row_cells(row).alias("_cells"))

    innings = [
        F.struct(
            F.get("_sides", F.lit(side)).alias("side"),
            F.transform(
                F.filter(
                    F.transform(body_rows(F.get("_tables", F.lit(table))), placed(n)), lambda r: F.size(r["_cells"]) >= cells
                ),
                lambda r, i: F.struct(r["ingest_seq"].alias("ingest_seq"), r["_cells"].alias("_cells"), (i + 1).alias("_place")),
            ).alias("rows"),
        )
        for n, (table, side) in enumerate(pick)
    ]
    title = F.concat_ws(" Vs ", F.get("_sides", F.lit(0)), F.get("_sides", F.lit(1)))
    usable = F.when(F.col("parse_error").isNull(), F.array(*innings))
    tables = page.select(*keep, title.alias("match"), F.inline(usable))
    return tables.select(*keep, "match", "side", F.inline("rows"))


def batting_pages(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    return _checked(df, html, keep, BATTING_TABLE, 2)


def bowling_pages(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    return _checked(df, html, keep, BOWLING_TABLE, 4)


def _link_text() -> Column:
    """Markup inside the first link of the first cell."""
    return first_match(F.get("_cells", F.lit(0)), r"(?is)<a\b[^>]*>(.*?)</a>")


def _name_markup(nested: bool) -> Column:
    """Markup of the name in the link; the batting table wraps it in two spans, the bowling one in one."""
    span = r"(?is)<span\b[^>]*>\s*<span\b[^>]*>(.*?)</span>" if nested else r"(?is)<span\b[^>]*>(.*?)</span>"
    return first_match(F.col("_link"), span)


def _name_text() -> Column:
    return scrub(visible_text(F.col("_span")), [NO_BREAK_SPACE])


def _with_player(rows: DataFrame, nested: bool) -> DataFrame:
    """The rows with the player's name, NULL without one."""
    found = _once(_once(rows, _link=_link_text()), _span=_name_markup(nested))
    return _once(found, _name=_name_text())


def batting_records(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """One record per batting row of both innings, numbered inside its innings; rows without a name link carry a
    ``parse_error``."""
    rows = _score_rows(batting_pages(df, html, keep), keep, [(0, 0), (1, 1)], 8)
    rows = _with_player(rows, nested=True)
    return rows.select(
        *keep, "ingest_seq", "match", F.col("side").alias("teamInnings"), F.col("_place").cast("string").alias("battingPos"),
        F.col("_name").alias("batsmanName"),
        *_fields(BATTING_CELLS), F.when(F.col("_name").isNull(), F.lit("no player name")).alias("parse_error"),
    )


def bowling_records(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Second and fourth table: the bowlers of an innings belong to the side that is not batting."""
    rows = _score_rows(bowling_pages(df, html, keep), keep, [(1, 1), (3, 0)], 11)
    rows = _with_player(rows, nested=False)
    return rows.select(
        *keep, "ingest_seq", "match", F.col("side").alias("bowlingTeam"), F.col("_name").alias("bowlerName"),
        *_fields(BOWLING_CELLS), F.when(F.col("_name").isNull(), F.lit("no player name")).alias("parse_error"),
    )


def rejected_pages(checked: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Pages set aside, with the reason."""
    return checked.where(F.col("parse_error").isNotNull()).select(*keep, "parse_error")


def player_links(df: DataFrame, html: str, site: str) -> DataFrame:
    """Distinct (name, team, link) over the batting and the bowling tables; each page is read once for both."""
    source = F.col(html)
    page = df.select(
        _sides(source).alias("_sides"),
        tables_of_class(source, BATTING_TABLE).alias("_batting"),
        tables_of_class(source, BOWLING_TABLE).alias("_bowling"),
    )

    def first_cells(tables: str, table: int, side: int, nested: bool, cells: int) -> Column:
        rows = F.transform(body_rows(F.get(tables, F.lit(table))), row_cells)
        full = F.filter(rows, lambda r: F.size(r) >= cells)
        team = F.get("_sides", F.lit(side))
        return F.transform(
            full, lambda r: F.struct(team.alias("team"), F.lit(nested).alias("nested"), F.slice(r, 1, 1).alias("_cells"))
        )

    two_sides = F.size("_sides") >= 2
    batting = F.when(
        two_sides & (F.size("_batting") >= 2),
        F.concat(first_cells("_batting", 0, 0, True, 8), first_cells("_batting", 1, 1, True, 8)),
    )
    bowling = F.when(
        two_sides & (F.size("_bowling") >= 4),
        F.concat(first_cells("_bowling", 1, 1, False, 11), first_cells("_bowling", 3, 0, False, 11)),
    )
    none = F.array().cast("array<struct<team:string,nested:boolean,_cells:array<string>>>")
    rows = page.select(F.inline(F.concat(F.coalesce(batting, none), F.coalesce(bowling, none))))
    found = _once(rows, _link=_link_text(), _target=link_target(F.get("_cells", F.lit(0)))).where("length(_target) > 0")
    found = _once(found, _span=F.when(F.col("nested"), _name_markup(True)).otherwise(_name_markup(False))).where("_span IS NOT NULL")
    return found.select(_name_text().alias("name"), "team", F.concat(F.lit(site), "_target").alias("link")).distinct()


def labelled_value(html: Column, label: str) -> Column:
    """Text of the first span that follows a paragraph holding exactly the label; empty text if there is none."""
    pattern = rf"(?s)<p\b[^>]*>{re.escape(label)}</p>(?:(?!<p\b).)*?<span\b[^>]*>(.*?)</span>"
    return F.coalesce(visible_text(first_match(html, pattern)), F.lit(""))


def profile_fields(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Styles, role and description of a profile page; missing ones are empty text, as on the page."""
    grid = F.regexp_extract(F.col(html), rf"(?is){_with_class('div', PROFILE_GRID)}(.*)$", 1)
    bio = F.regexp_extract(F.col(html), rf"(?is){_with_class('div', PROFILE_TEXT)}(.*)$", 1)
    text = F.coalesce(visible_text(first_match(bio, r"(?is)<p\b[^>]*>(.*?)</p>")), F.lit(""))
    values = [labelled_value(grid, label).alias(name) for name, label in PROFILE_LABELS.items()]
    return df.select(*keep, *values, text.alias("description"))


def titled(df: DataFrame, html: str, pattern: str, remove: str, keep: Sequence[str]) -> DataFrame:
    """Heading text with a fixed word taken out."""
    title = visible_text(first_match(F.col(html), pattern))
    return df.select(*keep, F.replace(title, F.lit(remove), F.lit("")).alias("title"))


def pattern_fields(df: DataFrame, html: str, patterns: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """First match of each pattern as a column; NULL where a page has none."""
    return df.select(*keep, *[first_match(F.col(html), pattern).alias(name) for name, pattern in patterns.items()])
