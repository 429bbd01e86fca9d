import json

import pytest
from conftest import rows

from tallyfield.plans import records
from tallyfield.sources import nested, pages, tables

BATTER = (
    '<tr><td class="x"><a href="/p/{0}"><span><span>{0}&nbsp;</span></span></a></td><td><span><span>c A &amp; b B</span></span></td>'
    "<td><strong>{1}</strong></td><td>10</td><td>15</td><td>2</td><td>1</td><td>120.0</td></tr>"
)
BOWLER = '<tr><td><a href="/p/{0}"><span>{0}</span></a></td>' + "".join(f"<td>{i}</td>" for i in range(10)) + "</tr>"
SHORT = "<tr><td>Extras</td><td>3</td></tr>"
NAMELESS = "<tr>" + "".join(f"<td>{i}</td>" for i in range(8)) + "</tr>"


def innings(name, batters, bowlers):
    head = f"<div><span><span>{name} Innings</span></span>"
    return (
        f'{head}<div><TABLE class="w ds-table ci-scorecard-table"><thead><tr><th>h</th></tr></thead><tbody>{"".join(batters)}{SHORT}'
        f'</tbody></TABLE></div><div><table class="ds-table"><tbody>{"".join(bowlers)}</tbody></table></div></div>'
    )


def page(heading="Match Details"):
    body = innings("India", [BATTER.format("Kohli", 82), BATTER.format("Sharma", 4)], [BOWLER.format("Rauf")])
    body += innings("Pakistan", [BATTER.format("Masood", 52), NAMELESS], [BOWLER.format("Singh")])
    return f"<html><div><span><span>{heading}</span></span></div>{body}</html>"


@pytest.fixture(scope="module")
def site(spark):
    few = '<div><span><span>Match Details</span></span></div><div><span><span>A Innings</span></span></div><div><span><span>B Innings</span></span></div>'
    return spark.createDataFrame([(1, page()), (2, page("Other")), (3, few), (4, None)], "page long, html string").cache()


def test_batting_records(site):
    out = pages.batting_records(site, "html", ["page"])
    good = rows(out.where("parse_error IS NULL"), "page", "match", "teamInnings", "batsmanName", "dismissal", "runs", "4s", "6s", "SR")
    assert good == [
        (1, "India Vs Pakistan", "India", "Kohli", "c A & b B", "82", "2", "1", "120.0"),
        (1, "India Vs Pakistan", "India", "Sharma", "c A & b B", "4", "2", "1", "120.0"),
        (1, "India Vs Pakistan", "Pakistan", "Masood", "c A & b B", "52", "2", "1", "120.0"),
    ]
    assert rows(out.where("parse_error IS NOT NULL"), "page", "parse_error") == [(1, "no player name")]
    in_order = [(r["batsmanName"], r["battingPos"]) for r in out.orderBy("ingest_seq").collect()]
    assert in_order == [("Kohli", "1"), ("Sharma", "2"), ("Masood", "1"), (None, "2")]


def test_bowling_sides_are_swapped(site):
    out = pages.bowling_records(site, "html", ["page"])
    assert rows(out, "bowlingTeam", "bowlerName", "overs", "noBalls") == [("India", "Singh", "0", "9"), ("Pakistan", "Rauf", "0", "9")]


def test_bad_pages_are_reported(site):
    checked = pages.batting_pages(site, "html", ["page"])
    assert rows(pages.rejected_pages(checked, ["page"])) == [(2, "no side names"), (3, "too few tables"), (4, "no side names")]


def test_player_links_of_both_roles(site):
    out = rows(pages.player_links(site, "html", "https://s"))
    assert ("Kohli", "India", "https://s/p/Kohli") in out and ("Rauf", "Pakistan", "https://s/p/Rauf") in out and len(out) == 5


def test_profile(spark):
    grid = '<div class="ds-grid"><div><p>Full Name</p><span>X</span></div><div><p>Batting Style</p><span><p>Right hand</p></span></div><div><p>Playing Role</p></div></div>'
    bio = '<div class="a ci-player-bio-content b"><p>First</p><p>Second</p></div>'
    df = spark.createDataFrame([(1, grid + bio), (2, "<p>none</p>")], "id int, html string")
    assert rows(pages.profile_fields(df, "html", ["id"])) == [(1, "Right hand", "", "", "First"), (2, "", "", "", "")]


def test_csv_round_trip_and_gate(spark, tmp_path):
    raw = spark.createDataFrame([("A ", "nan", "Oct 16, 2022", 'say "x", y'), ("B", None, "bad", "two\nlines")], "team1 string, winner string, matchDate string, margin string")
    path = str(tmp_path / "m.csv")
    tables.write_delimited(raw, path)
    back = tables.read_delimited(spark, path, tables.RAW_MATCHES, multi_line=True)
    assert back.columns == ["team1", "winner", "margin", "matchDate"]
    assert rows(back, "team1", "winner", "margin") == [("A ", None, 'say "x", y'), ("B", None, "two\nlines")]
    assert rows(records.clean_matches(back), "matchDate") == [("2022-10-16",)]
    with pytest.raises(tables.MissingInput):
        tables.read_delimited(spark, str(tmp_path / "none.csv"), tables.RAW_MATCHES)
    with pytest.raises(tables.MissingInput):
        tables.require_inputs(spark, [path, str(tmp_path / "none.csv")])


def test_nested_json_files(spark, tmp_path):
    batting = [{"battingSummary": [{"batsmanName": "a", "runs": "1"}, {"batsmanName": "b"}]}, {"battingSummary": [{"batsmanName": "c"}]}]
    path = str(tmp_path / "b.json")
    (tmp_path / "b.json").write_text(json.dumps(batting))
    every = nested.read_nested(spark, path, "battingSummary", ["batsmanName", "runs"])
    assert rows(every, "batsmanName", "runs") == [("a", "1"), ("b", None), ("c", None)]
    first = nested.read_nested(spark, path, "battingSummary", ["batsmanName"], first_only=True)
    assert rows(first, "ingest_seq", "batsmanName") == [(0, "a"), (1, "b")]
    (tmp_path / "p.json").write_text(json.dumps([{"name": "x", "team": "A"}, {"name": "y"}]))
    assert rows(nested.read_records(spark, str(tmp_path / "p.json"), ["name", "team"])) == [("x", "A"), ("y", None)]


def test_star_schema_tables(spark, tmp_path):
    matches = spark.createDataFrame(
        [("m1", "A", "B", "A", "3 runs", "G", "2022-01-02"), ("m1", "A", "B", "B", "4 runs", "G", "2022-01-03"), ("m2", "B", "A", "no result", None, "G", "2022-01-04")],
        "match_id string, team1 string, team2 string, winner string, margin string, ground string, matchDate string",
    )
    players = spark.createDataFrame([("Sam", "A", "Right")], "name string, team string, battingStyle string")
    batting = spark.createDataFrame([("m1", "A", "Sam", 1, 30.0, 120.5)], "match_id string, teamInnings string, batsmanName string, battingPos int, runs double, SR double")
    bowling = spark.createDataFrame([("m1", "B", "Nobody", 3.4, 0.0)], "match_id string, bowlingTeam string, bowlerName string, overs double, `0s` double")
    out = records.load_star_schema(spark, str(tmp_path / "star"), matches, players, batting, bowling, ["matchDate"], ["name"])
    for name, schema in (("teams", tables.TEAMS), ("players", tables.PLAYERS), ("matches", tables.MATCHES), ("batting", tables.BATTING), ("bowling", tables.BOWLING)):
        assert [(f.name, f.dataType) for f in out[name].schema] == [(f.name, f.dataType) for f in schema]
    assert rows(out["matches"].where("winner_id IS NULL"), "match_id", "winner_text") == [("m2", "no result")]
    assert rows(out["matches"].where("match_id = 'm1'"), "margin") == [("4 runs",)]
    assert out["batting"].where("batsman_id IS NOT NULL AND strike_rate = 120.5").count() == 1
    assert out["bowling"].where("bowler_id IS NULL AND zeros = 0").count() == 1
    base = records.contests_from_star(out["matches"], out["teams"])
    assert rows(base, "contest_id", "side1", "side1_won") == [("m1", "A", 0), ("m2", "B", None)]


def test_sql_with_bound_parameters(spark):
    df = spark.createDataFrame([(1, "x"), (2, "it's")], "a int, b string")
    assert rows(tables.run_sql(spark, "SELECT a FROM {t} WHERE b = :b", {"b": "it's"}, t=df)) == [(2,)]
    df.createOrReplaceTempView("listed_here")
    assert "listed_here" in tables.list_tables(spark)


def test_player_links_search_each_cell_once(site):
    """The patterns of the link and the name stand once in the plan, not again in the filter above them."""
    plan = pages.player_links(site, "html", "http://s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"<a\b[^>]*>(.*?)</a>") == plan.count(r'\bhref="([^"]*)"') == 1
    assert plan.lower().count("rlike") == 0


def test_leaps_to_the_end_tag_match_as_before(spark):
    """Against the patterns in plain words, on markup that nests, ends nowhere or holds thousands of tags."""
    given = [
        "<td>a</td><TD x='1'>b<b>c</b></Td><td>open <td>d</td></td><td>end", "<td>", "<td></td>< td>", "a < b <td>x < y </ td></td>", "<tdx>a</td>",
        "<td>" + "<i>q</i>" * 20_000 + "</td><td>\n<td></TD>", "<td>" + "<" * 5_000, "", None,
    ]
    df = spark.createDataFrame(list(enumerate(given)), "n long, html string")
    old = pages.all_matches(pages.F.col("html"), r"(?is)<td\b[^>]*>(.*?)</td>")
    for row in df.select(old.alias("old"), pages.row_cells(pages.F.col("html")).alias("new")).collect():
        assert row.old == row.new


def test_first_match_is_the_first_and_null_without_one(spark):
    df = spark.createDataFrame([("<a>x\n</a><a>y</a>",), ("<A></A>",), ("none",), (None,)], "html string")
    found = [r[0] for r in df.select(pages.first_match(pages.F.col("html"), r"(?is)<a\b[^>]*>(.*?)</a>")).collect()]
    assert found == ["x\n", "", None, None]
