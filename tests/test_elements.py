"""Element trees: what the pattern reader finds on flat pages, and what only a tree can tell."""

import random
import time

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from test_sources import page

from tallyfield.sources import elements, pages, plain


@pytest.fixture(scope="module")
def site(spark):
    few = '<div><span><span>Match Details</span></span></div><div><span><span>A Innings</span></span></div><div><span><span>B Innings</span></span></div>'
    return spark.createDataFrame([(1, page()), (2, page("Other")), (3, few), (4, None), (5, "")], "page long, html string")


def test_same_records_as_the_pattern_reader(site):
    for one, other in ((elements.batting_records, pages.batting_records), (elements.bowling_records, pages.bowling_records)):
        ours, theirs = one(site, "html", ["page"]), other(site, "html", ["page"])
        assert ours.columns == theirs.columns
        assert rows(ours.drop("ingest_seq")) == rows(theirs.drop("ingest_seq"))
    assert [r[0] for r in rows(elements.batting_records(site, "html", ["page"]), "ingest_seq")] == [0, 1, 2, 3]
    assert rows(elements.player_links(site, "html", "https://s")) == rows(pages.player_links(site, "html", "https://s"))


def test_bad_pages_are_reported(site):
    checked = elements.batting_pages(site, "html", ["page"])
    assert rows(pages.rejected_pages(checked, ["page"])) == [
        (2, "no side names"), (3, "too few tables"), (4, "no side names"), (5, "no side names"),
    ]


def test_side_names_need_no_innings_word():
    plain = page().replace(" Innings", "")
    assert elements.read_page(plain)["sides"] == elements.read_page(page())["sides"] == ["India", "Pakistan"]


def test_heading_in_nested_divs():
    nested = page().replace("<div><span><span>Match Details</span></span></div>", "<div><div><span><span>Match Details</span></span></div></div>")
    assert elements.read_page(nested)["sides"] == ["India", "Pakistan"]


def test_nested_table_adds_no_cells_or_rows():
    html = "<div><table class='t'><tbody><tr><td>a<table><tbody><tr><td>b</td></tr></tbody></table></td><td>c</td></tr></tbody></table></div>"
    outer, inner = elements.read_page(html)["tables"]
    assert [[c["text"] for c in r["cells"]] for r in outer["rows"]] == [["ab", "c"]]
    assert [[c["text"] for c in r["cells"]] for r in inner["rows"]] == [["b"]]
    assert outer["inside_div"] and not inner["inside_div"]


def test_open_cells_stray_ends_and_references():
    html = "</td><table><tbody><tr><td>&eacute;&#8217;&#x142;&amp;lt;<td>2</b><tr><td>3</table><script>var x = '<td>';</script>"
    (found,) = elements.read_page(html)["tables"]
    assert [[c["text"] for c in r["cells"]] for r in found["rows"]] == [["é’ł&lt;", "2"], ["3"]]


@pytest.mark.parametrize("piece", ["<div>", "<div></li>", "<td><span>", "<svg>", "<div><span><span>x", "<p>&"])
def test_large_broken_pages_take_linear_time(piece):
    began = time.monotonic()
    elements.read_page(piece * (300_000 // len(piece)))
    assert time.monotonic() - began < 5


def test_large_page_of_many_rows():
    row = "<tr>" + "<td>1</td>" * 8 + "</tr>"
    began = time.monotonic()
    (found,) = elements.read_page(f"<table><tbody>{row * 5000}</tbody></table>")["tables"]
    assert len(found["rows"]) == 5000 and time.monotonic() - began < 10


def test_plain_and_tolerant_reading_agree():
    """A comment at the end sends the same page through the tolerant parser."""
    odd = "<DIV Class='a b' id=\"x&amp;y\">t&eacute;</DIV><br/>x</br><table class=t><tr><td>1<td>2</td >3<td/>4</table>"
    for html in (page(), page().replace("<td>", "<TD>"), odd.replace("=t", "='t'"), "no tag &amp; &lt", "a<p>b</p>c", "<td>1</td><p", odd):
        assert elements.read_page(html) == elements.read_page(html + "<!-- -->")
    assert [plain for _, plain in map(elements._tokens, (page(), odd, "<p>x</p>", "<title>x</title>", "<p>1 < 2"))] == [True, False, True, False, False]


def test_tables_of_one_class_only(spark):
    html = "<table class='a b'><tbody><tr><td>1</td></tr></tbody></table><table class='c'></table>"
    read = elements.parsed(spark.createDataFrame([(html,), (None,)], "html string"), "html", [], wanted="b")
    assert [r[0] for r in read.selectExpr("transform(_page.tables, t -> t.classes)").collect()] == [[["a", "b"]], []]


def test_score_pages_shuffle_no_markup(spark, folder):
    """Lines are gathered by their numbers; markup in the exchange is twenty times as much."""
    from tallyfield.registry.elements import _sheets

    plan = _sheets(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "<td>" not in plan and "format_string" not in plan


def test_results_are_parsed_by_all_cores(spark, folder):
    from tallyfield.registry.elements import tree_match_rows

    assert tree_match_rows(spark, folder).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_profile_takes_the_first_of_equal_labels(spark):
    grid = '<div class="ds-grid"><div><p>Batting Style</p><span>Left</span></div><div><p>Batting Style</p><span>Right</span></div></div>'
    df = spark.createDataFrame([(1, grid), (2, None)], "id int, html string")
    assert rows(elements.profile_fields(df, "html", ["id"])) == [(1, "Left", "", "", ""), (2, "", "", "", "")]


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(1, "t", "<h1>A <b>b</b></h1>")], "id int, text string, html string")
    assert rows(elements.titles(df, "html", ["id", "text"])) == [(1, "t", "A b")]
    assert elements.titles(df.limit(0), "html", ["id"]).count() == 0


def _random_pages(rng, n):
    """Small pages of open, crossed and stray tags, score tables and odd markup."""
    tags = "div div span a td td tr tr table table tbody tbody thead th p b br h1".split()
    given = ["", "", " class='ds-table'", ' class="x ci-scorecard-table"', ' href="/p?a=1&amp;b=2"', " href='/x' HREF=\"/y\"", "/", " CLASS='&eacute; z'"]
    words = ["Match Details", "India Innings", " Pak ", "x", "&eacute;", "&amp;lt;", "é&#8217; z", "&#xD800;&#1;", "\n", "&bad"]
    odd = ["<!-- c -->", "<p x=1>", " > ", "<title>t</title>", "<blockquote>", '<div class="ds-grid"><div><p>L</p><span>v</span></div></div>', "</ td>", "<>"]
    name = lambda word: f"<div><span><span>{word}</span></span></div>"
    made = []
    for k in range(n):
        pieces, opened = [name("Match Details") + name("A") + name("B Innings")] if k % 5 == 0 else [], []
        for _ in range(rng.randrange(60)):
            kind = rng.random()
            if kind < 0.45:
                opened.append(rng.choice(tags))
                pieces.append(f"<{opened[-1]}{rng.choice(given)}>")
            elif kind < 0.75 and opened:
                pieces.append(f"</{opened.pop()}>")
            else:
                pieces.append(f"</{rng.choice(tags)}>" if kind < 0.8 else rng.choice(words))
        made.append("".join(pieces) + (rng.choice(odd) if k % 7 == 0 else "") + "<td>1</td><td>2</td><td></td>" * (k % 3))
    return made


def test_pages_side_by_side_agree_with_one_page_at_a_time(spark):
    rng = random.Random(7)
    kind = to_arrow_type(StructType.fromDDL(f"p {elements.PARSED}")[0].dataType)
    given = [None, "", "no tag &amp; &lt", page(), page("Other"), "<div>" * 100, "<p>" * 5000, *_random_pages(rng, 1500)]
    for wanted in (None, [pages.BOWLING_TABLE], [pages.BATTING_TABLE, pages.BOWLING_TABLE]):
        expected = elements._column([elements.read_page(html, wanted) for html in given], kind)
        assert elements.read_pages(pa.array(given, pa.string()), kind, wanted).to_pylist() == expected.to_pylist()
    _, left = plain.read_plain(pa.array([page(), page("Other")] * 20), kind, None)
    assert not left.any()


def test_pages_are_cut_by_rows_and_octets(monkeypatch):
    monkeypatch.setattr(plain, "PAGES", 3)
    monkeypatch.setattr(plain, "OCTETS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (1, 1, 1, 1, 30, 0, 9, 2)])], names=["html"])
    assert [part.num_rows for part in plain.in_parts(batch, 0)] == [3, 1, 1, 2, 1]


def test_full_rows_of_pages_read_either_way(spark):
    """Records are made from arrays; the comment sends a page through the other reader."""
    given = [(k, page() + ("<!-- -->" if k % 2 else "")) for k in range(40)] + [(40, page().replace("<span><span>", "<span>", 3)), (41, None)]
    df = spark.createDataFrame(given, "page long, html string").coalesce(1)
    for one, other in ((elements.batting_records, pages.batting_records), (elements.bowling_records, pages.bowling_records)):
        assert rows(one(df.where("page < 40"), "html", ["page"]).drop("ingest_seq")) == rows(other(df.where("page < 40"), "html", ["page"]).drop("ingest_seq"))
        assert one(df.where("page > 40"), "html", ["page"]).count() == 0


def test_pages_are_written_by_all_cores(spark, folder):
    from tallyfield.registry.elements import PARTS_A_CORE, _sheets

    assert _sheets(spark, folder).rdd.getNumPartitions() >= PARTS_A_CORE * spark.sparkContext.defaultParallelism


def test_written_pages_are_the_rendered_ones(spark):
    """Arrow's way of writing a template out against Spark's, with missing values."""
    from tallyfield.registry.elements import rendered, written_out

    given = [(1, "a%s", None), (None, None, 5), (3, "é", 7)]
    df = spark.createDataFrame(given, "a long, b string, c int")
    expected = [r[0] for r in df.select(rendered("<%s|%s>%s", F.col("a"), F.col("b"), F.col("c"))).collect()]
    columns = [pa.array(column) for column in zip(*given, strict=True)]
    assert written_out("<%s|%s>%s", *columns).to_pylist() == expected
