"""Attributes and marks of pages that must not cost text."""

from tallyfield.llm import extraction


def test_only_exact_attribute_names_count():
    for kept in ("style='overflow:hidden'", "aria-hidden=false", "data-role=banner", 'title="Hidden gems"', "data-id=nav", "title='a class=menu b'"):
        assert extraction.main_text(f"<article><div {kept}><p>Some text</p></div></article>") == "Some text", kept
    for cut in ("hidden", "x=1 HIDDEN", "hidden=''", "role=banner", 'data-a="b" class = "menu"', "id=nav", "a='1'class='menu'"):
        assert extraction.main_text(f"<article><div {cut}><p>Some text</p></div></article>") == "", cut


def test_text_beside_teaser_articles_stays():
    prose = ("The cat and the dog were in the house of the man and it was a good day. " * 4).strip()
    teaser = "<article class='teaser'><h3><a href='/x'>Other story</a></h3><p>Markets rally again</p></article>"
    assert extraction.main_text(f"<main><p>{prose}</p><p>{prose}</p></main>{teaser * 3}") == f"{prose}\n{prose}"
    assert extraction.main_text(f"<div><p>{prose}</p></div>{teaser}<div><p>Imprint</p></div>").startswith(prose)
    assert extraction.main_text(f"<article><h1>Title</h1><p>{prose}<p>Short end</article>{teaser}") == f"Title\n{prose}\nShort end"
