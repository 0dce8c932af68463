"""Broken and old markup: no page stops a query, and nothing that is visible gets lost."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stacktally.llm import html


@pytest.mark.parametrize(("page", "text"), [
    ("a<![foo[ x", "a"),
    ("<p>a</p><![ 1 ]>b", "a\n\nb"),
    ("a<![if !IE]>b<![endif]>c", "abc"),
    ("<![CDATA[x]]>y", "y"),
    ("a<!-- b", "a"),
    ("a<!", "a"),
    ("<!doctype html>a<!-- c -->b", "ab"),
    ("<table>" * 600 + "x", "x"),
    ("<table><tr><form><td>cell</table>", "cell"),
    ("<table><form><tr><td>a<td>b</form></table>", "a | b"),
    ("<table><tr>loose<td>x</table>", "x\nloose"),
    ("<table><tbody>loose<tr><td>x</table>", "x\nloose"),
    ("<svg><text>in a drawing</text></svg>", "in a drawing"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
    ("<p>a <textarea>b &amp; c</textarea>", "a\nb & c"),
    ("<math><mi>x</mi></math><datalist><option>y</datalist><script>z</script>", "x"),
])
def test_cases(page, text):
    assert html.extract_text(page) == text


PARTS = [
    "<table>", "<tr>", "<td>", "<th>", "<form>", "</form>", "</table>", "<![", "[", "<!--", "-->", "<!", "x", "<p>", "</p>",
    "<li>", "<ul>", "</ul>", "<svg>", "<select>", "<option>", "&amp;", "&#", "&#x110000;", "<", ">", '"', "</td>", "<br>",
    "<pre>", "]]>", "<?", '<a href="', "\x00", "<script>", "</script>", "<textarea>", "<title>", "<caption>", "</", "é",
]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60))
def test_no_markup_fails(parts):
    html.extract_text("".join(parts))


def tree():
    """Markup in which all words are visible, whatever stands where."""
    word = st.just("W")
    tags = st.sampled_from([
        "div", "p", "span", "b", "ul", "li", "ol", "table", "tbody", "tr", "td", "th", "form", "section", "h1", "select",
        "option", "svg", "blockquote", "dl", "dd", "dt", "caption", "a",
    ])
    node = lambda inner: st.builds(
        lambda tag, children, closed: f"<{tag}>{' '.join(children)}" + (f"</{tag}>" if closed else ""),
        tags, st.lists(inner, max_size=4), st.booleans(),
    )
    return st.recursive(word, node, max_leaves=25)


@settings(max_examples=800, deadline=None)
@given(tree())
def test_every_visible_word_is_there_once(page):
    n = page.count("W")
    numbers = iter(range(n))
    page = "".join(f"W{next(numbers)}." if c == "W" else c for c in page)
    text = html.extract_text(page)
    assert all(text.count(f"W{i}.") == 1 for i in range(n)), (page, text)


def test_pages_that_fail_are_told_and_do_not_stop_others(spark, monkeypatch):
    empty = spark.createDataFrame([], "page_id int, html string, problem int")
    assert html.extract(empty).count() == 0
    rows = spark.createDataFrame([(1, "<![foo[ x"), (2, None), (3, "<b>x</b>" * 3)], "page_id int, html string")
    got = {r["page_id"]: (r["extracted"]["text"], r["extracted"]["problem"]) for r in html.extract(rows).collect()}
    assert got == {1: ("", None), 2: ("", None), 3: ("xxx", None)}
