"""Page layout on odd markup: what a browser shows stays, in linear time and size."""

from __future__ import annotations

import time

import pytest

from offerloom.llm.page_layout import page_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p style="backface-visibility:hidden">shown</p>', "shown"),
        ('<p style="color:red; visibility : hidden">gone</p>here', "here"),
        ("<a href=foo title=it's>Link text</a> and they don't stop here", "Link text and they don't stop here"),
        ('<p class="x>Hello', "Hello"),
        ('<p title="a > b">kept</p>', "kept"),
        ("<iframe src=x>no frames</iframe>after", "after"),
        ('<div style="visibility:hidden">a<b style="visibility:visible">b</b>c</div>d', "b\nd"),
        ('<table style="visibility:hidden"><tr><td>a<td style="visibility:visible">b</table>', "  b"),
        ("<![CDATA[raw]]> text <![CDATA[ open", "raw text open"),
        ("done <b", "done"),
    ],
)
def test_visible_text(page, text):
    assert page_text(page) == text


def test_a_wide_cell_does_not_pad_the_others():
    page = "<table><tr><td>" + "x" * 20_000 + "<td>y</tr>" + "<tr><td>a<td>b</tr>" * 1000 + "</table>"
    text = page_text(page)
    assert len(text) < 2 * len(page) and text.count("\n") == 1000
    aligned = page_text("<table><tr><td>long name<td>1</tr><tr><td>b<td>22</tr></table>")
    assert aligned == "long name  1\nb          22"


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000,
        "<![CDATA[" * 100_000,
        "<p><button>" + "<div>" * 50_000,
        "<b>" * 50_000 + "</i>" * 50_000,
        '<p a="' * 20_000,
        "<p><table>" * 5_000,
        "<!--" * 50_000,
    ],
)
def test_time_grows_with_the_page(page):
    start = time.process_time()
    page_text(page)
    assert time.process_time() - start < 4
