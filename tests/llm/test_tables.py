"""Search, mixing, archives and page text: exact results on small tables."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from offerloom.llm import warc_archive
from offerloom.llm.fair_mix import mixed, schedule, whole_weights
from offerloom.llm.page_layout import extracted, page_text
from offerloom.llm.pivot_search import top_k
from offerloom.llm.warc_archive import digest, read_archives, read_records, write_archives

VECTORS = "vec_id long, embedding array<float>, pivot int"


def brute(rows, k):
    whole = {}
    for i, x, _ in rows:
        if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            whole[i] = [math.floor(1024 * float(np.float32(v))) for v in x]
    out = set()
    for q in (i for i in whole if i % 100 == 0):
        dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
        best = sorted((-dot(whole[q], x), i) for i, x in whole.items() if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr("offerloom.llm.pivot_search.BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    data = np.round(rng.normal(size=(600, 8)), 2)
    data[50:150] = data[0]
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(data)]
    rows[7], rows[8], rows[100] = (7, None, 1), (8, [1.0, None], 1), (100, [float("nan")] * 8, 1)
    rows[9], rows[10] = (9, [math.inf] * 8, 1), (10, [5.0, 5.0], 1)
    rows.append((None, [1.0] * 8, 1))
    got = {tuple(r) for r in top_k(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == brute(rows, 10)


def test_top_k_of_few_rows(spark):
    assert top_k(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(0, [1.0], 1), (1, [2.0], 1), (2, [2.0], 1)]
    assert {tuple(r) for r in top_k(spark.createDataFrame(rows, VECTORS)).collect()} == {(0, 1, 1, 1 << 21), (0, 2, 2, 1 << 21)}
    assert top_k(spark.createDataFrame([(5, None, 1)], VECTORS)).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 700, "b": 290, "c": 7, "d": 3}, {str(i): i + 1 for i in range(40)}])
def test_schedule_stays_within_one_block(weights):
    slots = whole_weights(weights)
    period = sum(slots.values())
    had = Counter()
    for name, k, release, deadline, slot in schedule(slots):
        assert release <= slot < deadline and k == had[name]
        had[name] += 1
        assert all(abs(had[n] - (slot + 1) * s / period) < 1 for n, s in slots.items())


def test_mix_places_every_row_once(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", i) for i in range(3000)] + [(None, None, 1), (5, "hot", 2), (5, "hot", 2)]
    got = mixed(spark.createDataFrame(rows, "doc_id long, source string, name int"), block_docs=4).collect()
    assert len(got) == len(rows) == len({r.mix.position for r in got})
    assert all(r.mix.release <= r.mix.slot < r.mix.deadline for r in got)
    sizes = Counter((r.source, r.mix.block) for r in got)
    last = {s: max(b for x, b in sizes if x == s) for s, _ in sizes}
    assert all(n == 4 for (s, b), n in sizes.items() if b != last[s])
    assert mixed(spark.createDataFrame([], "doc_id long, source string")).count() == 0


PAGES = "page_id long, url string, html string, sha string"


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("offerloom.llm.warc_archive.FILE_BYTES", 20_000)
    pages = [(i, f"http://x/{i}", f"<p>page {i} ü\r\n\r\n{'text ' * i}</p>", "k") for i in range(60)]
    pages += [(70, "u", pages[3][2], "k"), (2, None, pages[3][2], "k"), (71, None, None, None), (72, "", "", None), (None, "n", "<b>", "k")]
    pages += [(73, "big", "y" * 3_000_000, "k")]
    path = f"{tmp_path}/archives"
    write_archives(spark.createDataFrame(pages, PAGES), path)
    payload = {i: (h or "").encode() for i, _, h, _ in pages}
    got = sorted(read_archives(spark, path).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    assert len(got) == len(pages)
    first = {}
    for i, _, h, _ in pages:
        if i is not None:
            first[(h or "").encode()] = min(first.get((h or "").encode(), i), i)
    for (i, url, html, _), r in zip(sorted(pages, key=lambda p: (p[0] is None, p[0] or 0, len((p[2] or "").encode()))), got, strict=True):
        raw = (html or "").encode()
        refers = None if i is None or first[raw] == i else first[raw]
        assert (r.page_id, r.payload_bytes, r.payload_digest, r.url) == (i, len(raw), digest(raw), url or "")
        assert (r.record_type, r.refers_to) == (("revisit", refers) if refers is not None else ("response", None))
        assert r.payload == (raw if refers is None else None)
    assert payload


def test_broken_archives_are_errors(spark, tmp_path):
    path = f"{tmp_path}/archives"
    write_archives(spark.createDataFrame([(1, "u", "hello " * 500, None)], PAGES), path)
    file = next(p for p in __import__("pathlib").Path(path).iterdir() if p.name.startswith("part"))
    content = file.read_bytes()
    assert int.from_bytes(content[:4], "little") == warc_archive.SKIPPABLE_DICTIONARY
    assert [h["WARC-Type"] for h, _ in read_records(content)] == ["response"]
    with pytest.raises(Exception):  # noqa: B017
        list(read_records(b"abcdefgh"))
    write_archives(spark.createDataFrame([], PAGES), f"{tmp_path}/none")
    assert read_archives(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b<br>c", "a\n\nb\nc"),
        ("x <b>y</b>\n z<script>no</script><!-- no --> &amp; &uuml;", "x y z & ü"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
        ("<table><tr><th>Name<th>Qty<tr><td>fig<td>3<tr><td>banana<td>10</table>", "Name    Qty\nfig     3\nbanana  10"),
        ("<pre>\n a\n  b\n</pre>c", " a\n  b\n\nc"),
        ("<div hidden>n</div><p style='display: none'>n</p><details><summary>s</summary>n</details>k", "s\nk"),
        ("<head><title>t</title></head>body <textarea>a<b></textarea>", "body a<b>"),
        ("<a title='>'>x</a <b>y", "xy"),
        ("1 < 2 <3", "1 < 2 <3"),
        ("<dl><dt>t<dd>d</dl><h1>h</h1>i", "t\n  d\n\nh\n\ni"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<table><tr><td>" * 60 + "deep", "deep"),
        ("", ""),
    ],
)
def test_layout(page, text):
    assert page_text(page) == text


def test_layout_of_a_table(spark):
    rows = spark.createDataFrame([(1, None, "old"), (2, "<p>x", None), (2, "<p>x", None)], "page_id long, html string, text string")
    assert [(r.page_id, r.text) for r in extracted(rows).orderBy("page_id").collect()] == [(1, ""), (2, "x"), (2, "x")]
    assert extracted(rows.limit(0)).count() == 0
