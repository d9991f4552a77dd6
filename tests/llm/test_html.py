from __future__ import annotations

import numpy as np
import pytest

from runlens.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
{body}<aside>Side</aside><div id="sidebar">More</div><form><p>Mail</p><input value="x"></form><section id="comments"><article class="comment"><p>Nice!</p></article></section>
<div class="ad">Buy</div><footer>&copy; 2024</footer></body></html>"""


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("just text", "just text"),
        (PAGE.format(body="<article><h1>Head&amp;line</h1><p>One\n  <b>bo</b>ld&nbsp;two.</p><div class='ad-box'>Ad</div><p>a &lt; b<br>c</p><ul><li>x<li>y</ul></article>"), "Head&line\nOne bold two.\na < b\nc\nx\ny"),
        (PAGE.format(body="<main><p>Only main</p><p class=share>Share me</p></main><p>outside</p>"), "Only main"),
        (PAGE.format(body="<div class='post-content'><p>In content</p></div><p>loose</p>"), "In content"),
        (PAGE.format(body="<p>loose one</p><p>loose two</p>"), "loose one\nloose two"),
        ("<article><p>open <b>never closed<p>next", "open never closed\nnext"), ("<article>5 < 6 and <3 <!-- c --> x<!-- never", "5 < 6 and <3 x"),
        ("<article><p title='a > b' data-x=\"<p>\">q</p><script>alert('<p>')</script><p>r</p></article>", "q\nr"),
        ("<form id=all><nav>n</nav><article><p>inside a form</p></article></form>", "inside a form"), ("<p>&#233;&eacute;&#x1F600; &unknown; &amp</p>", "éé😀 &unknown; &"),
        ("<div hidden>h</div><div style='display: none'>s</div><div aria-hidden=true>a</div><p>seen</p>", "seen"), ("<table><tr><td>a</td><td>b</td></tr></table>", "a\nb"),
        ("<main><h1>Title</h1><p>" + "a long body of text " * 20 + "</p><article class=card><p>A card</p></article></main>", "Title\n" + ("a long body of text " * 20).strip() + "\nA card"),
        ("<main><h2>More</h2><article><p>" + "the article " * 20 + "</p></article></main>", ("the article " * 20).strip()),
        ("<article><p>a</p><p class='legal-notice'>b</p><section class=social-history>c</section><div class=ad-hoc>d</div><div class='ad-slot-3'>e</div><p class='share links'>f</p></article>", "a\nb\nc\nd"),
        ("<article><p>x <math><mi>y</mi></math> <noscript>n</noscript><object>o</object><svg><text>s</text></svg></p></article>", "x y nos"),
        ("<article><i>a<b>b</i>c</b>d</i></article>", "abcd"), ("</div></article><p>t</p></p></x>", "t"),
        ("<div class=menu>all of it is a menu</div>", "all of it is a menu"),
        ("<article><header><h1>Head</h1><p>by <b>N</b></p><nav><h2>menu</h2></nav></header><p>t</p></article>", "Head\nt"),
    ],
)
def test_structure(spark, html, want):
    declared, open_ = H.structure(html)
    assert (declared if declared is not None else "\n".join(open_)) == want


@pytest.mark.parametrize("piece", ["<svg>", "<select>", "<i>", "<div><b>", "</x>", "<i></b>", "<a x='", "<!-", "<p class=ad>"])
def test_time_grows_with_length(piece):
    import time

    times = []
    for n in (20_000, 160_000):
        page = "<article>body</article><q>" + piece * n + "</q>"
        start = time.perf_counter()
        assert H.structure(page)[0] is None or "body" in H.structure(page)[0]
        times.append(time.perf_counter() - start)
    assert times[1] < 30 * times[0] + 1


def test_host_and_runs(spark):
    urls = {"http://A.example.com/x": "a.example.com", "https://u:p@b.example:8080?q": "b.example", "nonsense": "", None: ""}
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", H.host("url").alias("h")).collect()
    assert {r["url"]: r["h"] for r in got} == urls
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 3, n) for n in (30, 5, 0, 60, 8)]
    stream, place, rank = H.run_codes(streams, 6)
    seen: dict = {}
    for s, p, r in zip(stream, place, rank, strict=True):
        assert seen.setdefault(int(r), tuple(streams[s][p : p + 6])) == tuple(streams[s][p : p + 6])
    assert len(set(seen.values())) == len(seen) and len(stream) == sum(max(0, len(x) - 5) for x in streams)


@pytest.mark.parametrize("shard", [40, 200_000])
def test_boilerplate_of_a_host(spark, shard):
    menu, foot = "Home About Products Services Support Contact Login Register", "All rights of this site are with the company named above"
    rows = [(i, f"http://h.example/{i}", f"<p>{menu}</p><p>{' '.join(f'own{i}x{j}' for j in range(12))}</p><p>{foot}</p>") for i in range(6)]
    rows += [(10 + i, "http://other.example/", f"<p>{menu}</p><p>other {i}</p>") for i in range(2)]  # too few pages there
    rows += [(20, None, f"<p>{menu}</p>"), (21, "http://h.example/a", f"<article><p>{menu}</p></article>"), (22, "http://h.example/n", None), (0, rows[0][1], rows[0][2])]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as text").repartition(4), shard=shard).collect()
    text = sorted((r["page_id"], r["text"]) for r in got)
    want = [(i, " ".join(f"own{i}x{j}" for j in range(12))) for i in (0, *range(6))] + [(10, f"{menu}\nother 0"), (11, f"{menu}\nother 1"), (20, menu), (21, menu), (22, "")]
    assert text == sorted(want) and all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize("shard", [60, 200_000])
def test_open_pages_meet_all_pages(spark, shard):
    foot, quote = "All rights of this site are with the company named above", "a passage of ten words that many other articles quote"
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(12))
    rows = [(i, "http://h.example/", f"<article><p>{own(i)}</p><p>{quote}</p></article><footer>{foot}</footer>") for i in range(4)]
    rows += [(9, "http://h.example/", f"<nav>{own(9)}</nav><p>{own(10)}</p><p>{foot}</p>")]  # the only open page of its host
    rows += [(20 + i, "http://h.example/", f"<article><p>{own(20 + i)}</p><p>{foot}</p></article>") for i in range(3)]  # declared text is protected
    rows += [(30, "http://h.example/", f"<p>{own(30)}</p><p>{quote}</p>")]  # as a run of declared text elsewhere
    rows += [(40, "http://other.example/", f"<article><p>{own(40)}</p><p>{foot}</p></article>")]
    rows += [(50 + i, "http://third.example/", f"<article><p>{own(50 + i)}</p></article><aside>{own(50)}</aside>") for i in range(4)]  # a teaser of an article
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), shard=shard).collect()}
    want = {i: f"{own(i)}\n{quote}" for i in range(4)} | {9: own(10)} | {i: own(i) for i in (30, *range(50, 54))} | {i: f"{own(i)}\n{foot}" for i in (20, 21, 22, 40)}
    assert got == want


def test_empty(spark):
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
