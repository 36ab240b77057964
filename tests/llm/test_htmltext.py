import random
import time

from tokenframe.llm import htmltext as X

P = "A long enough paragraph of running text about nothing in particular, one of several in this page."


def test_article_page():
    page = f"""<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/">Home</a></ul></nav>
    <!-- ad > --><div class="ad">Buy</div><article><h1>Short</h1><p><b>{P}<br><p>Tiny.</p><p>a &amp;amp &lt;b&gt;&nbsp;&#233;
     c</p><aside>See also</aside><div id="comments"><p>{P}</p></div></article><footer>&copy; x</footer></body></html>"""
    assert X.main_text(page) == f"Short\n{P}\nTiny.\na &amp <b> é c"


def test_page_without_article():
    page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><div class='cookie-notice'>{P}</div><h1>Title</h1><p>{P}<p>Brief.<p>{P}</p><form><p>{P}</p></form><div><a href=3>{P}</a></div></body>"
    assert X.main_text(page) == f"Title\n{P}\nBrief.\n{P}"


def test_odd_pages(spark):
    assert [X.main_text(x) for x in ("", "   ", "<p></p>", "<script>alert(1)", "<!-- open", "<nav>menu</nav>")] == [""] * 6
    assert X.main_text("plain words") == "plain words"
    assert X.main_text("<p title='a>b' x=\"'\">one <i>two</i></p><p bad=\"open>three</p>").startswith("one two")
    rows = [(1, "u", None, "c"), (2, None, f"<p>{P}</p>", "c"), (2, None, f"<p>{P}</p>", "c"), (None, "u", "<p>" * 20000 + "deep", "c")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in X.texts(d).collect())
    assert got == [(0, "deep", 4), (1, "", 0), (2, P, len(P)), (2, P, len(P))]
    assert X.texts(d.limit(0)).count() == 0


def links(n, start=0):
    return "<ul>" + "".join(f"<li><a href='/{i}'>Another story number {i}</a></li>" for i in range(start, start + n)) + "</ul>"


def test_windows_decide_in_an_article():
    page = f"<article><h1>Title</h1>{links(4)}<p>Short start.</p><p>{P}</p><p><a href=1>{P}</a></p><p>Tiny.</p><h2>See also</h2>{links(5)}<p>Tags</p>{links(3)}<h2>More</h2><p>{P}</p><p>End</p></article>"
    assert X.main_text(page) == f"Title\nShort start.\n{P}\n{P}\nTiny.\nMore\n{P}\nEnd"
    page = f"<article><p>{P}</p><div class='ad'><p>a</p><p>b</p><p>c</p></div><p>Last</p></article>"
    assert X.main_text(page) == f"{P}\nLast", "adverts leave no gap"
    assert X.main_text("<article><p>Brief</p></article>") == "Brief"


def test_windows_decide_without_an_article():
    page = f"<div>Menu</div><div>Shop</div><div>Cart</div>{links(3)}<h1>Title</h1>{links(2)}<p>{P}</p><p>Tiny</p><div><a href=1>{P}</a></div><p>{P}</p>{links(3)}<div>Imprint</div>"
    assert X.main_text(page) == f"Title\n{P}\nTiny\n{P}"
    assert X.main_text(f"<h1>Title</h1>{links(9)}<p>{P}</p>") == f"Title\n{P}"


def brute_lines(lines, window, surge):
    """Regions by looking at each window anew, for lines without headings or an article."""
    size = [0 if 2 * x.links > len(x.text) else len(x.text) for x in lines]
    total = lambda i: sum(size[k] for k in range(i, min(i + window, len(size))))
    least = max(1, min(surge, max(map(total, range(len(size))), default=0)))
    out, on = [], False
    for i in range(len(size)):
        on = total(i) > 0 and (on or total(i) >= least)
        if on and size[i]:
            out.append(i)
    return out


def test_regions_against_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        lines = [X.Line("x" * n, n * rng.choice([0, 0, 1]), False, 0) for n in (rng.choice([1, 5, 20, 60, 100]) for _ in range(rng.randint(0, 30)))]
        window, surge = rng.randint(1, 4), rng.choice([10, 80, 1000])
        assert X.main_lines(lines, window, surge) == brute_lines(lines, window, surge)


def test_long_and_nested_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<i>" * 20000 + "<p>x" * 20000, "<div>" * 20000 + "</q>" * 20000, "<a href='" * 20000, '<div a="x' * 20000, f"<p>{P}</p>" * 20000):
        X.main_text(page)
    assert time.perf_counter() - began < 20


def test_parts_inside_a_block_and_odd_markup():
    assert X.main_text(f"<article><p>{P} <span class='ad'>Buy</span> end</p></article>") == f"{P} end"
    assert X.main_text(f"<svg/><p>{P}</p>") == P
    assert X.main_text(f"<head><title>t</title><style>p</style><p>{P}") == P
    assert X.main_text(f"<script>x = '<a title=\"'</script><p>{P}</p>") == P
