import html as H
import re

import pytest

from tremorlake.llm import templates


def truth(page):
    """The article of a page whose only containers are those of the made pages."""
    body = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", re.sub(r"(?s)<script.*?</script>", "", page or ""))
    if not body:
        return ""
    x = re.sub(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", "\n", body[1])
    return " ".join(H.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", x)).split())


def page(i, body, host="a.example"):
    return (i, f"https://{host}/{i}", f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t="</p><article>x";</script></head><body><nav><ul><li><a href="/x">menu {i}</a></li></ul></nav><!-- c > --><div class="ad">buy {i}</div><article><h1>Head {i}</h1>{body}</article><div id="comments">me too {i}</div><form>name</form><footer>&copy; {i}</footer></body></html>')


ROWS = [page(i, f"<p><b>One&amp;two {i}<br><p>in<i>line</i> &lt;tag&gt;&nbsp;end\n\n x</p>") for i in range(6)] + [page(9, "<p>alone", "b.example"), (10, None, None), (11, "no address", ""), (12, "http://c.example", "plain text only"), page(13, "<p>cut &amp; off</p><di", "a.example")]


def test_pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = {r.page_id: r for r in templates.extract(df).collect()}
    for i, url, h in ROWS:
        want = {10: "", 11: "", 12: "plain text only", 13: "Head 13 cut & off"}.get(i, truth(h))
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), url)
    assert templates.extract(df.limit(0)).count() == 0


def test_unnamed_template(spark, monkeypatch):
    made = lambda i, text: f'<html><body><div class="a1"><a href="/">Home</a> <a href="/n">News of the day and more</a></div><div class="b2"><p>{text}</p><p>{text[::-1]}</p></div><div class="c3">Same words on every page</div></body></html>'
    rows = [(i, f"http://t.example/{i}", made(i, f"long story number {i} " * 20)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: " ".join(f"{t} {t[::-1]}".split()) for i in range(8) for t in [f"long story number {i} " * 20]}
    for size in (1 << 20, -1):
        monkeypatch.setattr(templates, "BROADCAST_BYTES", size)
        assert {r.page_id: r.text for r in templates.extract(df).collect()} == want


@pytest.mark.parametrize("raw,text", [("<p>a<b>b</b>c</p>d", "abc d"), ("<p>a &amp;amp; b &#233; &bogus; 5 < 6 <3", "a &amp; b é &bogus; 5 < 6 <3"), ("<div class='Cookie-Notice'>x</div>y", "y"), ("<ARTICLE>a<aside>b</aside>c<div class=comments>d</div></ARTICLE>e", "a c"), ("<textarea><p>x</textarea>y<script>z", "y"), ("a<!-- b -->c<!d>e<?f?>g", "aceg"), ("<header>top</header><main><header><h1>T</h1></header>x</main>", "T x"), ("x" * 200_000 + "<p>" * 20_000, "x" * 200_000), ("<div>" * 60_000 + "deep" + "</p></nav>" * 50_000, "deep"), ('<a href="x>y">z</a>', "z"), ("<article><div class='post-header'><h1>T</h1></div><p class='ad'>x<b>y</b><p>keep <span class=share-count>9<span>8</span>7</span> on</p><ul><li class=comment>c<li>d</ul><p id=promo>e</article>", "T keep on d"), ("<p class='lead'>a</p><p class=cookie>b</p><div>c</div>", "a c"), ("<p class=ad>x<div>y</div>", "y"), ("<img class=ad>t<br class=ad>u", "t u")])
def test_parsing(raw, text):
    assert templates.main_text(raw) == text


def test_same_text_on_all_pages_is_template(spark):
    def page(k, layout="a"):
        told = " ".join(f"story{k}x{j}" for j in range(12))
        always = f"written by the {layout} desk for all our readers every day"
        return f'<html><body><div class="{layout}"><div class="story">{told}</div><div class="box">{always}</div></div></body></html>', told

    made = [(k, *page(k)) for k in range(8)] + [(20 + k, *page(20 + k, "b")) for k in range(3)]
    rows = [(k, f"http://h.org/{k}", p) for k, p, _ in made]
    # copies of one page tell nothing of its template
    rows += [(50 + k, f"http://copies.org/{k}", made[0][1]) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in templates.extract(df).collect()}
    assert {k: got[k] for k, *_ in made} == {k: told for k, _, told in made}
    assert all("desk" in got[50 + k] and "story0x0" in got[50 + k] for k in range(4))


def plain(i, body, title="t"):
    """A page without names: two lists of links, a story and boxes of words that vary in part."""
    return f'<html><body><div class="qa"><a href="/">Start</a> <a href="/all">All of our stories</a></div><div class="qb"><p>{body}</p></div><div class="qc">Printed by the same people</div><div class="qd">Page {title} of many</div></body></html>'


def story(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_classes_against_brute_force(spark):
    import random
    from collections import defaultdict

    r = random.Random(8)
    pages = []
    for i in range(40):
        body = story(r, 30) if i % 3 else "".join(f"<ul><li>{story(r, 5)}<li>more</ul>" for _ in range(1 + i % 4))
        pages.append((f"http://h{i % 3}.org/{i}", plain(i, body, str(i))))
    pages += [pages[0], pages[1]] * 2  # repeated rows
    df = spark.createDataFrame(pages, "url string, html string").repartition(4)
    got = defaultdict(set)
    for x in templates.classes(templates.occurrences(df)).collect():
        got[x.host, x["class"]].add((x.kind, x.token))
    want = set()
    for host in {templates.host_of(u) for u, _ in pages}:
        read = [templates.page_tokens(h) for u, h in pages if templates.host_of(u) == host]
        vectors = defaultdict(set)
        for t in {t for _, tokens in read for t in tokens}:
            vector = tuple(tokens.get(t, [0, 0])[1] for _, tokens in read)
            if len({text for (text, _), n in zip(read, vector) if n}) >= templates.MIN_PAGES:
                vectors[vector].add(t)
        want |= {(host, frozenset(c)) for c in vectors.values() if len(c) >= templates.MIN_TOKENS}
    assert {(h, frozenset(c)) for (h, _), c in got.items()} == want and len(want) > 3


def test_tokens_out_of_order_or_crossing_are_no_class(spark):
    # two boxes change places from page to page: they are not ordered, so they are data
    def page(k):
        boxes = ['<div class="one">always one thing</div>', '<div class="two">always another thing</div>']
        return f'<html><body><div class="s">{" ".join(f"w{k}x{j}" for j in range(9))}</div>{"".join(boxes[:: 1 if k % 2 else -1])}</body></html>'

    df = spark.createDataFrame([(f"http://o.org/{k}", page(k)) for k in range(12)], "url string, html string")
    fixed = {x.token for x in templates.classes(templates.occurrences(df)).collect() if x.kind == templates.BLOCK}
    low, high = (f(range(12), key=lambda k: templates.page_tokens(page(k))[0] >> 1) for f in (min, max))
    assert len(fixed) == (2 if low % 2 == high % 2 else 1 if fixed else 0)


def test_template_decides_where_nothing_is_named(spark):
    import random

    r = random.Random(9)
    bodies = [story(r, 60) for _ in range(6)]
    rows = [(i, "http://n.org/a", plain(i, b, str(i))) for i, b in enumerate(bodies)] * 2
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((x.page_id, x.text) for x in got) == sorted((i, b) for i, b in enumerate(bodies) for _ in range(2))
    assert all(templates.main_text(h) != b for (_, _, h), b in zip(rows, bodies))


def test_template_words_go_where_no_slot_stands_out(spark):
    # layouts of equal halves have no main slot
    import random

    r = random.Random(10)
    made = [(story(r, 20), story(r, 20)) for _ in range(5)]
    page = lambda i, a, b: f'<html><body><div class="u"><p>{a}</p></div><div class="v"><p>{b}</p></div><div class="w">This is page {i} of the whole book</div></body></html>'
    rows = [(i, "http://m.org/", page(i, a, b)) for i, (a, b) in enumerate(made)]
    got = {x.page_id: x.text for x in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{a} {b}" for i, (a, b) in enumerate(made)}


@pytest.mark.parametrize("page", ['<article><div class="elementor-widget elementor-widget-text-editor"><p>kept</p></div></article>', '<main><section class="share-price-report">kept</section></main>', '<main><div class="alert-level-history">kept</div></main>', '<article><div class="widget">kept</div></article>'])
def test_names_do_not_empty_an_article(spark, page):
    assert templates.main_text(f"<html><body><nav>menu</nav>{page}<footer>end</footer></body></html>") == "kept"
    rows = [(i, f"http://w.org/{i}", page.replace("kept", f"kept {i} {'x' * i}")) for i in range(6)]
    got = {x.page_id: x.text for x in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"kept {i} {'x' * i}".strip() for i in range(6)}
