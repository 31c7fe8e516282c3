import re

import pytest

from privtrace.llm import html_text as op
from privtrace.llm import url_filter as urls


def page(i, body="", tail="</body></html>"):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    para = lambda k: " ".join(words[(i + k * j) % 6] for j in range(12 + (i * k) % 40))
    return (f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>'
            f'{"".join(f"<li><a href=/{w}>{w}</a></li>" for w in words[:2 + i % 4])}</ul></nav><div class="ad">{para(1)[:40]}</div>'
            f'<article><h1>{para(2)[:30]}</h1><p><b>{para(3)}</b><br><p>{para(4)} &amp; more</p>{body}<p>{para(5)}</p></article><footer>&copy; {para(6)[:30]}</footer>{tail}')


def wanted(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    return "\n".join(x for x in (" ".join(re.sub(r"<[^>]*>", "", b).replace("&amp;", "&").split()) for b in blocks) if x)


@pytest.fixture(scope="module")
def model():
    return op.train([page(i) for i in range(60)])


def test_articles(model):
    for i in range(60, 100):
        for tail in ("</body></html>", ""):
            assert op.extract([page(i, tail=tail)], model) == [wanted(page(i))]


def test_boilerplate_inside_the_article_goes(model):
    for box in ('<div class="share">Share this now</div>', '<aside><p>Sidebar words beside it all</p></aside>', '<form><label>Mail</label><button>Go</button></form>',
                '<section class="comments"><div class="comment"><p>I like it very much indeed</p></div></section>', '<nav><a href=x>next</a></nav>'):
        assert op.extract([page(7, box)], model) == [wanted(page(7))], box


def test_broken_and_empty_pages(model):
    assert op.extract(["", "   ", "<!-- x", "<script>a", "<p"], model)[:4] == ["", "", "", ""]
    assert op.extract(["<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000], model)[0] in ("deep", "")
    assert "1 < 2 & 3" in op.extract([page(9, "<p>1 &lt; 2 &amp 3 of the words that follow here</p>")], model)[0]


def test_decoding_never_contradicts(model):
    import numpy as np
    root = op.parse(page(3))
    listed = op.settle(root)
    rng = np.random.default_rng(1)
    for _ in range(30):
        kept, dropped = op.decode(listed, rng.normal(0, 3, len(listed)))
        place = {id(n) for n, _, _ in listed}
        for n, _, _ in listed:
            up = n.parent
            while up is not None and id(up) not in place:
                up = up.parent
            assert not (id(n) in kept and up is not None and id(up) in dropped)


def test_rows(spark):
    rows = [(i, f"http://x/{i}", page(i)) for i in range(30)] + [(30, None, None), (31, "u", ""), (None, "u", page(2)), (31, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "1 AS n_chars")
    got = op.main_text(df).collect()
    assert sorted((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in got) == sorted(
        (i or (-1 if i is None else 0) or -1, u or "", wanted(h) if h else "", len(wanted(h)) if h else 0) for i, u, h in rows)
    assert op.main_text(df.limit(0)).collect() == []


def test_url_rules_and_verdicts(spark):
    cases = {
        "https://a.net/x": ("net/", "block"), "https://example.net/en/1": ("example.net/en/", "allow"), "https://m.example.net/en/1?q": ("example.net/en/", "allow"),
        "https://badexample.net/en/": ("net/", "block"), "HTTP://WWW.Example.COM/de/9#t": ("example.com/de/", "block"), "http://q.org/fr/": ("org/fr/", "allow"),
        "http://q.org/FR/": (None, None), "http://a.net": (None, None), "http://a.net?x": (None, None), "no scheme": (None, None), None: (None, None), "": (None, None),
        "://": (None, None), "x://http://y.net/": (None, None), "http://net/": ("net/", "block"), "http://xnet/": (None, None)}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").selectExpr("*", "'z' AS rule", "'z' AS host")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    for i, (u, (rule, verdict)) in enumerate(cases.items()):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.filter_urls(df.limit(0)).collect() == []


def test_url_model_fits_its_table(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls.LABELLED)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, rules=()).collect()}
    right = sum((got[i] == "block") == bool(y) for i, (_, y) in enumerate(urls.LABELLED))
    assert right >= 0.95 * len(urls.LABELLED)
    new = spark.createDataFrame([(0, "http://best-casino.example/free-spins/win"), (1, "https://www.example.com/en/77.html")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(new).collect()} == {0: "block", 1: "allow"}


def test_heads_without_end_tag(model):
    full = page(11)
    for cut in (full.replace("</head>", ""), full.replace("</head><body>", ""), full.replace("</head><body>", "<head>"),
                full.replace("</head>", "<noscript><img src=x><p>Switch scripts on</p></noscript>")):
        assert op.extract([cut], model) == [wanted(full)]
    assert "loose words" in op.render(op.parse("<head><title>T</title>loose words<p>more"), set())


def test_raw_elements_end_at_their_end_tag(model):
    for box in ("<noscript><p>Switch scripts on</noscript>", "<template><div><p>Not shown</template>", "<noscript><ul><li>Not shown</noscript>"):
        assert op.extract([page(7, box)], model) == [wanted(page(7))], box


def test_embedded_elements_keep_their_text(model):
    for tag in ("math", "svg", "object", "canvas"):
        html = page(8, f"<p>alpha beta gamma delta <{tag}>omega</{tag}> sigma alpha beta gamma delta</p>")
        assert op.extract([html], model) == [wanted(html)], tag
        assert "omega" in wanted(html)
