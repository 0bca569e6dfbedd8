import html as references
import random
import re

from pyspark.sql import functions as F

from rankloom.llm import wrappers
from rankloom.llm.wrappers import Wrapper, _Node, expression, extract, infer, merged, parse


def wrapper(pages):
    held = expression(parse(pages[0]))
    for page in pages[1:]:
        held = merged(held, expression(parse(page)), 0)
    return held


def test_tables_articles(spark):
    """All pages of the table against the blocks of their article element."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def plainly(page):
        body = re.search("<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(references.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        return "\n\n".join(x for x in blocks if x)

    got = extract(pages).collect()
    assert len(got) == pages.count() and all(r.text == plainly(r.html) for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
<body class="has-sidebar comments"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li>More</ul></nav>
<div class="cookie-notice">We use cookies</div><article class="post"><header><h2>Title %(k)s</h2><p>by me</p></header>
<p>First <b>bold</b>&nbsp;text &lt;b&gt; &amp;amp;<br>next line<p>Second<i>joined</i>%(more)s</p>
<div class='ad-slot "x'>Buy</div><form><input name=q>Search</form><aside>Side</aside><ul><li>one<li>two</ul>
<table><tr><td>c1<td>c2</table><section id=comments><article class="comment"><p>Nice!</p></article></section></article>
<div class="sidebar">Links</div><footer>&copy; us</footer>"""
TEXT = "Title %(k)s\n\nby me\n\nFirst bold text <b> &amp; next line\n\nSecondjoined%(more)s\n\none\n\ntwo\n\nc1\n\nc2"


def test_parts_of_a_page():
    pages = [PAGE % {"k": k, "more": " extra" * k} for k in range(4)]
    found = Wrapper(wrapper(pages), 4)
    assert [found.text(p) for p in pages] == [TEXT % {"k": k, "more": " extra" * k} for k in range(4)]


def test_without_article_the_densest_part():
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["oak", "elm", "fir", "ash"]) for _ in range(n))
    bodies = [f"<h1>{words(3)}</h1><p>{words(50)}</p><p>{words(60)}</p>" for _ in range(6)]
    pages = [f"<body><div id=top><a href=/>Home</a> of all trees</div><div><div>{b}<p>Write to us</p></div></div><div class=footer>End</div>" for b in bodies]
    found = Wrapper(wrapper(pages), len(pages))
    for page, body in zip(pages, bodies, strict=True):
        want = [x for x in re.split("</?[hp]1?>", body) if x]
        assert found.text(page).split("\n\n") == [*want, "Write to us"]
    # one container less: what the pages share beside their text is the template's
    flat = [f"<body><b>Welcome</b><div>Same on all</div>{b}" for b in bodies]
    found = Wrapper(wrapper(flat), len(flat))
    assert all("Same" not in found.text(p) and "Welcome" not in found.text(p) and found.text(p).count("\n\n") == 2 for p in flat)


def test_expressions_are_folded_and_accept_their_pages():
    def shown(item):
        inside = " ".join(map(shown, item[wrappers.INSIDE]))
        name = f"({inside})" if item[0][:1] == "(" else item[0] + (f"[{inside}]" if inside else "")
        return name + {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[item[1], item[2]]

    assert shown(wrapper(["<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"])) == "[dl[(dt[#] dd[#])+]]"
    assert shown(wrapper(["<p>a</p>", "<p>a<b>x</b></p><hr>"])) == "[p[# b[#]?] hr?]"
    assert shown(wrapper(["<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>x<dd>y</dl>"])) == "[dl[(dt[#] dd[#])+]]"
    rng = random.Random(7)
    for round_ in range(150):
        tags = ["div", "p", "h2", "b", "ul", "table"][: rng.randrange(2, 7)]

        def page(depth=0):
            out = []
            for _ in range(rng.choice([1, 2, 5, 60 if not depth and round_ % 5 == 0 else 3])):
                tag = rng.choice(tags)
                out.append(f"<{tag}>{page(depth + 1) if depth < 3 and rng.random() < 0.4 else 'x'}</{tag}>")
            return "".join(out)

        pages = [page() for _ in range(rng.randrange(1, 6))]
        held = wrapper(pages)
        root = _Node(held)

        assert all(root.accepts(parse(x), {}) for x in pages)
        other = page() + "<hr>"
        assert not root.accepts(parse(other), {})


def test_the_item_of_an_element_is_one_that_accepts_it():
    """The first of two containers may be missing, and the text is in the second."""
    pages = [f"<div><ul><li>l{k}</ul></div><div><article><p>t{k}</p></article></div>" for k in range(3)] + ["<div><article><p>only</p></article></div>"]
    found = Wrapper(wrapper(pages), 4)
    assert [found.text(p) for p in pages] == ["t0", "t1", "t2", "only"]


def test_tag_soup_and_depth():
    deep = "<div>" * 3000 + "<p>in</p>" + "</div>" * 3000
    many = "".join(f"<p>{k}</p>" for k in range(20_000))
    for body, want in [
        (f"<article>{deep}<p>after</p></article><footer>no</footer>", "in\n\nafter"),
        (f"<article>{many}</article>", "\n\n".join(map(str, range(20_000)))),
        ("<article>a < b <i>c</i d></article >x", "a < b c"),
        ("<article>open <p title='>'>quoted</p> <p title=\">odd' <p>x", "open\n\nquoted\n\nodd'\n\nx"),
        ("<article><!-- no <p>never --><![CDATA[z]]>yes<script>if (a</b>) '</p>'</script> on", "yes on"),
        ("<article></article><p>outside", ""),
        ("plain words", "plain words"),
        ("", ""),
    ]:
        got = Wrapper(wrapper([body]), 1).text(body)
        assert got == want


def test_rows(spark):
    page = "<body><article><p>Hi</p></article></body>"
    rows = [(1, "http://A.example/x", page), (1, "http://A.example/x", page), (2, None, page), (3, "no address", None), (None, "http://a.example/y", ""), (5, "https://u:p@b.example:80/", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "host": F.lit("h"), "wrapper": F.lit(1), "c0": F.lit(2), "n_pages": F.lit(3), "salt": F.lit(4)})
    found = extract(pages)
    assert found.columns == ["page_id", "url", "html", "host", "wrapper", "c0", "n_pages", "salt", "text"]
    assert sorted(((r.page_id, r.text) for r in found.collect()), key=repr) == sorted([(1, "Hi"), (1, "Hi"), (2, "Hi"), (3, ""), (None, ""), (5, "Hi")], key=repr)
    assert sorted((r.host, r.n_pages) for r in infer(pages).collect()) == [("", 2), ("a.example", 3), ("b.example", 1)]
    assert extract(pages.limit(0)).collect() == [] and infer(pages.limit(0)).collect() == []


def test_shuffled_join_of_pages_and_wrappers(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted((r.page_id, r.text) for r in extract(pages).collect())
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(wrappers, "FAN", 2)
    assert sorted((r.page_id, r.text) for r in extract(pages.repartition(7)).collect()) == want
