"""Blocks of a page, the network's slopes, held-out pages, layouts that the fit has not seen, and the registered query."""

import html
import re

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkledger.llm import html_text

SF = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in html_text.blocks(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("<!-- only --><script>x='</p>'</script>") == []
    assert texts("<p>a <b>b</b>c<br>d\n\t e<p>f &amp;amp; &#233;&copy;") == ["a bc d e", "f &amp; é©"]
    assert texts("<div>one<p>two</p>three<ul><li>x<li>y</ul></div>") == ["one", "two", "three", "x", "y"]
    assert texts("<title>t</title><STYLE>p{}</STYLE><p title='a>b' >c</p><p>1 < 2 <3</p><p class='x") == ["c", "1 < 2 <3"]
    assert texts("<script>never ends <p>x</p>") == [] and texts("<p>a<!-- never ends <p>x") == ["a"]
    assert texts("</div></p>a</b>b") == ["ab"]
    paths = [b.path for b in html_text.blocks("<article><p><b>a<br><p>b</article><footer class='siteFoot end'>c</footer>")]
    assert paths == [("<article", "<p"), ("<article", "<p"), ("<footer", "site", "site-", "foot", "foot-", "end", "end-")]
    links = [round(b.links, 2) for b in html_text.blocks("<li><a href=x>all</a></li><p>half<a>half</a></p><p>none</p>")]
    assert links == [1, 0.5, 0]


def test_slopes():
    model = html_text.Labeller.new()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    pages = ["<nav><a>x</a></nav><main><p>one two</p><p>three.</p></main>", "<main>y</main>", "<footer>a b</footer><article><p>c</p></article><div>d</div><div>e</div>"]
    cut = [html_text.blocks(p) for p in pages]
    leaves, marks = [html_text.leaves_of(b) for b in cut], [html_text.marks_of(b) for b in cut]
    slopes = model.slopes(leaves, marks)[1]
    for k, w in model.weights.items():
        at = np.unravel_index(np.abs(slopes[k]).argmax(), w.shape)
        was, sides = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = was + step
            sides.append(model.slopes(leaves, marks)[0])
        w[at] = was
        assert abs((sides[0] - sides[1]) / 2e-3 - slopes[k][at]) < 1e-4 + 1e-3 * abs(slopes[k][at])


@pytest.fixture(scope="module")
def pages():
    return pd.read_parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return html_text.fit_pages(pages.html[:200].tolist())


def plain(page):
    """The article's paragraphs, cut out by pattern: the given pages all have the same layout."""
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", inside))
    return "\n".join(filter(None, parts))


def test_pages_outside_the_sample(pages, model):
    rest = pages.html[200:].tolist()
    assert len(rest) == 50 and list(html_text.main_texts(rest, model)) == [plain(p) for p in rest]


LAYOUTS = {
    "landmarks": "<body><header><p>{b}</p></header><nav><ul><li><a>{b}</a></li><li><a>{b}</a></li></ul></nav><main>{c}</main><aside><h3>{b}</h3><p>{b}</p></aside><footer><p>{b}</p></footer></body>",
    "names": "<body><div class='topbar'><p>{b}</p></div><div id='main-nav'><ul><li><a>{b}</a></li><li><a>{b}</a></li></ul></div><div class='post-content'>{c}</div><div class='sidebar'><p>{b}</p></div><div class='site-footer'>{b}</div></body>",
    "comments": "<body><nav><a>{b}</a></nav><article>{c}<section class='comments'><p>{b}</p><p>{b}</p></section></article><footer>{b}</footer></body>",
    "notice": "<body><div class='cookie-notice'><p>{b}</p></div><article><div class='ad'>{b}</div>{c}</article><form><label>{b}</label></form><footer>{b}</footer></body>",
    "tail": "<body><article>{c}</article><div class='comment-list'><p>{b}</p></div><div class='newsletter'>{b}</div><div class='advert'>{b}</div></body>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_other_layouts(pages, model, name):
    rest = pages.html[200:].tolist()
    other = [x for p in rest for x in re.findall("<li><a[^>]*>(.*?)</a>|<div class=\"ad\">(.*?)</div>|<footer>(.*?)</footer>", p)]
    other, right = [max(x) for x in other], 0
    for k, page in enumerate(rest):
        content = [x for x in plain(page).split("\n") if x]
        body = "".join(f"<p>{html.escape(x)}</p>" for x in content)
        made = LAYOUTS[name].replace("{c}", body)
        while "{b}" in made:
            made = made.replace("{b}", other[(k * 7 + len(made)) % len(other)], 1)
        right += next(html_text.main_texts([made], model)) == "\n".join(content)
    assert right >= 0.9 * len(rest), (name, right)


def test_awkward_rows(spark, model):
    long = "<article>" + "".join(f"<p>Sentence {k} of a long page.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, None), (2, ""), (3, "<nav><a>menu</a></nav>"), (4, "<article><h1>A</h1><p>Some words, &lt;here&gt;.</p></article>"), (5, long)]
    rows += [rows[3], (None, rows[3][1])]
    df = spark.createDataFrame([(k, "u", t, "clash") for k, t in rows], "page_id long, url string, html string, text string")
    out = html_text.extract(df, model)
    assert out.columns == [*df.columns, "text_"] and out.count() == len(rows)
    got = sorted((r["page_id"] or 0, r["text_"]) for r in out.collect())
    article = "A\nSome words, <here>."
    assert got[:6] == [(0, article), (1, ""), (2, ""), (3, ""), (4, article), (4, article)]
    assert got[6][1].count("\n") == 19_999
    empty = df.limit(0)
    assert html_text.extract(empty, html_text.fit(empty)).count() == 0


def test_query(spark, pages):
    out = entry.queries()["op12_html_text"](spark, SF)
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(pages) and out.columns == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["n_chars"] == "bigint"
    for r in pages.itertuples():
        assert (got[r.page_id]["text"], got[r.page_id]["url"], got[r.page_id]["n_chars"]) == (plain(r.html), r.url, len(plain(r.html)))
