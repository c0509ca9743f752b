import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm.dom import parse
from pagewright.llm.html_extraction import Extraction, Forest, Model, extract_text, marginals, node_labels, slope, train
from pagewright.llm.page_layouts import invented_page, laid_out, named_article


def random_model(seed):
    return Model(np.random.default_rng(seed).normal(0, 1, len(Model().values)))


def scores_of_all_states(forest, model):
    """Every assignment of states with its score."""
    unary = model.unary(forest)
    for states in itertools.product((0, 1), repeat=len(unary)):
        score = sum(u for u, s in zip(unary, states) if s)
        for i, p in enumerate(forest.parent):
            if not forest.root[i]:
                score += model.pair[forest.kind[i], states[p], states[i]]
        yield states, score


PAGES = ["<div class=ad>x y</div><p>One two, three.<ul><li>a<li><a href=x>b</a></ul>", "<article><h1>T</h1><p>u</p></article>", "bare"]


@pytest.mark.parametrize("seed", range(4))
def test_messages_give_the_marginals_of_all_assignments(seed):
    forest, model = Forest([parse(p) for p in PAGES[: 1 + seed % 3]]), random_model(seed)
    total, on = 0.0, np.zeros(len(forest.tag))
    for states, score in scores_of_all_states(forest, model):
        total += np.exp(score)
        on += np.exp(score) * np.array(states)
    assert np.allclose(marginals(forest, model), on / total)


def test_slope_is_that_of_the_likelihood():
    trees = [parse(f'<body data-label="0">{p.replace("<p>", "<p data-label=1>")}'.replace("=1>", '="1">')) for p in PAGES]
    forest, model = Forest(trees), random_model(9)
    labels = node_labels(forest, trees)
    assert labels.any() and not labels.all()

    def likelihood(values):
        found = list(scores_of_all_states(forest, Model(values)))
        own = next(s for states, s in found if list(states) == labels.tolist())
        return own - np.log(sum(np.exp(s) for _, s in found))

    got = slope(forest, labels, model)
    for i in np.random.default_rng(0).choice(len(got), 12, replace=False):
        step = np.zeros(len(got))
        step[i] = 1e-5
        want = (likelihood(model.values + step) - likelihood(model.values - step)) / 2e-5
        assert got[i] == pytest.approx(want, abs=1e-5)


def texts(page):
    return [t for t in parse(page).texts if t]


def test_trees():
    assert texts("<p>a&amp;b &nbsp;\n c<br>d<p>e<b>f<p>g") == ["a&b c d", "ef", "g"]
    assert texts("x<script>var t='</p>';</script>y<style>p{}</style><!-- <p>no</p> -->z") == ["x y z"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts('<div title="a>b" data-x=\'<p>\'>t</div>') == ["t"]
    assert texts("1 < 2 <3> <<p>x</p ></div></nope>y") == ["1 < 2 <3> <", "x", "y"]
    assert texts("a<script>never closed <p>b") == ["a"] and texts("a<!-- b <p>c") == ["a"]
    assert texts("<textarea>no<p>t</textarea><title>T</title><p title='x>y") == ["no", "t T", "y"]
    assert texts("") == [] and texts("&lt;b&gt; &#233;&#x4e2d;") == ["<b> é中"]
    tree = parse("<div><p>" + "<div>" * 3000 + "deep")
    assert tree.texts[-1] == "deep" and max(tree.depth) > 3000
    tree = parse('<p><a href="x">abc</a> def</p><div>after')
    assert [tree.linked[i] for i, t in enumerate(tree.texts) if t] == [3, 0]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return train(spark.read.parquet(f"{sf_dir}/pages.parquet").select("html"))


def pages_of(spark, sf_dir):
    return [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]


def test_pages_laid_out_anew_are_read_right(spark, sf_dir, model):
    rng, right, wrong, missed = random.Random(5), 0, 0, 0
    for page in pages_of(spark, "/root/testdata/sf0.01"):
        tree = parse(laid_out(named_article(parse(page)), rng))
        found = marginals(Forest([tree]), model) >= 0.5
        for said, label, kept in zip(tree.texts, tree.label, found):
            if said:
                right += len(said) * (label == 1 and kept)
                wrong += len(said) * (label != 1 and kept)
                missed += len(said) * (label == 1 and not kept)
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.97


STORY = "The council met on Monday, and after three hours of debate it voted to keep the old bridge open."
PAGE = """<html><head><title>x</title></head><body><div id="top" class="site-header"><a href="/">Daily</a></div>
<ul class="menu"><li><a href=a>Home</a><li><a href=b>World</a><li><a href=c>Sport</a></ul>
<div class="cookie-consent"><p>We use cookies to improve your experience on this site.</p><button>OK</button></div>
<div class="entry-content"><h1>Bridge stays</h1><p>{0} {0}</p><p>&quot;Good news,&quot; said one.</p><div class="ad">Buy boots now, half price today only.</div>
<blockquote>{0}</blockquote><p>{0}</p></div>
<div class="comments"><h3>Comments</h3><div class="comment"><p>Anna</p><p>I think this is a really good decision, thanks.</p></div></div>
<form class="newsletter"><label>Mail</label><input><p>Sign up to our letter.</p></form>
<div class="sidebar"><h3>More</h3><a href=d>Ten best walks in the hills</a> <a href=e>What to cook now</a></div>
<div id="footer">&copy; Daily 2024 | All rights reserved.</div></body></html>""".format(STORY)


def test_query_form(spark, sf_dir, model):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    more = [(1001, "u", PAGE), (1002, "u", None), (1003, None, ""), (None, "v", PAGE), (1001, "u", PAGE), (1004, "w", "<p>" + STORY * 5000)]
    rows = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(more, "page_id bigint, url string, html string"))
    rows = rows.select("*", F.lit("mine").alias("text"), F.lit(1).alias("hash"), F.lit(2).alias("value"))
    got = extract_text(rows).collect()
    assert len(got) == pages.count() + len(more)
    assert all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1001] == by_id[None] == f'Bridge stays\n{STORY} {STORY}\n"Good news," said one.\n{STORY}\n{STORY}'
    assert by_id[1002] == by_id[1003] == "" and by_id[1004] == STORY * 5000
    for page_id, html in ((r.page_id, r.html) for r in pages.collect()):
        inner = html.split("<article>")[1].split("</article>")[0]
        assert by_id[page_id] == "\n".join(texts(inner))


def test_no_pages_and_no_named_articles(spark):
    schema = "page_id bigint, url string, html string"
    cfg = Extraction(rounds=60)
    assert extract_text(spark.createDataFrame([], schema), cfg).count() == 0
    assert extract_text(spark.createDataFrame([(1, "u", PAGE)], schema), cfg).first().text.startswith("Bridge stays\n")
    tree = invented_page(random.Random(3))
    assert 1 in tree.label and 0 in tree.label
