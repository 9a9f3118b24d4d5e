"""Trained operators on held-out rows, page text and license rules on planted cases."""

import html
import math
import random
import re
import time

import numpy as np
import pytest

from tessera.llm import html_text, license_scan, queries, quality, toxicity

SF = "/root/testdata/sf0.1"


def areas(rows, labels):
    score = np.array([r.score for r in rows])
    y = np.array(labels)
    ranks = score.argsort(kind="stable").argsort(kind="stable") + 1
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("name", "label"), [("op1_toxicity", "toxic"), ("op5_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES[name](spark, SF).collect() if r.held_out and r.doc_id in known]
    y = [known[r.doc_id] for r in rows]
    assert areas(rows, y) > 0.93  # some rows are labelled against their text
    assert np.mean([r.predicted == v for r, v in zip(rows, y, strict=True)]) > 0.97


def test_models_without_classes():
    assert toxicity.train([]).score([9]) == 0.0
    assert toxicity.train([("a b", 0)]).weights is None
    assert not quality.train([("a b", 1)]).any()


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it work for you and for us.</div><article><h1>The &amp; head</h1><p>First   paragraph <b>with</b>
<a href=x>a link</a> in it.<p>Second&nbsp;one &lt;here&gt; &#233;.<ul><li>An item of the list that is text</ul><script>var x = "<p>no</p>";</script><div class=ad>Buy things now</div>
<form>Name <input></form></article><aside>Other things to read in the sidebar of this page</aside><div id="comments"><p>I liked the article a lot, thanks for it.</p></div><footer>c 2020</footer></body>"""


def test_page_text():
    tree = html_text.grow(html_text.labelled_blocks())
    assert html_text.main_text(PAGE, tree).split("\n") == ["The & head", "First paragraph with a link in it.", "Second one <here> é.", "An item of the list that is text"]
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == html_text.main_text("<nav>x</nav>", tree) == ""
    assert html_text.main_text("<article><p>" + "w " * 50 + "<!-- no --><![CDATA[a<b]]> end", tree).endswith("a<b end")
    assert sum(html_text.decide(tree, row[:-1]) != row[-1] for row in html_text.labelled_blocks()) <= 2


ARTICLE = "<h1>Head line of it</h1><p>" + "w " * 60 + "</p><p>A short one here.</p><p>" + "v " * 30 + "</p>"


@pytest.mark.parametrize("page", [
    '<main class="content with-sidebar">%s</main>', '<article><header>%s</header></article>', "<form id=aspnetForm><nav><a>x</a></nav>%s</form>", '<article class="post comments-open">%s</article>',
    '<div id="page" class="header-fixed">%s</div>', '<div class="widget-area-none post">%s</div>', '<div class=x title="the hidden truth">%s</div>', "<div class=sidebar><article>%s</article></div>",
])
def test_no_name_drops_an_article(page):
    tree = html_text.grow(html_text.labelled_blocks())
    got = html_text.main_text(f"<body>{page % ARTICLE}<div id=comments>{'<p>' + 'I say so. ' * 9}</div></body>", tree).split("\n")
    assert got == ["Head line of it", ("w " * 60).strip(), "A short one here.", ("v " * 30).strip()]


def test_nothing_in_an_article_is_dropped_and_all_furniture_is():
    tree, r = html_text.grow(html_text.labelled_blocks()), random.Random(1)
    for _ in range(3000):
        words, links = (lambda: r.choice([0, 1, 2, 5, 15, 60, 300])), (lambda: r.choice([0.0, 0.3, 0.7, 1.0]))
        row = [max(1, words()), links(), words(), links(), words(), links(), 0, 0, 1, r.randrange(2)]
        assert html_text.decide(tree, row) == 1
        row[6 + r.randrange(2)] = 1
        assert html_text.decide(tree, row) == 0


@pytest.mark.parametrize("soup", ['<a' + " " * 100000 + '"', '<a "' * 50000, "<div>" * 30000 + "</p>" * 30000, "<b>" * 30000 + "</i>" * 30000, '<p x="' * 30000 + ">", "<" * 100000, "<script>" * 50000, "<a x=" * 30000])
def test_tag_soup_takes_linear_time(soup):
    began = time.process_time()
    html_text.main_text(soup, html_text.grow(html_text.labelled_blocks()[:40]))
    assert time.process_time() - began < 5


def plain_main_text(page):
    """Brute force for pages whose article has no furniture inside."""
    inside = re.search(r"(?s)<article>(.*)</article>", page)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(p for p in parts if p)


def test_page_text_equals_brute_force(spark):
    rows = queries.QUERIES["op9_main_text"](spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.text == plain_main_text(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_quality_equals_brute_force():
    """The same features by dictionaries of Python, the same updates weight by weight."""
    r = random.Random(3)
    rows = [(" ".join(r.choice(["good", "bad", "x1!", "Ab"]) for _ in range(r.randrange(1, 12))), r.randrange(2)) for _ in range(25)]
    weights = quality.train(rows, 2)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    order, memo = np.random.RandomState(0), quality.Memo()
    for _ in range(2):
        for k in order.permutation(len(rows)):
            i, v = quality.features(rows[k][0], memo)
            v = v.astype(np.float32)
            p = 1 / (1 + math.exp(-sum(weight(a) * float(b) for a, b in zip(i.tolist(), v, strict=True))))
            for a, b, w in [(a, float(b), weight(a)) for a, b in zip(i.tolist(), v, strict=True)]:
                g = (p - rows[k][1]) * b
                s = (math.sqrt(n.get(a, 0.0) + g * g) - math.sqrt(n.get(a, 0.0))) / quality.ALPHA
                z[a], n[a] = z.get(a, 0.0) + g - s * w, n.get(a, 0.0) + g * g
    assert all(abs(weights[i] - weight(i)) < 1e-4 for i in z)


def test_toxicity_by_plain_compression():
    """Savings are lengths under one dictionary less lengths under the other; phrases and short words count; unlabelled words don't."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "the", "or", "ing", "es", "ti"]) for _ in range(r.randrange(1, 4)))
    text = lambda bad: " ".join(r.choice(["ugh you", "zorb", "glip quon"]) if bad and r.random() < 0.1 else word() for _ in range(80))
    rows = [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.train(rows)
    ruler = toxicity.Ruler(model)
    for content, other in ((text(True), ruler.compressors),):
        body = toxicity.MARK + toxicity.MARK.join(toxicity.words_of(content))
        step = toxicity.WINDOW - toxicity.OVERLAP
        lengths = [[len(c.compress(body[i : i + toxicity.WINDOW] + toxicity.ANCHOR)) for c in other] for i in range(0, len(body) - toxicity.OVERLAP, step)]
        assert ruler.savings(content) == [a - b for a, b in lengths]
    assert model.ordinary != model.toxic and b"zorb" in model.toxic and b"ugh" in model.toxic
    scores = [(model.score(ruler.savings(text(bad))) >= 0.5) == bad for bad in [True, False] * 40]
    assert sum(scores) >= 76


def test_licenses(spark):
    texts = [
        "Released under the MIT License.", "x Licensed under the Apache License, Version 2.0. y", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc", "SPDX-License-Identifier: GPL-3.0",
        "Das ist mit ihm", "under the MIT license, under the mit LICENSE", "available under the terms of the GNU General Public License, version 3", "all rights reserved",
        "licensed under creative commons attribution noncommercial sharealike", "summit apachelicense version 2", None,
    ]
    rows = license_scan.digest(license_scan.detections(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    got = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in rows]
    assert got[:4] == [(5, 1, 1, 1, "mit", "mit"), (10, 1, 4, 4, "apache-2", "apache-2"), (7, 1, 2, 2, "cc-by-nc", "cc-by-nc"), (6, 2, 0, 3, "cc-by-nc", "cc-by-nc")]
    assert [g[5] for g in got[4:]] == ["gpl-3", "", "mit", "gpl-3", "proprietary", "cc-by-nc-sa", "", ""]
    assert got[6][1:4] == (2, 0, 4) and got[11] == (0, 0, None, None, "", "")
    assert all(0 <= r.score <= 1 for r in rows) and rows[4].score == 1.0
