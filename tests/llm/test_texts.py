"""HTML rendering, classifiers and decontamination."""

import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import decontaminate, quality, render, toxicity
from quayside.plans.views import Tables
from tests.llm.samples import AWKWARD, SCHEMA, clashing, docs, words

# ---- rendering

PAGES = {
    "": "",
    "plain  text\n here": "plain text here",
    "<p>one<p>two": "one\n\ntwo",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>a<li>b<ul><li>c</ul></ul><ol start=9><li>x<li>y</ol>": "- a\n- b\n  - c\n\n9. x\n10. y",
    "<table><tr><th>k<th>value<tr><td>long key<td>1<tr><td colspan=2>both</table>": "k         value\nlong key  1\nboth",
    "<table><td>a<td>b<tr><td>c</table>": "a  b\nc",
    "<style>.x,#y{display:none} p{margin:0}</style><p class='z x'>no</p><div id=y>no</div><p>yes</p>": "yes",
    "<script>var t='</p>';</script><!-- c --><template>t</template><div hidden>h</div>seen<noscript>n</noscript>": "seen",
    "<title>t</title><p style='visibility: hidden'>a</p>b<span style=\"display:none\">c</span>d": "bd",
    "<pre>a  b\n  c</pre>": "a  b\n  c",
    "x &amp; y &lt;z&gt; 1 < 2": "x & y <z> 1 < 2",
    "<b>bold <i>both</b> rest</i>": "bold both rest",
    "<blockquote>q<p>r</blockquote>": "  q\n\n  r",
    "<div>a</div><div>b</div>c<section>d</section>": "a\nb\nc\nd",
    "a <b> b</b>c": "a bc",
    "<p>unclosed <b>tag": "unclosed tag",
    "<": "<", "<>": "<>", "</p>x": "x", "<!-- open": "",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    # what hides nothing
    "<p style='-webkit-backface-visibility: hidden; backface-visibility:hidden'>a</p><style>.c{backface-visibility: hidden}</style><p class=c>b": "a\n\nb",
    "<style>@media print { .nav { display:none } } .x{display:none}</style><p class=nav>nav</p><p class=x>no": "nav",
    "<style>@media (max-width:600px) { .side { display:none } .b{color:red} }</style><p class=side>side": "side",
    "<style media=print>p{display:none}</style><p>a": "a",
    "<style>.x{display:none} .x{display:block}</style><p class=x>a": "a",
    "<style>p.x{display:none} .x{display:block}</style><p class=x>no</p><p class=x style='display:block'>a": "a",
    "<style>.x{display:none!important} .x{display:block}</style><p class=x>no</p>a": "a",
    "<style>.m{display:none} .m.open{display:block}</style><p class=m>no</p><p class='m open'>a": "a",
    # what hides
    "<style>@import url(a;b.css); @media screen{.x{color:red;display : none}} @font-face{src:url(x)} .y{visibility:collapse</style><p class=x>n<p class=y>o<p>a": "a",
    # stray quotes in tags
    "<p title=don't>Visible one</p><p>it's here</p>": "Visible one\n\nit's here",
    "<a href=\"a.html\"\">Link</a> says \"so\" > all": "Link says \"so\" > all",
    "<p title=it's hidden>no</p><p ' class='a>b' \">a": "a",
    "<p title = 'a > b' lang=\"x>y\"id=z>a</p>": "a",
    "<p title=\"open>a</p><p>b": "a\n\nb",
    # drawings, formulas, raw text and inputs
    "<svg><title/><defs><text>no</text></defs><path d='M0'/><g>\n<text x=1>Label <tspan>7</tspan></text></g><text><tspan x=0 y=1>one</tspan><tspan x=0 dy=9>two"
    "</tspan></text><text display=none>no</text><text><![CDATA[<3]]></text></svg>end": "Label 7\none\ntwo\n<3\nend",
    "<svg><foreignObject><p>html</p></foreignObject><path><p>after</p>": "html\n\nafter",
    "f: <math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>no</annotation></semantics></math>.": "f: x= 1 2 .",
    "a<xmp><b>  raw &amp;</xmp>b": "a\n\n<b>  raw &amp;\n\nb",
    "<input type=number value=7> <input type=email value=a@b.c> <input type=url value=u> <input type=Date value=2020-01-02> <input value=t>"
    "<input type=hidden value=no><input type=password value=no><input type=checkbox value=no>": "7 a@b.c u 2020-01-02 t",
    "<table><tr><td rowspan=2>name<td>b<tr><td>c<tr><td>d<td>e</table>": "name  b\n      c\nd     e",
    "<table><tr><td>a<td rowspan=0 colspan=2>wide<td>z<tr><td>b<td>c<tbody><tr><td>d<td>e</table>": "a  wide  z\nb        c\nd  e",
}


@pytest.mark.parametrize("source", PAGES)
def test_layout(source):
    assert render.render(source) == PAGES[source]


def test_unfinished_tags_take_no_time():
    assert "x" in render.render("x<a " + "b=\"c\" d='e' " * 5000)


class Plain(HTMLParser):
    """All text outside of elements that never show."""

    def __init__(self):
        super().__init__()
        self.unseen, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.unseen += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.unseen -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.unseen:
            self.found.append(data)


def test_no_visible_text_is_lost(spark, data):
    pages = Tables(spark, data).pages
    rows = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in render.visible_text(pages).collect()}
    assert got.keys() == rows.keys()
    for page, source in rows.items():
        plain = Plain()
        plain.feed(source)
        squeeze = lambda t: re.sub(r"\s+", "", t)
        assert squeeze(re.sub(r"(?m)^(- )+", "", got[page])) == squeeze("".join(plain.found))


def test_awkward_pages(spark):
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    texts = [None, "", "<table>" * 300 + "x", deep, "<li>" * 500 + "y", "&#0;&bogus;", "<a " + "x" * 100_000, "<p>" * 3, "\x00<b>"]
    df = spark.createDataFrame([(None if i == 1 else i, t, "x", "y") for i, t in enumerate(texts)], "page_id long, html string, text string, n_lines string")
    got = {r.page_id: r.text for r in render.visible_text(df.repartition(3)).collect()}
    assert len(got) == len(texts) and got[0] == "" and got[None] == "" and got[3] == "core" and "x" in got[2] and "y" in got[4]
    assert render.visible_text(df.limit(0)).count() == 0


# ---- classifiers

@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    insults, groups = ["idiot", "scum"], ["zorks", "quibs"]
    texts, quality_, toxic = [], [], []
    for _ in range(1500):
        base = words(rng, rng.randrange(5, 60)).split()
        bad = rng.random() < 0.3
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        base += [rng.choice(insults)] * insult + [rng.choice(groups)] * group
        rng.shuffle(base)
        texts.append(" ".join(w.upper() + "!!" for w in base) if bad else " ".join(base))
        quality_.append(int(not bad))
        toxic.append(int(insult and group))  # neither word alone is enough
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(quality_, toxic, strict=True))], "doc_id long, quality int, toxic int")
    return df.cache(), labels.cache()


def accuracy(scored, labels, label):
    joined = scored.join(labels, "doc_id").filter("held_out")
    return joined.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_quality(spark, labelled):
    df, labels = labelled
    model = quality.fit(df, labels)
    assert accuracy(quality.score_documents(df, model), labels, "quality") > 0.98
    assert model.pairs and len(model.grids) == len(model.pairs)


def test_factorization_machine_learns_pairs(spark, labelled):
    df, labels = labelled
    model = toxicity.fit(df, labels)
    assert accuracy(toxicity.score_documents(df, model), labels, "toxic") > 0.97
    both, one, other = (float(model.score([t], {})[0]) for t in (b"you scum zorks", b"you scum", b"you zorks"))
    assert both > 0.5 > max(one, other)


def test_additive_model_needs_its_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    hit = lambda m: np.mean((m.score(x) > 0.5) == y)
    assert hit(quality.AdditiveModel(pairs=0).fit(x, y)) < 0.75 < 0.95 < hit(quality.AdditiveModel().fit(x, y))


def test_pairwise_sum_is_the_sum_over_pairs():
    model = toxicity.FactorizationMachine()
    rng = np.random.default_rng(3)
    model.w, model.v, model.base = rng.normal(size=9), rng.normal(size=(9, 6)), 0.3
    row = np.array([1, 4, 7], np.int32)
    brute = 0.3 + model.w[row].sum() + sum(model.v[a] @ model.v[b] for a in row for b in row if a < b)
    scores = model.raw([row, row[:0]])
    assert scores[0] == pytest.approx(brute) and scores[1] == pytest.approx(0.3)


def test_words_that_matter_only_together():
    # toxic if exactly one of two balanced words is there: neither word alone tells anything
    rng = random.Random(4)
    texts, toxic = [], []
    for _ in range(6000):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        found = words(rng, rng.randrange(5, 40)).split() + ["zork"] * one + ["quib"] * two
        rng.shuffle(found)
        texts.append(" ".join(found).encode())
        toxic.append(int(one != two))
    rows, y = toxicity.text_terms(texts, {}), np.array(toxic, float)
    model = toxicity.FactorizationMachine().fit(rows[:5000], y[:5000])
    assert np.mean((model.raw(rows[5000:]) > 0) == y[5000:]) > 0.95


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_awkward_documents(spark, labelled, operator, label):
    df, labels = labelled
    rough = labels.unionAll(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 1), (9_999, 1, 1)], labels.schema))
    model = operator.fit(clashing(df), rough, most=300)
    ids = [None, None, *range(len(AWKWARD) - 2)]
    scored = operator.score_documents(clashing(docs(spark, AWKWARD, ids)), model)
    rows = scored.collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert operator.score_documents(spark.createDataFrame([], SCHEMA), model).count() == 0
    for some in (labels.limit(0), labels.filter(f"{label} = 1")):
        rows = operator.score_documents(df.limit(5), operator.fit(df, some)).collect()
        assert len({r.score for r in rows}) == 1


def test_a_bounded_sample_does_not_depend_on_partitions(spark, labelled):
    df, labels = labelled
    one, two = (toxicity.score_documents(df, toxicity.fit(df.repartition(n), labels.repartition(n), most=400)).orderBy("doc_id").collect() for n in (2, 9))
    assert one == two


# ---- pages with many marks

def test_many_open_brackets_take_linear_time():
    for page in ("<a ", "if a<b and c<d then ", '<a b="> " ', "<!-", "</ ", "<x y='"):
        import time
        times = []
        for n in (20_000, 80_000):
            start = time.perf_counter()
            render.render(page * n)
            times.append(time.perf_counter() - start)
        assert times[1] < 0.5 + 12 * times[0]


def test_comments_and_marks_that_are_no_tags():
    assert render.render("a<!-->b<!--->c<!-- x --!>d") == "abcd"
    assert render.render("<p>one</p>x < y & z <3 </ p>ok") == "one\n\nx < y & z <3 ok"
    assert render.render("if a<b and c<d then e") == "if a<b and c<d then e"
    assert render.render("a</>b<!doctype html>c<?xml x?>d<![CDATA[x]]>e") == "abcde"
    assert render.render("<b>x</b> tail <b unfinished=") == "x tail <b unfinished="
    assert render.render('<p title="x>y">hi</p><!-- never ended') == "hi"


# ---- decontamination

def brute_hits(text, items):
    """Every window of every item's size, compared by its shingles."""
    found, out = decontaminate.words((text or "").encode()), {}
    for i, item in items:
        target = decontaminate.words((item or "").encode())
        n = len(target)
        if not found or not target:
            continue
        best = max((decontaminate.similarity(decontaminate.shingles(found[s:s + n]), decontaminate.shingles(target)), -s)
                   for s in range(max(1, len(found) - n + 1)))
        if best[0] >= 0.8:
            out[i] = max(out.get(i, (0, 0)), best)
    return out


def test_contaminations(spark):
    rng = random.Random(5)
    items = [(i, words(rng, rng.randrange(6, 50))) for i in range(30)] + [(100, "tiny item"), (101, None), (102, ""), (103, "..."), (None, "a b c"), (104, "one")]
    texts = list(AWKWARD)
    for _ in range(150):
        item = (rng.choice(items)[1] or "x y").split()
        kind = rng.randrange(5)
        if kind == 1 and len(item) > 12:
            item[rng.randrange(len(item))] = "changed"
        elif kind == 2:
            item = [w.upper() + "," for w in item]
        elif kind == 3:
            item = item[:len(item) * 2 // 3]
        texts.append(" ".join([words(rng, rng.randrange(0, 30)), *item, words(rng, rng.randrange(0, 30))]))
    ids = [None, None, *range(len(texts) - 3), 4]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    df = clashing(docs(spark, texts, ids)).repartition(5)
    known = [(i, t) for i, t in items if i is not None]
    expected = Counter()
    for i, t in zip(ids, texts, strict=True):
        expected.update((i, k, round(s, 9), -at) for k, (s, at) in brute_hits(t, known).items())
    for per_pass in (1000, 7):
        rows = decontaminate.contaminations(df, bench, per_pass=per_pass).collect()
        assert Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in rows) == expected
        assert all(r.distance <= decontaminate.RADIUS for r in rows)
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert Counter(r.text for r in clean.collect()) == Counter(t for t in texts if not brute_hits(t, known))
    empty = spark.createDataFrame([], SCHEMA)
    assert decontaminate.contaminations(empty, bench).count() == 0
    assert decontaminate.contaminations(df, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(texts)


def test_blocks_miss_nothing_within_the_radius():
    rng = random.Random(6)
    index = decontaminate.Index([1], [[b"w%d" % i for i in range(20)]], radius=7)
    target = int(index.prints[0])
    for _ in range(500):
        other = target
        for b in rng.sample(range(64), 7):
            other ^= 1 << b
        assert any(table.get((20, int(np.uint64(other) >> shift & mask))) for table, (shift, mask) in zip(index.tables, index.blocks, strict=True))
