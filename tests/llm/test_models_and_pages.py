"""Language identification, URL rules, page texts and the pipeline."""

from __future__ import annotations

import html
import re

import corpus_pipeline
import numpy as np
import pytest
from llm_rows import DOCS
from pyspark.sql import functions as F

from barloom import storage
from barloom.llm import gru, lang_id, queries, url_filter, wrapper
from barloom.llm.dom import Matcher, parse
from barloom.llm.url_filter import Rule

FOLDER = "/root/testdata/sf0.001"


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(1)
    x = rng.integers(60, 200, (gru.WINDOW, 5))
    labels = np.array([0, 1, 2, 1, 0])
    net = gru.Network.random(3)
    _, grads = net.gradients(x, labels)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was, losses = p[at], []
        for step in (0.01, -0.01):
            p[at] = was + step
            losses.append(net.gradients(x, labels)[0])
        p[at] = was
        assert g[at] == pytest.approx((losses[0] - losses[1]) / 0.02, rel=0.02)


def test_pooled_probabilities_are_those_of_plain_loops():
    """Each window, position and unit by itself, from the definition of the gated unit."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (gru.WINDOW, 4))
    net, h = gru.Network.random(3), gru.HIDDEN

    def logistic(v):
        return 1 / (1 + np.exp(-v))

    def states(window, d):
        state, out = [0.0] * h, []
        for byte in window:
            given = net.inputs[d][:, byte].astype(float)
            inner = [sum(float(net.inner[d][g, j]) * state[j] for j in range(h)) for g in range(3 * h)]
            new = []
            for j in range(h):
                update, reset = logistic(given[j] + inner[j]), logistic(given[h + j] + inner[h + j])
                candidate = np.tanh(given[2 * h + j] + reset * inner[2 * h + j])
                new.append(update * state[j] + (1 - update) * candidate)
            state = new
            out.append(state)
        return out

    sums, letters = net.pooled(x)
    for b in range(x.shape[1]):
        forward, backward = states(x[:, b], 0), states(x[::-1, b], 1)[::-1]
        expected, n = np.zeros(3), 0
        for t, byte in enumerate(x[:, b].tolist()):
            if byte >= 0x80 or chr(byte).isalpha():
                p = np.exp(net.outer @ np.array(forward[t] + backward[t]) + net.bias[:, 0])
                expected, n = expected + p / p.sum(), n + 1
        assert letters[b] == n
        assert sums[:, b] == pytest.approx(expected, rel=1e-4)


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.held_out]
    assert 0 < len(held) < len(out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_languages_of_awkward_rows(spark, awkward, empty):
    model = lang_id.fit(awkward, F.lit(True))
    assert model.languages == ["de", "en", "fr"]
    out = lang_id.predict(awkward, model)
    assert set(awkward.columns) - {"text"} <= set(out.columns)
    found = {r.doc_id: r for r in out.select("doc_id", "lang_pred", F.col("score")).collect() if r.doc_id}
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert found[4].lang_pred in model.languages
    nothing = lang_id.fit(empty, F.lit(True))
    assert {r.lang_pred for r in lang_id.predict(awkward, nothing).collect()} == {"und"}
    assert lang_id.predict(empty, model).count() == 0


def test_more_languages_than_are_learned(spark):
    rows = [(k, " ".join(chr(97 + k % 26) * 3 + chr(97 + k // 26) for _ in range(8)), f"l{k:03d}") for k in range(300)]
    rows += [(300 + k, text, lang) for k, text, lang in rows[290:]]  # frequent languages are learned, wherever their names stand
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in ("_text", "in_0", "score")})
    model = lang_id.fit(df, F.lit(True))
    assert model.languages == [f"l{k:03d}" for k in [*range(190), *range(290, 300)]]
    out = lang_id.predict(df, model).collect()
    assert len(out) == 310 and {r.lang_pred for r in out} <= set(model.languages)
    assert all(r["_text"] == "_text" and r["in_0"] == "in_0" and 0 < r["score"] <= 1 for r in out)


RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("b.net", "", "block")]
URLS = [
    None, "", "nothing", "http://", "http://Example.COM/en/x", "https://www.example.com/en/?q=1", "http://a.example.com/en",
    "http://badexample.com/en/", "http://a.b.net#x", "http://b.net", "ftp://x://y.com/", "http://com/", "http://user.com",
    "http://" + "a." * 300 + "example.com/en/" + "p/" * 20_000,
]


def plain_verdict(url: str | None) -> tuple:
    hit = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), hit[1]) if hit else ""
    path = hit[2] if hit else ""
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_verdicts_are_those_of_plain_rules(spark, monkeypatch):
    df = spark.createDataFrame([*enumerate(URLS), (99, URLS[4]), (99, URLS[4])], "page_id long, url string")
    df = df.withColumns({c: F.lit("extra") for c in ("host", "path", "rule", "verdict", "best")}).repartition(3)
    for limit in (url_filter.MAX_RULES, 0):  # the array, and the join beyond its bound
        monkeypatch.setattr(url_filter, "MAX_RULES", limit)
        out = url_filter.judge(df, RULES).collect()
        assert len(out) == len(URLS) + 2
        for r in out:
            url = URLS[r.page_id] if r.page_id != 99 else URLS[4]
            assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(url)
        assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_equal_digests_decide_nothing(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda texts: np.zeros(len(texts), np.uint64))
    uri = storage.scratch_path(spark, "digests")
    array = url_filter.DigestArray.write(RULES, uri)
    urls = [u for u in URLS if u]
    hosts, paths = url_filter.split(urls)
    found = array.probe(uri.removeprefix("file:"), hosts, paths)
    assert list(zip(*found, strict=True)) == [(r, v if r else None) for _, _, r, v in map(plain_verdict, urls)]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>n</a></nav>
<div class="ad">Buy {n}</div><div class="crumb">Constant</div><{main}><h1>Title {n} &amp; more</h1><p>First <b>bold {n}</b>
text &lt;{n}&gt;<p>Second&nbsp;{n}<br>third {n}<ul><li>one<li>two {n}</ul><script>if(a<b)alert("</p>")</script>
<div class="share">Share</div><section class="comments"><p>nice {n}</p></section></{main}><form>mail</form><footer>f {n}</footer></body></html>"""


def page(n: int, main: str) -> str:
    return PAGE.replace("{n}", str(n)).replace("{main}", main)


def expected(n: int) -> str:
    return f"Title {n} & more\nFirst bold {n} text <{n}>\nSecond {n}\nthird {n}\none\ntwo {n}"


def test_page_texts(spark):
    rows = [(n, f"http://h{n % 2}.org/{n}", page(n, "article")) for n in range(12)]
    # Without an element for the main text, the wrapper tells what all pages of a host have.
    rows += [(100 + n, f"http://plain.org/{n}", page(n, "div")) for n in range(12)]
    rows += [(200, None, None), (201, "http://x.org", ""), (202, "nohost", "just text"), (203, "http://x.org", "<p>cut <b"), (0, "http://h0.org/0", page(0, "article"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumns({c: F.lit("extra") for c in ("host", "text", "template", "reference", "pick")}).repartition(4)
    out = wrapper.extract(df).collect()
    assert len(out) == len(rows)
    found = {r.page_id: r for r in out}
    assert all(found[n].text == expected(n) for n in range(12))
    # "one" is on every plain page at the same place: template there, as is "Constant".
    assert all(found[100 + n].text == expected(n).replace("one\n", "") for n in range(12))
    assert [found[k].text for k in (200, 201, 202, 203)] == ["", "", "just text", "cut"]
    assert all(r.n_chars == len(r.text) for r in out)
    assert wrapper.extract(df.limit(0)).count() == 0


def test_names_do_not_hide_whole_pages():
    text = lambda page: [b.text for b in parse(page).blocks if not b.apart]
    story = "<h1>Title</h1><p>The story of the page, longer than all else.</p>"
    told = ["Title", "The story of the page, longer than all else."]
    for start, end in (
        ('<html class="no-sidebar">', "</html>"), ('<body class="has-banner">', "</body>"), ('<article class="comment-open">', "</article>"),
        ('<main id="search">', "</main>"), ("<form>", "</form>"), ('<div class="with-sidebar">', "</div>"), ('<form><div class="search">', "</div></form>"),
    ):
        assert text(f'{start}<nav>menu</nav>{story}<div class="ad">Buy</div>{end}<footer>foot</footer>') == told, start
    # A long advert or footer beside a short article stays apart, and so do comments in it.
    long = "much longer than the article is"
    assert text(f'<div class="ad">{long}</div><article>Short<div class="comments">{long} {long}</div></article><footer>{long}</footer>') == ["Short"]


def test_drawings_do_not_cut_a_page():
    text = lambda page: [b.text for b in parse(page).blocks if not b.apart]
    assert text('<p>one</p><svg class="x" viewBox="0 0 1 1"/><p>two</p><svg><path d="m"/><text>drawn</text></svg><p>three') == ["one", "two", "three"]
    assert text("<div>one<svg><g><path d='m'></div><p>two") == ["one", "two"]  # ends with what holds it
    assert text("<div>one<svg><g><path d='m'><p>two</p></div>three") == ["one", "two", "three"]  # a paragraph is no part of it
    assert text("<p>one</p><svg><foreignObject><p>drawn</p></foreignObject></svg><p>two") == ["one", "two"]


def test_deep_elements_are_aligned():
    matcher = Matcher()
    for depth in (61, 3000):
        a = matcher.finish(parse("<div>" * depth + "<p>same</p><h2>own</h2>"))
        b = matcher.finish(parse("<div>" * depth + "<ul><li>x</ul><p>same</p>"))
        found = matcher.align(a, b)
        assert found[a.labels.index("p")] == b.labels.index("p") and len(found) == depth + 2
        assert matcher.weight(a, 0, b, 0) == depth + 2


def test_slots_decide_also_where_pages_mark_other_text(spark):
    story = "<div><h2>Story {n}</h2><p>Long text of the story {n}, told in a plain element.</p></div>"
    html_ = f"<body><div>Same on all</div>{story}<article>Teaser {{n}}</article></body>"
    rows = [(n, f"http://many.org/{n}", html_.replace("{n}", str(n))) for n in range(25)]
    rows += [(100, "http://few.org", html_.replace("{n}", "100")), (101, "http://one.org", f"<p>by the way<article>{story}</article>".replace("{n}", "101"))]
    # No slot of this host is constant: it is judged all the same.
    rows += [(200 + n, f"http://vary.org/{n}", f"<body><p>Lead {n}</p><article>The longer text number {n}</article></body>") for n in range(6)]
    out = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda n: f"Story {n}\nLong text of the story {n}, told in a plain element."
    assert all(out[n] == f"{text(n)}\nTeaser {n}" for n in range(25))
    assert out[100] == f"Same on all\n{text(100)}\nTeaser 100" and out[101] == text(101)
    assert all(out[200 + n] == f"The longer text number {n}" for n in range(6))


@pytest.mark.parametrize("pages", [1, 4, 5, 25, 30])
def test_marked_articles_on_hosts_of_any_size(spark, pages):
    side = "<div>The Site's Name</div>{main}<div><p>More to read {n}</p>" + "".join(f"<p>Teaser {k} of page {{n}}, a few words</p>" for k in range(9)) + "</div><p>Page {n} of 9</p>"
    story = "<h1>Head</h1><p>One article told in two paragraphs, which are longer than any of the teasers beside it.</p><p>The second of them.</p>"
    text = "Head\nOne article told in two paragraphs, which are longer than any of the teasers beside it.\nThe second of them."
    kinds = {
        "copies": f"<article>{story}</article>",
        "main": f"<main>{story}</main>",
        "both": f"<main><div>Crumbs {{n}}</div><article>{story}</article></main>",
        "own": f"<article>{story}<p>By writer {{n}}</p></article>",
    }
    rows = [(k, n, f"http://{k}.org/{n}", f"<body>{side.replace('{main}', body)}</body>".replace("{n}", str(n))) for k, body in kinds.items() for n in range(pages)]
    rows += [("plain", n, f"http://plain.org/{n}", f"<body>{story}</body>") for n in range(pages)]
    df = spark.createDataFrame([(f"{k} {n}", url, body) for k, n, url, body in rows], "page_id string, url string, html string")
    out = {r.page_id: r.text for r in wrapper.extract(df).collect()}
    assert len(out) == len(rows)
    for k, n, _, _ in rows:
        assert out[f"{k} {n}"] == text + (f"\nBy writer {n}" if k == "own" else ""), (k, n)


def test_furniture_of_main_goes_and_the_rest_of_a_host_of_copies_stays(spark):
    rows = [(n, f"http://m.org/{n}", f"<main><div>Site</div><p>Story {n} in a few words</p><p>Its end {n}</p></main>") for n in range(6)]
    # Most pages of this host have one article; the pages of its other article keep theirs, too.
    rows += [(100 + n, f"http://c.org/{n}", f"<article><p>The same story</p><p>on most pages</p></article><p>{n}</p>") for n in range(24)]
    rows += [(124, "http://c.org/24", "<article><p>Another story</p><p>on most pages</p></article>")]
    out = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[n] == f"Story {n} in a few words\nIts end {n}" for n in range(6))
    assert all(out[100 + n] == "The same story\non most pages" for n in range(24)) and out[124] == "Another story\non most pages"


def test_given_pages_give_their_articles(spark):
    out = {r.page_id: r.text for r in queries.op10_html_extraction(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:h1|p|br)>", body)]
        assert out[r.page_id] == "\n".join(x for x in parts if x)


def test_tree_matching_is_the_most_common_nodes():
    matcher = Matcher()
    a = matcher.finish(parse("<div><p>1<p>2<ul><li>x</ul><p>3</div>"))
    b = matcher.finish(parse("<div><p>1<h1>t</h1><p>2<ul><li>y<li>z</ul></div>"))
    # root, div, two paragraphs, the list and one item.
    assert matcher.weight(a, 0, b, 0) == 6
    found = matcher.align(a, b)
    assert len(found) == 6 and all(a.labels[i] == b.labels[j] for i, j in found.items())


def test_deep_and_broken_pages_end():
    assert [b.text for b in parse("<div>" * 3000 + "deep").blocks] == ["deep"]
    deep = Matcher()
    tree = deep.finish(parse("<div>" * 3000 + "deep"))
    assert deep.align(tree, tree)[0] == 0
    assert [b.text for b in parse('<p title="x>y">a</p></b></p><p>b').blocks] == ["a", "b"]
    assert [b.text for b in parse("<p " + '"' * 5001 + ">a").blocks] in (["a"], [])


def test_pipeline_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = storage.materialize(stage(spark, kept[-1], FOLDER), name)
        assert out.columns == names and out.schema == docs.schema
        assert out.join(kept[-1], names, "left_anti").count() == 0
        kept.append(out)
    sizes = [df.count() for df in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    texts = [re.sub("[A-Z]", lambda m: m[0].lower(), r.text) for r in kept[3].collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[A-Z]", lambda m: m[0].lower(), r.text) for r in kept[2].collect()})
    pieces = corpus_pipeline.pack(spark, kept[-1], FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in kept[-1].select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "exact_dedup", "near_dedup", "packing"]


def test_pipeline_of_awkward_rows(spark, awkward, empty):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, FOLDER)
        assert out.columns == awkward.columns, name
        kept = out.collect()
        assert kept and stage(spark, empty, FOLDER).count() == 0
        if name == "exact_dedup":
            low = [(r.text or "").lower() for r in kept]
            assert len(low) == len(set(low))
    assert corpus_pipeline.pack(spark, awkward, FOLDER).count() >= awkward.count()
    assert awkward.select(*names).schema == spark.createDataFrame([], DOCS).schema
