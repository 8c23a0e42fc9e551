"""Classifiers, the language model, urls, pages and mixing."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linequarry.llm import gru, html_layout, langid, lm_score, mixing, toxicity, url_rules
from linequarry.llm.entries import URL_RULES, remainder

RNG = random.Random(7)
LETTERS = {"en": "the and with of ing er", "de": "der die und ein ung sch", "fr": "le les ère eau aux ê"}


def prose(lang, n, rng):
    parts = LETTERS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(8), []
    for k in range(400):
        lang = rng.choice(list(LETTERS))
        text = prose(lang, rng.randrange(10, 60), rng)
        toxic = rng.random() < 0.25
        if toxic:
            w = text.split(" ")
            w[rng.randrange(len(w))] = rng.choice(["vilescum", "moronic"])
            text = " ".join(w)
        rows.append((k, text, lang, toxic))
    rows += [(1000, None, "en", False), (1001, "", "en", False), (1002, "12 34!", "de", False), (1003, "der und", None, False), (1004, "x" * 200_000, "en", False)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, bad boolean").cache()


def test_language(spark, docs):
    model = langid.train(docs, remainder(5) != 0)
    got = {r.doc_id: r for r in langid.predict(docs.withColumn("score", F.lit(1)), model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [k for k in truth if k < 1000 and zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].lang_pred == truth[k] for k in held) >= 0.97 * len(held)
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "de" and 0 < got[1004].score <= 1
    none = langid.train(docs.where("doc_id < 0"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_temperature():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 4000)
    logits = np.eye(3)[y] * 1.0 + rng.gumbel(size=(4000, 3))  # argmax noise: true temperature near 1
    t = langid.fit_temperature(5 * logits, y)
    assert 4 < t / langid.fit_temperature(logits, y) < 6


def test_toxicity(spark, docs):
    labels = docs.where("doc_id < 1000 and doc_id % 2 = 0").select("doc_id", F.col("bad").cast("int").alias("toxic"))
    model = toxicity.train(docs, labels, remainder(3) != 1)
    got = {r.doc_id: r.score for r in toxicity.scores(docs.withColumn("score", F.lit(1)), model).collect()}
    truth = {r.doc_id: r.bad for r in docs.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all((got[k] >= 0.7) == truth[k] for k in held)
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s < 0.7}
    empty = toxicity.train(docs, labels.where("toxic = 9"), F.lit(True))
    assert max(r.score for r in toxicity.scores(docs, empty).collect()) < 1e-9


def test_nnpu_gradient():
    rng = np.random.default_rng(2)
    x = rng.random((300, 6)) < 0.2
    y = rng.random(300) < 0.3
    x[y, 0] = True
    x[~y, 0] = False
    rows, cols = np.nonzero(x)
    flag = y & (rng.random(300) < 0.5)
    w, b = toxicity.fit_nnpu(rows, cols, 6, flag, 0.2)
    t = x @ w + b
    assert w.min() >= 0 and t[y].min() > t[~y].max()


def test_language_model(spark, docs):
    out = lm_score.score_documents(docs, remainder(7) != 2, vocab=20, head=30, hidden=8)
    got = {r.doc_id: r for r in out.collect()}
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = {r.doc_id: re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().translate(low)) for r in docs.collect()}
    c = collections.Counter()
    for k, x in w.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update([*x, "end"])
    n, v = sum(c.values()), len(c)
    for k, x in w.items():
        tokens = [*x, "end"]
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens)
        assert math.isclose(got[k].base_score, base, rel_tol=1e-9)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(tokens), sum(c[t] > 0 for t in tokens), n)
    held = [k for k in w if zlib.crc32(str(k).encode()) % 7 == 2]
    assert sum(got[k].score for k in held) > sum(got[k].base_score for k in held)
    assert lm_score.score_documents(docs.where("doc_id < 0"), F.lit(True)).count() == 0
    assert all(r.base_score == 0 for r in lm_score.score_documents(docs.limit(3), F.lit(False)).collect())


def test_model_is_a_distribution_and_carries_its_state():
    rng = np.random.default_rng(3)
    m = {k: x.astype(float) for k, x in gru.new_model(rng.integers(1, 50, 70), 20, 4, 5).items()}
    for x in m.values():
        x += rng.standard_normal(x.shape) * 0.2
    m["bw"][-1, 70 % gru.SIZE :] = -60.0  # places without a word
    h = rng.standard_normal((1, 5))
    total = sum(np.exp(gru.output_log(m, h, np.array([k]), 70))[0] for k in range(71))
    assert abs(total - 1) < 1e-9
    texts = [np.append(rng.integers(1, 74, rng.integers(0, 30)), 0) for _ in range(20)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = gru.score(m, np.concatenate(texts), first, 70)
    for t, s in zip(texts, whole):
        state, last, log = np.zeros((1, 5)), np.array([0]), 0.0
        for x in t:
            state, _ = gru.step(m, state, last)
            last = np.array([x])
            log += gru.output_log(m, state, last, 70)[0]
        assert math.isclose(s, log / math.log(10), rel_tol=1e-6, abs_tol=1e-6)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    texts = [np.append(np.tile([1, 2, 3, 4], rng.integers(3, 9)), 0) for _ in range(300)]
    m = gru.new_model(np.ones(5), 0, 2, 8)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    before = gru.score(m, np.concatenate(texts), first, 5).sum()
    gru.train(m, texts, 5, streams=8, epochs=8, rate=0.02)
    assert gru.score(m, np.concatenate(texts), first, 5).sum() > before / 4


URLS = [
    ("http://WWW.Example.ORG/es/1", "www.example.org", "/es/1", "example.org/es/", "block"), ("https://a.example.org/en/12?x#y", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"), ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"),
    ("http://notexample.org", "notexample.org", "", None, "allow"), ("http://h?/a", "h", "", None, "allow"), ("mailto:x", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u[0], "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_rules.judge_urls(pages, none, URL_RULES).collect()}
    assert got == {k: u[1:4] for k, u in enumerate(URLS)}
    said = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, none, URL_RULES, max_bad=0.9).collect()}
    assert said == {k: u[4] for k, u in enumerate(URLS)}
    assert url_rules.judge_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_reputation_shrinks(spark):
    rng = random.Random(9)
    rows = [(k, h) for k, h in enumerate(["bad.evil.net"] * 60 + ["new.evil.net"] * 3 + ["ok.fine.net"] * 200 + ["rare.other.net"])]
    pages = spark.createDataFrame([(k, f"http://{h}/x") for k, h in rows], "page_id long, url string")
    bad = spark.createDataFrame([(k, int(rng.random() < (0.9 if "evil" in h else 0.05))) for k, h in rows if "new" not in h and "rare" not in h] + [(None, 1), (5, None)], "page_id long, bad int")
    got = {r.host: r for r in url_rules.judge_urls(pages, bad, []).dropDuplicates(["host"]).collect()}
    assert got["bad.evil.net"].verdict == "block" and got["ok.fine.net"].verdict == "allow"
    assert got["new.evil.net"].bad_rate > 0.6 > got["rare.other.net"].bad_rate > got["ok.fine.net"].bad_rate
    assert got["rare.other.net"].bad_rate - got["rare.other.net"].bad_low > got["ok.fine.net"].bad_rate - got["ok.fine.net"].bad_low


PAGES = [
    ("<p>One <b>two</b> three<br>four<p>next", "One two three\nfour\n\nnext"), ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
    ("<table><tr><th>Name<th>Qty<tr><td>long name<td>3<tr><td>x<td>10</table>", "Name       Qty\nlong name  3\nx          10"), ("a<script>b</script><style>c</style><!-- d --><template>e</template>f", "af"),
    ("<div hidden>x</div><div style='display: none'>y</div><div>z</div>", "z"), ("<style>.ad,p.q{display:none}</style><p class='big ad'>x<p class=q>y</p><i class=q>z</i>", "z"), ("a &amp; b &lt;c&gt; &copy", "a & b <c> ©"), ("<pre>\n x  y\n  z</pre>t", " x  y\n  z\n\nt"),
    ("x < y <b>z", "x < y z"), ("<div>a</div></div></p>b<td>c", "a\nb\nc"), ("<blockquote>q<p>w</blockquote>", "  q\n\n  w"), ("", ""), (None, ""), ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<head><title>t</title><p>body", "body"), ("<a href='x>y'>k</a>", "k"), ("<h1>a</h1>b", "a\n\nb"), ("<b>" * 5000 + "deep", "deep"), ("<table>" * 300 + "t", "t"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_page(html, text):
    assert html_layout.page_text(html) == text


def test_pages(spark):
    df = spark.createDataFrame([(k, h, "t") for k, (h, _) in enumerate(PAGES)] + [(None, "x", "t")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_layout.extract(df).collect()}
    assert got == {k: t for k, (_, t) in enumerate(PAGES)} | {None: "x"}
    assert html_layout.extract(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(10)
    rows = [(k, rng.choices(["big", "mid", "small", None], [60, 25, 10, 5])[0], " ".join("w" for _ in range(rng.randrange(1, 60)))) for k in range(900)] + [(2000, "void", ""), (2001, "void", None)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").cache(), rows


def test_mixing_keeps_every_document(sources):
    docs, rows = sources
    got = mixing.plan(docs, budget=None, max_epochs=2.0, block_tokens=2000, slice_rows=50).collect()
    times = collections.Counter(r.doc_id for r in got)
    assert set(times) == {r[0] for r in rows} and max(times.values()) == 2
    tokens = collections.Counter()
    for r in got:
        tokens[r.source] += r.mix_tokens
    own = collections.Counter()
    for _, s, t in rows:
        own[s] += len((t or "").split())
    epochs = {s: tokens[s] / own[s] for s in own if own[s]}
    assert abs(max(epochs.values()) - 2) < 0.05 and epochs["big"] == 1
    blocks = collections.defaultdict(collections.Counter)
    for r in got:
        blocks[r.mix_block][r.source] += r.mix_tokens
    total = sum(tokens.values())
    for b in list(blocks)[:-2]:
        if b < max(blocks) - 1:
            assert all(abs(blocks[b][s] - 2000 * tokens[s] / total) < 130 for s in own if own[s])


def test_mixing_budget_and_entropy(spark, sources):
    docs, rows = sources
    own = collections.Counter()
    for _, s, t in rows:
        own[s] += len((t or "").split())
    total = sum(own.values())
    got = mixing.plan(docs, budget=0.5, max_epochs=None, min_entropy=1.2, slice_rows=50).collect()
    used = collections.Counter()
    for r in got:
        used[r.source] += r.mix_tokens
    assert abs(sum(used.values()) - total / 2) < 250
    share = [used[s] / sum(used.values()) for s in used if used[s]]
    assert -sum(p * math.log(p) for p in share) > 1.18
    one = mixing.plan(docs, budget=1.0, max_epochs=1.0, slice_rows=50)
    assert one.count() == len(rows) and one.agg(F.max("mix_epoch")).first()[0] == 0
    assert mixing.plan(docs.limit(0)).count() == 0
    order = lambda: sorted((r.doc_id, r.mix_epoch, r.mix_block, r.mix_key) for r in mixing.plan(docs, slice_rows=50).collect())
    assert order() == order()
