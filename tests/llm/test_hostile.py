"""Column names that clash with internal ones, nulls, empty and long texts, repeated rows, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linequarry.llm import decontaminate, html_layout, langid, lm_score, minhash, mixing, passages, toxicity, url_rules, vectors

NAMES = """id n f1 f2 sig keys rep bucket c c1 c2 a b x y s t k h p i l u v w m r at end same rid rpos seed len own words rwords open digest most one
_of _id _gone _hit _spans _had _tie tokens weight last before full rest slices share step source_key run row set size other mine tiles tab cell vec dim mult cells
host domain suffix path bad node component comp item_id n_item n_shared score lang_pred doc word count held_out""".split()


def prose(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(0, 3000, n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    shared, near = prose(rng, 80), prose(rng, 120)
    texts = [prose(rng, 40) + " " + shared, prose(rng, 60) + " " + shared + " " + prose(rng, 20), near, near + " more", near, None, "", " \n ", prose(rng, 30_000), "w1 " * 500, "w1 " * 400, "x"]
    rows = [(k, t, "en" if k % 2 else "fr", "a" if k < 8 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[0], (3, "another text of number three", "en", "b", 28), (None, near, "en", "a", 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({name: F.lit(name) for name in NAMES})


@pytest.fixture(scope="module")
def items(spark, docs):
    text = docs.where("doc_id = 1").first().text
    return spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, "a b c d e f")], "item_id long, text string").withColumns({n: F.lit(1) for n in NAMES if n != "item_id"})


def labels_of(spark):
    return spark.createDataFrame([(k, 1, int(k < 3)) for k in range(12)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality long, toxic long").withColumns({n: F.lit(1) for n in NAMES})


STAGES = {
    "toxicity": lambda spark, docs, items: toxicity.drop_toxic(docs, toxicity.train(docs, labels_of(spark), learn_from=F.col("doc_id") >= 0)),
    "minhash": lambda spark, docs, items: minhash.keep_first(docs),
    "passages": lambda spark, docs, items: passages.cut_repeats(docs),
    "decontaminate": lambda spark, docs, items: decontaminate.drop_contaminated(docs, items),
}
OPERATORS = STAGES | {
    "mixing": lambda spark, docs, items: mixing.plan(docs, budget=1.5, max_epochs=4.0),
    "toxicity_scores": lambda spark, docs, items: toxicity.scores(docs, toxicity.train(docs, labels_of(spark), learn_from=F.col("doc_id") >= 0)),
    "near_duplicates": lambda spark, docs, items: minhash.near_duplicates(docs),
    "repeated_passages": lambda spark, docs, items: passages.repeated_passages(docs),
    "contained_items": lambda spark, docs, items: decontaminate.contained_items(docs, items),
    "langid": lambda spark, docs, items: langid.predict(docs, langid.train(docs, learn_from=F.col("doc_id") >= 0)),
    "lm": lambda spark, docs, items: lm_score.score_documents(docs, learn_from=F.col("doc_id") >= 0),
    "html": lambda spark, docs, items: html_layout.extract(docs, id_col="doc_id", html_col="text"),
    "urls": lambda spark, docs, items: url_rules.judge_urls(docs, labels_of(spark).drop("bad", "page_id").selectExpr("doc_id page_id", "toxic bad", "*"), [("org/", "allow")], id_col="doc_id", url_col="text"),
    "vectors": lambda spark, docs, items: vectors.near_vectors(docs.withColumn("embedding", F.array(F.col("doc_id").cast("double"), F.lit(1.0))), id_col="doc_id"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_any_column_names(spark, docs, items, name):
    rows = OPERATORS[name](spark, docs, items).collect()
    plain = OPERATORS[name](spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), items).collect()
    cols = [c for c in plain[0].asDict()]
    pick = lambda rs: sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols)]) for r in rs)
    assert pick(rows) == pick(plain)


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns_and_clean_rows(spark, docs, items, name):
    out = STAGES[name](spark, docs, items)
    assert out.columns == docs.columns
    assert {None, 5, 8} <= {r.doc_id for r in out.collect()}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, docs, items, name):
    assert OPERATORS[name](spark, docs.limit(0), items.limit(0)).count() == 0


def test_only_the_repeat_goes(spark, docs):
    got = {r.doc_id: r.text for r in passages.cut_repeats(docs.where("doc_id < 2")).collect()}
    whole = {r.doc_id: r.text for r in docs.where("doc_id < 2").collect()}
    assert got[0] == whole[0] and len(got[1].split()) == 80 and set(got[1].split()) <= set(whole[1].split())


def test_a_pair_just_under_the_limit_makes_no_group(spark):
    """Many texts of pairwise similarity a little under 0.8: no link, and none lost where there is one."""
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(60):
        own = base.copy()
        for x in rng.choice(200, 6, replace=False):
            own[x] = f"u{k}x{x}"
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2, percent=80).collect()}
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert got == dict(enumerate(root))
