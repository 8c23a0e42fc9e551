"""Compiled columns against a byte-wise Python version."""

import random
import re

import pytest

from linequarry.functions.expr import parse
from linequarry.operators import search as se

TEXTS = {
    1: "The needle is here\r\nno\r\r\nNEEDLE needle needle\n",
    2: "",
    3: "Åfoo ÅFOO\nêfoo bar foo\nword_foo foo-bar\n",
    4: "auth_12 token_7\nauth\ntoken_9 auth_x\n\n",
    5: "a.b aXb\nERR42: color\nERR42: colr\nINFO: colouur\n",
    6: "bin\u0000ary needle",
    7: "tail without end needle",
}
QUERIES = [
    "lit:needle", "needle", "prefix:The", "suffix:needle", "re:needle", r"re:\bfoo\b", r"re:(?i)\bfoo\b", "re:(?i)needle", "re:foo|color", r"re:a\.b", r"re:a.b", r"re:auth_\d+", r"re:ERR\d+: colou?r", "re:^$", "re:", "re:o*",
    "lit:auth && re:token_\\d", "lit:needle || re:ERR\\d || prefix:word", r"re:\w+\s+is\s+\w+", "lit:foo", "re:[[:upper:]]{3}", r"re:(?P<c>o)(?P=c)", r"re:fo\Ko", "lit:Å", r"re:\d{2}", "re:fo{0,1}o b", "re:(?i)FOO|auth",
]


def oracle_lines(text):
    return [s.rstrip("\r") for s in text.split("\n")]


def oracle_find(p, line, fold):
    raw = line.encode().decode("latin-1")
    value = p.value.encode().decode("latin-1")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if p.kind == "regex":
        import regex

        if not line:
            return 0, 0
        if fold:  # PCRE folds these classes
            value = value.replace("[:upper:]", "[:alpha:]")
        rx = regex.compile(value, regex.A | (regex.I if fold else 0))
        found = [m.start() + 1 for m in rx.finditer(raw)]
        return (found[0] if found else 0), len(found)
    if fold:
        raw, value = raw.translate(low), value.translate(low)
    if p.kind == "prefix":
        return int(raw.startswith(value)), 0
    if p.kind == "suffix":
        return (len(raw) - len(value) + 1 if raw.endswith(value) else 0), 0
    return raw.find(value) + 1, raw.count(value)


def oracle_hits(texts, query, fold):
    plan, out = parse(query), []
    for k, text in texts.items():
        if text is None or "\0" in text[:1024]:
            continue
        for n, line in enumerate(oracle_lines(text), 1):
            cols = [oracle_find(p, line, fold)[0] for p in plan.predicates]
            good = [c for c in cols if c]
            if good and (plan.mode == "any" or len(good) == len(cols)):
                out.append((k, n, min(good), line))
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()) + [(8, None)], "doc_id long, text string").cache()


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("query", QUERIES)
def test_hits(docs, query, fold):
    want = oracle_hits(TEXTS, query, fold)
    for prefilter in (True, False):
        got = sorted(tuple(r) for r in se.hits(docs, query, fold=fold, prefilter=prefilter).collect())
        assert got == want


def test_random_patterns(spark):
    rng = random.Random(5)
    texts = {k: "\n".join("".join(rng.choice("abAB. é") for _ in range(rng.randrange(12))) for _ in range(4)) for k in range(25)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").cache()
    for _ in range(12):
        parts = ["".join(rng.choice(["a", "b", "A", ".", "[ab]", "é", r"\.", "a+", "b?", r"\w", r"\b"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3))]
        query = rng.choice([" && ", " || "]).join(rng.choice(["re:", "lit:", "prefix:", "suffix:"]) + p for p in parts)
        got = sorted(tuple(r) for r in se.hits(docs, query).collect())
        assert got == oracle_hits(texts, query, False), query


@pytest.mark.parametrize(("query", "want"), [("lit:needle", 4), ("re:needle", 4), ("re:(?i)needle", 5), (r"re:\bfoo\b", 3), ("re:foo|color", 4), ("prefix:ERR", 2), ("re:o", None), ("lit:foo && lit:bar", 2), (r"re:\w+\s+is\s+\w+", 1)])
def test_counts(docs, query, want):
    if want is None:
        want = sum(line.count("o") for k, t in TEXTS.items() if k != 6 for line in oracle_lines(t))
    assert se.count_matches(docs, query).first().matches == want


def test_report(docs):
    r = se.report(docs, "lit:needle").first()
    sizes = {k: len(t.encode()) for k, t in TEXTS.items()}
    assert (r.files_discovered, r.files_scanned, r.files_skipped, r.matches, r.files_matched, r.files_pruned) == (7, 6, 1, 3, 2, 4)
    assert r.bytes_scanned == sum(n for k, n in sizes.items() if k != 6) and r.bytes_pruned == sum(sizes[k] for k in (2, 3, 4, 5))
    assert r.slowest_bytes == max(n for k, n in sizes.items() if k != 6)


def test_pruning_never_loses(docs):
    for query in QUERIES:
        assert se.prune_stats(docs, query).first().lost == 0, query


def test_index_division_and_candidates(docs):
    index = se.trigram_index(docs)
    assert sorted(r.doc_id for r in se.divide(index, "lit:needle").collect()) == [1, 7]
    found = se.candidates(docs, "lit:needle")
    assert sorted(tuple(r) for r in se.search_candidates(docs, found, "lit:needle").collect()) == oracle_hits(TEXTS, "lit:needle", False)


def test_max_hits_is_global(docs):
    assert [(r.doc_id, r.line) for r in se.hits(docs, "lit:needle", max_hits=2).collect()] == [(1, 1), (1, 3)]


def test_empty_table_and_extra_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, line string, column string, content string")
    assert se.hits(none, "lit:x").count() == 0 and se.count_matches(none, "lit:x").first().matches == 0
    one = none.union(spark.createDataFrame([(1, "ax", "l", "c", "d")], none.schema))
    assert [tuple(r) for r in se.hits(one, "lit:x").collect()] == [(1, 1, 2, "ax")]


def test_needle_reaches_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = se.hits(docs, "lit:needle")._jdf.queryExecution().toString()
    assert "StringContains(text,needle)" in plan and re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)


def test_divide_evaluates_every_group(spark):
    from linequarry.errors import QueryError

    docs = spark.createDataFrame([(1, "abc only"), (2, "xyz only"), (3, "abc xyz"), (4, "neither")], "doc_id long, text string")
    index = se.trigram_index(docs)
    keys = lambda q: sorted(r.doc_id for r in se.divide(index, q).collect())
    assert keys("lit:abc || lit:xyz") == [1, 2, 3] and keys("lit:abc && lit:xyz") == [3] and keys("lit:abc && lit:x") == [1, 3]
    for query in ("lit:ab", "lit:abc || lit:x"):
        with pytest.raises(QueryError):
            se.divide(index, query)


def test_hit_limits_go_through(spark):
    docs = spark.createDataFrame([(1, "\n".join(["hit"] * 5000))], "doc_id long, text string")
    assert se.hits(docs, "lit:hit", max_hits=4500).count() == 4500 and se.hits(docs, "lit:hit").count() == 5000


def test_report_names_a_path(spark):
    docs = spark.createDataFrame([("b.txt", "hit here"), ("a.txt", "hit here"), ("c", "x")], "path string, text string")
    row = se.report(docs, "lit:hit", "path").first()
    assert (row.slowest_key, row.slowest_bytes, row.matches) == ("a.txt", 8, 2)
