"""Near-duplicates, passages, vectors and benchmark items against brute force."""

import random
import re

import numpy as np
import pytest

from linequarry.llm import decontaminate, graph, minhash, passages, vectors
from linequarry.llm.tables import Scratch

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = {k: " ".join(prose(rng, rng.randrange(20, 120))) for k in range(60)}
    for k in range(60, 120):
        w = out[rng.randrange(60)].split(" ")
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "edit"
        out[k] = " ".join(w)
    base = prose(rng, 100)
    for k in range(120, 150):  # a chain: neighbours are alike, ends are not
        base = [x if rng.random() > 0.02 else "v" for x in base]
        out[k] = " ".join(base)
    out |= {150: "", 151: None, 152: "  \n", 153: "One", 154: "one", 155: "one two", 156: out[0].upper(), 157: out[1], 158: out[1]}
    return out


def test_near_duplicates(spark, texts):
    for width, percent in ((2, 80), (5, 80)):
        docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, id string")
        sets = {k: shingles(t, width) for k, t in texts.items()}
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = components(sets, links)
        got = {r.doc_id: r for r in minhash.near_duplicates(docs, width=width, percent=percent, tile=8).collect()}
        assert {k: r.component_id for k, r in got.items()} == want
        assert all(r.n_shingles == len(sets[k]) and r.kept == (want[k] == k) for k, r in got.items())


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string, extra int"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 2), (3, "a b c d e f", 3), (4, None, 4)]
    docs = spark.createDataFrame(rows, schema)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == 5 and {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (None, None, True), (3, 1, False), (4, 4, True)}
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted(docs.where("doc_id is null or doc_id <> 3").collect(), key=str)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2300)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(df, Scratch(spark)).collect()}
    nodes = {x for e in edges for x in e if x is not None}
    want = components(nodes, [e for e in edges if None not in e])
    assert all(got.get(n, n) == want[n] for n in nodes)
    assert graph.connected_components(df.where("a > 99999"), Scratch(spark)).count() == 0


def test_passages(spark):
    rng = random.Random(3)
    shared, fuzzy = prose(rng, 70), prose(rng, 90)
    out = {k: prose(rng, rng.randrange(5, 200)) for k in range(60)}
    holders = {"exact": [4, 9, 20, 33], "fuzzy": [5, 21, 40]}
    for k in holders["exact"]:
        at = rng.randrange(len(out[k]))
        out[k][at:at] = shared
    for n, k in enumerate(holders["fuzzy"]):
        p = list(fuzzy)
        if n:
            p[30] = "changed"
            del p[60]
        at = rng.randrange(len(out[k]))
        out[k][at:at] = p
    rows = [(k, " ".join(w), 1) for k, w in out.items()] + [(100, None, 1), (101, "", 1), (None, " ".join(shared), 1), (102, "a b", 1), (4, " ".join(out[4]), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s int")
    got = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {9, 20, 33, 21, 40}
    for r in got:
        mine = out[r.doc_id][r.start_word : r.end_word]
        if r.doc_id in holders["exact"]:
            assert r.first_id == 4 and abs(len(mine) - 70) <= 2 and r.n_same >= 70 and " ".join(shared[2:-2]) in " ".join(mine)
        else:
            assert r.first_id in (5, 21) and r.n_same >= 0.8 * len(mine)
    for k in (21, 40):  # pieces of one passage may start in different documents
        assert len({i for r in got if r.doc_id == k for i in range(r.start_word, r.end_word)}) >= 84
    cut = {r.doc_id: r.text for r in passages.cut_repeats(docs).where("doc_id is not null").collect()}
    assert cut[4] == " ".join(out[4]) and cut[101] == "" and cut[100] is None and cut[102] == "a b"
    assert sum(" ".join(shared[5:-5]) in (t or "") for t in cut.values()) == 1
    assert all(cut[k] == " ".join(out[k]) for k in out if k not in {9, 20, 33, 21, 40})


def test_passages_edges(spark):
    schema = "doc_id long, text string, id int"
    assert passages.repeated_passages(spark.createDataFrame([], schema)).count() == 0
    rng = random.Random(4)
    whole = " ".join(prose(rng, 80))
    docs = spark.createDataFrame([(1, whole, 1), (2, whole, 1), (3, "x " + whole, 1)], schema)
    assert {r.doc_id: r.text for r in passages.cut_repeats(docs).collect()} == {1: whole, 3: "x"}


def test_align_finds_borders():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(60, 300))
        core = rng.integers(10_000, 20_000, n).astype(np.uint64)
        other = list(core)
        other[n // 3] = 5
        del other[n // 2]
        side = [rng.integers(0, 9_000, 20).astype(np.uint64) for _ in range(4)]
        a, b = np.concatenate([side[0], core, side[1]]), np.concatenate([side[2], np.array(other, np.uint64), side[3]])
        s, e, same = passages.align(a, b, 0, 1)
        assert abs(s - 20) <= 2 and abs(e - 20 - n) <= 2 and same >= n - 4


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((120, 16))
    x = [v / np.linalg.norm(v) for v in base]
    for k in range(120):
        v = x[k % 20] + rng.standard_normal(16) * 0.045
        x.append(v)
    x += [x[0], x[0] * 3, x[1]]
    rows = [(k, [float(f) for f in v]) for k, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1.0] * 8), (906, [1.0] * 8)]
    for kind in ("double", "float"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        m = np.array([v for k, v in rows[: len(x)]]).astype(np.float32 if kind == "float" else float).astype(float)
        m /= np.linalg.norm(m, axis=1)[:, None]
        near = m @ m.T >= 0.95
        links = [(int(a), int(b)) for a, b in np.argwhere(near) if a < b] + [(905, 906)]
        want = components([k for k, _ in rows], links)
        counts = {k: sum(k in p for p in links) for k, _ in rows}
        got = {r.vec_id: r for r in vectors.near_vectors(df, tile=16).collect()}
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got.values())
        assert found >= 0.98 * sum(counts.values()) and all(r.n_links <= counts[k] for k, r in got.items())
        assert sum(r.component_id == want[k] for k, r in got.items()) >= len(rows) - 3
        assert all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903, 904)) and got[905].n_links == 1
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_benchmark_items(spark):
    rng = random.Random(6)
    items = {k: prose(rng, rng.choice([3, 6, 14, 30, 59, 140])) for k in range(40)}
    docs = {k: prose(rng, rng.choice([1, 30, 300, 3000])) for k in range(60)}
    for k in range(30):
        item, doc = items[rng.randrange(40)], docs[rng.randrange(60)]
        part = list(item)
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = "typo"
        at = rng.randrange(len(doc) + 1)
        doc[at:at] = part
    half = items[3]
    docs[70] = half[: len(half) // 2] + prose(rng, 500) + half[len(half) // 2 - 4 :]
    docs[71] = ["only", "two"]
    items[50] = ["Only", "TWO"]
    d = spark.createDataFrame([(k, " ".join(w), 0) for k, w in docs.items()] + [(80, None, 0), (81, "", 0)], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(k, " ".join(w), 0) for k, w in items.items()] + [(60, None, 0), (61, "", 0), (None, "a b c", 0)], "item_id long, text string, doc_id int")
    want = set()
    for a, w in docs.items():
        for b, q in items.items():
            x, y = shingles(" ".join(w), 5), shingles(" ".join(q), 5)
            if y and 100 * len(x & y) >= 80 * len(y):
                want.add((a, b, len(y), len(x & y)))
    for block in (4_000_000, 500):
        got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contained_items(d, i, block_bytes=block).collect()}
        assert got == want and len(want) > 10
    left = {r.doc_id for r in decontaminate.drop_contaminated(d, i).collect()}
    assert left == (set(docs) | {80, 81}) - {a for a, *_ in want}
    assert decontaminate.contained_items(d, i.where("item_id > 99")).count() == 0


def test_chains_are_not_hidden_by_a_far_diagonal():
    far = [[0, 300, 0, 300]]
    fuzzy = [[450 + 14 * k, 461 + 14 * k, 300 + 13 * k, 311 + 13 * k] for k in range(8)]
    got = passages.chains_of(np.array(far + fuzzy), 0.1, 12)
    assert [c.tolist() for c in got] == [far, fuzzy]
    # without the far anchor the same chain
    assert [c.tolist() for c in passages.chains_of(np.array(fuzzy), 0.1, 12)] == [fuzzy]


def test_fuzzy_passages_are_found(spark):
    rng = random.Random(8)
    for percent, floor in ((82, 0.9), (85, 0.95), (90, 0.97)):
        rows, spans = [], {}
        for k in range(100):
            p = prose(rng, 60, 10**6)
            q = list(p)
            for x in rng.sample(range(60), 60 - 60 * percent // 100):
                q[x] = "other"
            at = rng.randrange(100)
            rows.append((2 * k, " ".join(prose(rng, 80, 10**6) + p + prose(rng, 80, 10**6))))
            rows.append((2 * k + 1, " ".join(prose(rng, at, 10**6) + q + prose(rng, 80, 10**6))))
            spans[2 * k + 1] = set(range(at, at + 60))
        got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(r.first_id == r.doc_id - 1 and set(range(r.start_word, r.end_word)) <= spans[r.doc_id] for r in got)
        found = {r.doc_id for r in got}
        print(percent, len(found))
        assert len(found) >= floor * 100


def test_long_passages_extend_past_the_margin(spark):
    rng = random.Random(9)
    p = prose(rng, 900, 10**6)
    q = [x if n % 6 or 400 <= n < 410 else "other" for n, x in enumerate(p)]
    rows = [(1, " ".join(prose(rng, 30, 10**6) + p)), (2, " ".join(prose(rng, 50, 10**6) + q + prose(rng, 20, 10**6)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), k=8).collect()
    assert len(got) == 1 and got[0].first_id == 1 and got[0].start_word <= 53 and got[0].end_word >= 947


def test_passages_whose_parts_stand_elsewhere(spark):
    rng = random.Random(10)
    rows, want = [], set()
    for k in range(40):
        c, base = prose(rng, 60, 10**6), 100 * k
        if k % 2:  # a stock line of 40 words
            rows.append((base, " ".join(prose(rng, 50, 10**6) + c[:40])))
        else:  # each run of up to nine words stands in an earlier document
            rows += [(base + a, " ".join(prose(rng, 20, 10**6) + c[max(0, a - 4) : a + 10] + prose(rng, 20, 10**6))) for a in range(0, 60, 6)]
        rows += [(base + x, " ".join(prose(rng, 40, 10**6) + c + prose(rng, 40, 10**6))) for x in (80, 81)]
        want.add((base + 81, base + 80))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_id) for r in got} == want
    assert all(r.start_word == 40 and r.end_word == 100 for r in got)


def test_short_benchmark_items():
    rng = random.Random(11)
    items = {k: prose(rng, 5 + k % 5, 10**6) for k in range(1000)}
    block = decontaminate._item_block([(k, " ".join(w)) for k, w in items.items()], 5, *([80] if "percent" in decontaminate._item_block.__code__.co_varnames else []), 48, 41)
    docs = [" ".join(prose(rng, 300, 10**6) + w + prose(rng, 300, 10**6)) for w in items.values()]
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(1000)), pa.array(docs)], names=["doc_id", "text"])
    got = {(r["doc_id"], r["item_id"]) for b in decontaminate._finder(block, 5, 80, 48, 41)([batch]) for r in b.to_pylist()}
    print("found", len(got))
    assert got == {(k, k) for k in items}


def test_planted_near_vectors_are_linked(spark):
    """12,000 vectors with 1,000 pairs just over the limit and 300 just under it: recall of the former, none of the latter."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12_000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(1300):
        c = 0.951 if k < 1000 else 0.949
        side = x[2 * k + 1] - (x[2 * k + 1] @ x[2 * k]) * x[2 * k]
        x[2 * k + 1] = c * x[2 * k] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x[::3] *= 1e-200
    x[1::3] *= 1e200
    got = vectors.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    linked = {r.vec_id for r in got if r.n_links}
    assert len(got) == 12_000 and len(linked & set(range(2000))) >= 1980 and not linked - set(range(2000))
    unit = x / np.abs(x).max(axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    asked = np.arange(0, 12_000, 100)  # against brute force over all rows
    exact = (unit[asked] @ unit.T >= 0.95).sum(axis=1) - 1
    by = {r.vec_id: r.n_links for r in got}
    assert all(by[int(a)] <= n for a, n in zip(asked, exact)) and sum(by[int(a)] for a in asked) >= 0.95 * exact.sum()


def test_vectors_of_one_id(spark):
    """Equal ones are copies; of different ones the same one counts in any order of the rows."""
    a, b = [1.0, 0.0, 0.5], [0.0, 1.0, -2.0]
    rows = [(1, a), (1, b), (2, a), (3, b), (4, [1e200, 1e200, 0.0]), (5, [1e200, 1.0001e200, 0.0])]
    got = [{(r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(x, "vec_id long, embedding array<double>")).collect()} for x in (rows, rows[::-1])]
    assert got[0] == got[1] and {(4, 1, 4), (5, 1, 4)} <= got[0]
