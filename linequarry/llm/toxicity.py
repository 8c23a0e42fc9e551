"""Toxicity by non-negative positive-unlabelled learning (numpy, linear).

Confirmed toxic texts are the positives P, other texts the unlabelled U, which
hold toxic texts too.  With the class prior pi the risk of a score t(x) is

    pi E_P[l(t)] + max(0, E_U[l(-t)] - pi E_P[l(-t)]),   l = logistic loss,

and where the second part turns negative its gradient is followed upwards
instead (the non-negative correction), so a flexible model can't profit from
calling every unlabelled text clean.  pi is the share of toxic rows among the
labelled training rows, or is given.

Features are the distinct byte 4-grams inside words and the distinct words of
the whole text, by 64-bit key.  The model takes those, at most
``max_features``, that are over ``min_lift`` times as common among P as among
clean texts (whose share follows from those in U and P and from pi) and too
common for chance, given how many keys there are.  A key in under ``min_share``
of P is left out: passages and copies that some toxic texts share would
otherwise pass for toxic words.
Slope and shift of the score are then set by the convex form of the same risk.

The fit uses at most ``max_positive`` and ``max_unlabelled`` rows (by hash of
their id); scoring is one map over all texts, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, unused
from .textops import LOWER, Tokenizer, binary_array, chunks, mix64

GRAM = 4


def _features(buf, words):
    """(key, document) of every 4-gram inside a word and every word, repeated ones included."""
    low = LOWER[buf].astype(np.uint64)
    long_ = words.end - words.start >= GRAM
    n = (words.end - words.start - GRAM + 1)[long_]
    if len(n):
        at = np.repeat(words.start[long_] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = low[at] | low[at + 1] << np.uint64(8) | low[at + 2] << np.uint64(16) | low[at + 3] << np.uint64(24)
        doc = np.repeat(words.doc[long_], n)
    else:
        key, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([key, words.hash | np.uint64(1 << 63)]), np.concatenate([doc, words.doc])


def _collect_features():
    def run(batches):
        tok = Tokenizer()
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(2)):
                key, doc = _features(buf, tok.words(buf, off))
                order = np.argsort(doc, kind="stable")
                key, doc = key[order], doc[order]
                at = np.searchsorted(doc, np.arange(j - i + 1))
                sets = [np.unique(key[at[k] : at[k + 1]]) for k in range(j - i)]
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), binary_array(np.concatenate(sets), bounds)], names=["h", "positive", "keys"])

    return run


def _sigmoid(t):
    return 1 / (1 + np.exp(-np.clip(t, -60, 60)))


def fit_nnpu(rows, cols, n_features, positive, prior, epochs=800, lr=0.1, l1=0.02, batch=1 << 30, seed=3):
    """Weights and bias; rows, cols: coordinates of the present features, positive: mask over rows."""
    n = len(positive)
    w, b = np.zeros(n_features), np.log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    order = np.argsort(rows, kind="stable")
    rows, cols = rows[order], cols[order]
    at = np.searchsorted(rows, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    step = 0
    batches = max(1, -(-len(unl) // batch))
    for epoch in range(epochs):
        groups = zip(np.array_split(rng.permutation(pos), batches), np.array_split(rng.permutation(unl), batches))
        for ps, us in groups:
            if not len(ps):
                ps = rng.choice(pos, 1)
            some = np.concatenate([ps, us])
            size = at[some + 1] - at[some]
            idx = np.repeat(at[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            r, c = np.repeat(np.arange(len(some)), size), cols[idx]
            t = np.bincount(r, w[c], len(some)) + b
            p, is_p = _sigmoid(t), np.arange(len(some)) < len(ps)
            soft = np.logaddexp(0, t)
            negative_risk = soft[~is_p].mean() - prior * soft[is_p].mean()
            wp, wu = prior / len(ps), 1 / len(us) if len(us) else 0.0
            if negative_risk >= 0:
                g = np.where(is_p, wp * (p - 1) - wp * p, wu * p)
            else:
                g = np.where(is_p, wp * p, -wu * p)
            grad = np.append(np.bincount(c, g[r], n_features), g.sum())
            step += 1
            rate = lr * (1 - 0.9 * epoch / epochs)
            m = 0.9 * m + 0.1 * grad
            v = 0.99 * v + 0.01 * grad * grad
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w -= move[:-1]
            b -= move[-1]
            w = np.maximum(0, w - rate * l1)  # keys were chosen as signs of toxicity, none may excuse a text
    return w, b


def calibrate(t, positive, prior, ridge=1e-3, steps=100):
    """(slope, shift) of a score that minimise E_U[log(1 + exp(t))] - pi E_P[t], the convex form of the same risk."""
    wp, wu = prior / max(1, positive.sum()), 1 / max(1, (~positive).sum())
    x = np.stack([t, np.ones_like(t)], 1)
    at = np.array([1.0, 0.0])

    def risk(v):
        s = x @ v
        return wu * np.logaddexp(0, s[~positive]).sum() - wp * s[positive].sum() + 0.5 * ridge * (v - [1.0, 0.0]) @ (v - [1.0, 0.0])

    for _ in range(steps):
        p = _sigmoid(x @ at)
        g = x[~positive].T @ (wu * p[~positive]) - wp * x[positive].sum(axis=0) + ridge * (at - [1.0, 0.0])
        q = wu * (p * (1 - p))[~positive]
        move = np.linalg.solve((x[~positive] * q[:, None]).T @ x[~positive] + ridge * np.eye(2), g)
        rate = 1.0
        while rate > 1e-6 and risk(at - rate * move) > risk(at):
            rate /= 2
        at = at - rate * move
        if np.abs(rate * move).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, max_positive: int = 1500, max_unlabelled: int = 6000, max_features: int = 3000, min_share: float = 0.02, margin: float = 0.5, min_lift: float = 4.0, prior: float | None = None) -> dict:
    """A model for ``scores``.  Without any confirmed toxic row it scores every text 0."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learn_from)
    total, bad = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not bad:
        return {"keys": np.zeros(0, np.uint64), "w": np.zeros(0), "b": -60.0}
    prior = prior or min(0.9, max(1e-4, bad / total))
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rate = min(1.0, 1.1 * max_positive / bad)
    # in the order of the hash, so every run draws the same; at most max_positive ids are broadcast
    positive = known.where((F.col("toxic") == 1) & (h < rate)).select(F.col("doc_id").alias("k"), h.alias("o")).orderBy("o", "k").limit(max_positive).select("k")
    a = docs.select("doc_id", text).join(F.broadcast(positive), F.col("doc_id") == F.col("k")).select(h.alias("h"), F.lit(True).alias("p"), "text")
    pool = docs.where(learn_from)
    n = pool.count()
    b = pool.where(h < min(1.0, 1.1 * max_unlabelled / max(n, 1))).select(h.alias("h"), F.lit(False).alias("p"), text)
    got = a.union(b).mapInArrow(_collect_features(), "h double, positive boolean, keys binary").toArrow().sort_by([("h", "ascending"), ("keys", "ascending")])
    flag = got["positive"].to_numpy()
    use = np.sort(np.concatenate([np.flatnonzero(flag)[:max_positive], np.flatnonzero(~flag)[:max_unlabelled]]))
    got, flag = got.take(pa.array(use)), flag[use]
    if not flag.any():
        return {"keys": np.zeros(0, np.uint64), "w": np.zeros(0), "b": -60.0}
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in got["keys"]]
    np_, nu = max(1, int(flag.sum())), max(1, int((~flag).sum()))
    kp, cp = np.unique(np.concatenate([s for s, f in zip(sets, flag) if f]), return_counts=True)
    enough = cp >= max(min(3, max(1, np_ // 8)), min_share * np_)
    kp, cp = kp[enough], cp[enough]
    cu = np.zeros(len(kp))
    for s, f in zip(sets, flag):
        if not f and len(s) and len(kp):
            i = np.searchsorted(kp, s)
            i[i == len(kp)] = 0
            cu[i[kp[i] == s]] += 1
    clean = np.maximum(0, cu / nu - prior * cp / np_) / (1 - prior)  # the share among clean texts, as U holds toxic ones too
    chance = np_ * (clean + 1 / nu)
    z = np.where(cp > min_lift * chance, np.sqrt(2 * np.maximum(0, cp * np.log(np.maximum(cp, 1) / chance) - cp + chance)), 0)
    min_z = margin + np.sqrt(2 * np.log(max(2, len(kp))))  # of so many keys, pure chance lifts hardly any that far
    best = np.argsort(-z, kind="stable")[:max_features]
    keys = np.sort(kp[best[z[best] >= min_z]])
    rows, cols = [], []
    for k, s in enumerate(sets):
        if len(keys) and len(s):
            i = np.searchsorted(keys, s)
            i[i == len(keys)] = 0
            hit = np.unique(i[keys[i] == s])
            cols.append(hit)
            rows.append(np.full(len(hit), k))
    rows, cols = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
    w, bias = fit_nnpu(rows, cols, len(keys), flag, prior)
    slope, shift = calibrate(np.bincount(rows, w[cols], len(flag)) + bias if len(keys) else np.full(len(flag), bias), flag, prior)
    w = w * slope
    return {"keys": keys[w != 0], "w": w[w != 0], "b": float(bias * slope + shift)}


def _score(model):
    def run(batches):
        m = model.value
        keys, w, b = m["keys"], m["w"], m["b"]
        seen = np.zeros(1 << 20, bool)
        seen[(mix64(keys) >> np.uint64(44)).astype(np.int64)] = True
        tok = Tokenizer()
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                t = np.full(j - i, b)
                if len(keys) and len(buf):
                    key, doc = _features(buf, tok.words(buf, off))
                    hit = np.flatnonzero(seen[(mix64(key) >> np.uint64(44)).astype(np.int64)])
                    at = np.searchsorted(keys, key[hit])
                    at[at == len(keys)] = 0
                    same = keys[at] == key[hit]
                    pair = np.unique(doc[hit][same] * len(keys) + at[same])
                    t += np.bincount(pair // len(keys), w[pair % len(keys)], j - i)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(_sigmoid(t))], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; null and empty texts get the score of a text without any feature."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_score(shared), "doc_id long, score double").withColumnRenamed("doc_id", id_col)


def _keep(model, threshold):
    def run(batches):
        score = _score(model)
        for batch in batches:
            pair = pa.record_batch([batch.column(0), batch.column(1)], names=["doc_id", "text"])
            got = np.concatenate([x.column(1).to_numpy() for x in score([pair])]) if batch.num_rows else np.zeros(0)
            yield pa.record_batch(batch.columns[2:], names=batch.schema.names[2:]).filter(pa.array(got < threshold))

    return run


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns, of any names) that score under ``threshold``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ident, text = unused(docs.columns, "id", "text")
    own = docs.select(F.col("doc_id").cast("long").alias(ident), F.col("text").cast("string").alias(text), "*")
    return own.mapInArrow(_keep(shared, threshold), docs.schema)
