"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Characters are lower-cased; digits, marks and white space become one blank.
  Runs of 1 to 3 characters are hashed to 2^14 features, weighted by
  (1 + ln count) * idf and scaled to unit length.
* Document frequencies come from every training text.
* Weights are learnt with FTRL-proximal (per-coordinate rates, elastic net:
  ``l1`` makes them sparse, ``l2`` keeps them small) from at most ``per_lang``
  texts of each language, chosen by a hash of their id.
* A tenth of these is left out of the fit and sets the softmax temperature.

Scoring is one map over all whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small_batches
from .textops import binary_array

BITS = 14
DIM = 1 << BITS
_BLANK = np.ones(0x2100, np.uint32)
for _c in range(0x2100):
    _BLANK[_c] = _c if chr(_c).isalpha() else 32
del _c


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode L*): ``½`` or ``Ⅷ`` are none."""
    return any(map(str.isalpha, text))


def gram_counts(text: str, blank=_BLANK):
    """(feature, count) of one text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) and int(c.max()) < len(blank):
        c = blank[c]
    else:
        low = c < len(blank)
        c = np.where(low, blank[np.where(low, c, 0)], c)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    one = c * np.uint32(0x9E3779B1)
    two = (c[:-1] * np.uint32(0x85EBCA6B) + c[1:]) * np.uint32(0xC2B2AE35)
    three = ((c[:-2] * np.uint32(0x27D4EB2F) + c[1:-1]) * np.uint32(0x165667B1) + c[2:]) * np.uint32(0xD3A2646D)
    h = np.concatenate([one, two, three])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    full = np.bincount((h >> np.uint32(32 - BITS)).astype(np.int64), minlength=DIM)
    at = np.flatnonzero(full)
    return at, full[at]


def _document_frequency():
    def run(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df[gram_counts(text.as_py())[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["f", "n"])

    return run


def _sample_features():
    def run(batches):
        for batch in batches:
            got = [gram_counts(t.as_py()) for t in batch.column(2)]
            bounds = np.concatenate([[0], np.cumsum([len(a) for a, _ in got])]).astype(np.int64)
            at = np.concatenate([a for a, _ in got]) if got else np.zeros(0)
            n = np.concatenate([c for _, c in got]) if got else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), binary_array(at.astype(np.uint16), bounds), binary_array(n.astype(np.float32), bounds)], names=["h", "lang", "at", "n"])

    return run


def _weigh(at, n, idf):
    x = (1 + np.log(n)) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def fit_ftrl(xs, ys, n_class, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, epochs=3, seed=5):
    """(weights DIM+1 x classes); xs: (features, values) per text, ys: class indices; the last row is the bias."""
    z, n = np.zeros((DIM + 1, n_class)), np.zeros((DIM + 1, n_class))

    def weights(at):
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(xs)):
            at, x = np.append(xs[k][0], DIM), np.append(xs[k][1], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[ys[k]] -= 1
            g = x[:, None] * p
            na = n[at]
            z[at] += g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
    return weights(np.arange(DIM + 1))


def fit_temperature(logits, ys):
    """Temperature of least log loss, by golden section on its logarithm."""

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(ys)), ys]))

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, learn_from: Column, per_lang: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """A model for ``predict``, from rows that ``learn_from`` admits and that have a text and a language."""
    small_batches(docs.sparkSession)
    rows = docs.where(learn_from).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("i is not null and t is not null and l is not null")
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    counts = rows.select("t").mapInArrow(_document_frequency(), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIM + 1)
    df[counts["f"].to_numpy()] = counts["n"].to_numpy()  # -1: the number of texts
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    h = F.pmod(F.xxhash64("i", F.lit(29)), F.lit(1 << 30)) / (1 << 30)
    rate = F.lit(1.0)
    for lang in langs:
        rate = F.when(F.col("l") == lang, F.lit(min(1.0, 1.1 * per_lang / sizes[lang]))).otherwise(rate)
    got = rows.where(h < rate).select(h.alias("h"), "l", "t").mapInArrow(_sample_features(), "h double, lang string, at binary, n binary").toArrow().sort_by("h")
    xs, ys, taken = [], [], dict.fromkeys(langs, 0)
    for lang, at, n in zip(got["lang"].to_pylist(), got["at"], got["n"]):
        if taken[lang] < per_lang:
            taken[lang] += 1
            at = np.frombuffer(at.as_buffer(), np.uint16).astype(np.int64)
            xs.append((at, _weigh(at, np.frombuffer(n.as_buffer(), np.float32).astype(float), idf)))
            ys.append(langs.index(lang))
    ys = np.array(ys)
    held = np.arange(len(ys)) % 10 == 9
    w = fit_ftrl([x for x, k in zip(xs, held) if not k], ys[~held], len(langs))
    if held.any():
        logits = np.stack([x @ w[at] + w[DIM] for (at, x), k in zip(xs, held) if k])
        t = fit_temperature(logits, ys[held])
    else:
        t = 1.0
    return {"langs": langs, "w": w[:DIM] / t, "b": w[DIM] / t, "idf": idf}


def _predict(model):
    def run(batches):
        m = model.value
        langs = m["langs"]
        for batch in batches:
            out, score = [], np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                if not langs or text is None or not has_letter(text):
                    out.append("und")
                    continue
                at, n = gram_counts(text)
                s = _weigh(at, n, m["idf"]) @ m["w"][at] + m["b"]
                best = int(np.argmax(s))
                out.append(langs[best])
                score[k] = 1 / np.exp(s - s[best]).sum()
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; ``und`` with score 0 for null texts and texts without a letter. Ties go to the alphabetically first."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", id_col)
