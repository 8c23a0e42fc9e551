"""Document scores: an add-one unigram base and a gated recurrent language model.

* Word counts come from all training texts: every task reduces its words to
  distinct (hash, count) rows, Spark adds them up.
* The most frequent words, at most ``head``, travel to the tasks; every other
  word of a text goes into a join with the table of counts, as one row
  per text and distinct word.  These words are all rare, so the join is even.
* The recurrent model knows the ``vocab`` most frequent words; the others are
  its rare class, shared out by (c + 1) / Z, with one share for all unseen
  words.
* It is trained on every training text: it starts from a fit on about
  ``fit_tokens`` tokens, then in each of ``rounds`` rounds every task trains a
  copy on its own texts of that round (each text is in one) by truncated
  back-propagation, and the copies are averaged by their tokens.  Sums of
  copies travel, at most ``GROUPS`` of them to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .blas import one_thread
from .gru import score as gru_score
from .tables import Scratch
from .textops import LOWER, Tokenizer, chunks, mix64

BUCKETS = 64
GROUPS = 16


def _count_words(limit: int = 6_000_000):
    def run(batches):
        tok, held, n, docs = Tokenizer(), [], 0, 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(h), 100_000):
                yield pa.record_batch([pa.array(h[a : a + 100_000].view(np.int64)), pa.array(c[a : a + 100_000])], names=["h", "c"])

        for batch in batches:
            docs += batch.num_rows
            for _, _, buf, off in chunks(batch.column(0)):
                h = tok.words(buf, off).hash
                held.append(h)
                n += len(h)
                if n >= limit:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([docs], pa.int64())], names=["h", "c"])

    return run


class Lookup:
    """Index of each key in a fixed set: layers of direct-mapped slots, so a probe is a few gathers."""

    def __init__(self, keys, bits: int = 20):
        self.keys, self.bits, self.layers = keys, bits, []
        left = np.arange(len(keys))
        salt = 0
        while len(left):
            slot = np.full(1 << bits, -1, np.int32)
            at = self._slot(keys[left], salt)
            slot[at] = left
            self.layers.append(slot)
            left = left[slot[at] != left]
            salt += 1

    def _slot(self, h, salt):
        return ((h * np.uint64(2 * salt + 0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h):
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for salt, slot in enumerate(self.layers):
            at = slot[self._slot(h[todo], salt)].astype(np.int64)
            hit = (at >= 0) & (self.keys[at] == h[todo])
            out[todo[hit]] = at[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def _symbols(words, buf, head: Lookup, vocab: int):
    """(index in the head or -1, model symbol) of each word; symbol 0 is the end, words of the model follow."""
    index = head.find(words.hash)
    known = (index >= 0) & (index < vocab - 1)
    tail = buf[np.maximum(words.end - 2, words.start)].astype(np.uint64) * np.uint64(256) + LOWER[buf[words.end - 1]] if len(words.hash) else np.zeros(0, np.uint64)
    bucket = (mix64(tail) % np.uint64(BUCKETS)).astype(np.int64)
    return index, np.where(known, index + 1, vocab + bucket)


def _with_ends(symbols, first):
    """Symbols with the end symbol after each text, and the new offsets."""
    n = len(first) - 1
    out = np.zeros(len(symbols) + n, np.int64)
    place = np.arange(len(symbols)) + np.repeat(np.arange(n), np.diff(first))
    out[place] = symbols
    return out, first + np.arange(n + 1)


def _sample_symbols(shared):
    def run(batches):
        s = shared.value
        head, tok = Lookup(s["keys"]), Tokenizer()
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                words = tok.words(buf, off)
                _, symbols = _symbols(words, buf, head, s["vocab"])
                data = [symbols[a:b].astype(np.uint16).tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(data, pa.binary())], names=["h", "s"])

    return run


def _train_copy(sent, rate: float, streams: int = 256, chunk: int = 500_000):
    """One row per task: its model's weights times its tokens, and the tokens; texts are worked off in chunks of about ``chunk`` tokens."""

    def run(batches):
        one_thread()
        s = sent.value
        head, tok, v = Lookup(s["keys"]), Tokenizer(), s["vocab"]
        m = {k: x.copy() for k, x in s["model"].items()}
        moments, held, n, total = gru.new_moments(m), [], 0, 0
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                words = tok.words(buf, off)
                _, symbols = _symbols(words, buf, head, v)
                symbols, first = _with_ends(symbols, words.first)
                held += [symbols[a:b] for a, b in zip(first[:-1], first[1:])]
                n += len(symbols)
                if n >= chunk:
                    gru.train(m, held, v, streams=streams, epochs=1, rate=rate, moments=moments, decay=0.0)
                    held, n, total = [], 0, total + n
        if n:
            gru.train(m, held, v, streams=streams, epochs=1, rate=rate, moments=moments, decay=0.0)
            total += n
        if total:
            yield pa.record_batch([pa.array([(gru.flat(m).astype(np.float64) * total).tobytes()], pa.binary()), pa.array([total], pa.int64())], names=["w", "n"])

    return run


def _add_up(batches):
    """One row: the sums of all rows (w, n)."""
    total, n = None, 0
    for batch in batches:
        for x, k in zip(batch.column(0), batch.column(1).to_pylist()):
            w = np.frombuffer(x.as_buffer(), np.float64)
            total, n = w.copy() if total is None else total + w, n + k
    if n:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "n"])


def _averaged(spark, pool: DataFrame, shared: dict, model: dict, rounds: int, rate: float) -> dict:
    turn = F.pmod(F.xxhash64("id", F.lit(59)), F.lit(rounds))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(shared | {"model": model})
        copies = pool.where(turn == k).select("text").mapInArrow(_train_copy(sent, rate / (k + 1)), "w binary, n long")
        # rows of some 800 kB: a few to a batch, summed in GROUPS tasks
        sums = copies.repartition(GROUPS).mapInArrow(_add_up, "w binary, n long").toArrow()
        n = sum(sums["n"].to_pylist())
        if n:
            model = gru.unflat(sum(np.frombuffer(x.as_buffer(), np.float64) for x in sums["w"]) / n, model)
    return model


_PART = "id long, n_tokens long, known long, head_sum double, rare_sum double, n_rare long, model double, words array<long>, times array<int>"


def _score_parts(shared, group: int = 2_000_000):
    """One row per text: what the head and the model say, and the words left for the join."""

    def run(batches):
        one_thread()
        s = shared.value
        head, tok, v, m = Lookup(s["keys"]), Tokenizer(), s["vocab"], s["model"]
        weight = np.log10(s["counts"] + 1.0)

        def emit(held):
            ids, first_all, symbols_all, rows = [], [np.zeros(1, np.int64)], [], []
            base = 0
            for part_ids, symbols, first, cols in held:
                ids.append(part_ids)
                symbols_all.append(symbols)
                first_all.append(first[1:] + base)
                base += first[-1]
                rows.append(cols)
            model = gru_score(m, np.concatenate(symbols_all), np.concatenate(first_all), v)
            at = 0
            for part_ids, cols in zip(ids, rows):
                k = len(part_ids)
                yield pa.record_batch([part_ids, *cols[:5], pa.array(model[at : at + k]), *cols[5:]], names=["id", "n_tokens", "known", "head_sum", "rare_sum", "n_rare", "model", "words", "times"])
                at += k

        held, size = [], 0
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                n = j - i
                words = tok.words(buf, off)
                index, symbols = _symbols(words, buf, head, v)
                inside = index >= 0
                rare = symbols >= v
                w = np.where(inside, weight[np.maximum(index, 0)] if len(weight) else 0.0, 0.0)
                d = words.doc
                out = np.flatnonzero(~inside)
                order = out[np.lexsort((words.hash[out], d[out]))]
                hh, dd = words.hash[order], d[order]
                new = np.append(True, (hh[1:] != hh[:-1]) | (dd[1:] != dd[:-1])) if len(order) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(order)))
                bounds = np.searchsorted(dd[at], np.arange(n + 1)).astype(np.int32)
                cols = [
                    pa.array(np.diff(words.first) + 1), pa.array(np.bincount(d[inside], minlength=n)),
                    pa.array(np.bincount(d, w, n)), pa.array(np.bincount(d[rare], w[rare], n)), pa.array(np.bincount(d[rare], minlength=n)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(hh[at].view(np.int64))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))),
                ]
                held.append((batch.column(0).slice(i, n), *_with_ends(symbols, words.first), cols))
                size += len(symbols)
                if size >= group:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return run


def score_documents(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", vocab: int = 1024, head: int = 200_000, hidden: int = 24, fit_tokens: int = 300_000, epochs: int = 2, rounds: int = 3, rate: float = 2e-3) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Null texts count as empty ones; a text's end is a token.  Repeated rows
    are scored, and learnt from, as often as they occur.  Without training rows
    the base is 0 and the model stays at its start.  Null ids are scored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pool = docs.where(learn_from).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = scratch.keep(pool.select("text").mapInArrow(_count_words(), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    n_docs, n_words, distinct = counts.agg(
        F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("c"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("c"))), F.lit(0)), F.count("h")
    ).first()
    counts = counts.where("h is not null")
    n, v = n_words + n_docs, distinct + (n_docs > 0)
    # the head: the ``head`` most frequent words, equally frequent ones by hash; found from the table of counts of counts,
    # which is small (n tokens have fewer than sqrt(2 n) different counts), so no task sorts the vocabulary
    sizes = counts.groupBy("c").agg(F.count("*").alias("k")).toPandas().sort_values("c", ascending=False)
    before = sizes["k"].cumsum() - sizes["k"]
    cut = sizes[before < head].iloc[-1:]
    top = counts.where("false")
    if len(cut):
        least = int(cut["c"].iloc[0])
        share = (head - int(before[cut.index[0]])) / int(cut["k"].iloc[0])  # of the words with the least count
        top = counts.where((F.col("c") > least) | ((F.col("c") == least) & (F.pmod(F.xxhash64("h", F.lit(57)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))))
    top = top.toArrow()
    keys, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy().astype(np.int64)
    order = np.lexsort((keys.view(np.int64), -c))
    keys, c = keys[order], c[order]
    size = min(vocab, len(keys) + 1)
    model_counts = np.concatenate([[n_docs], c[: size - 1]])
    rare_mass = (n_words - c[: size - 1].sum()) + (distinct - (size - 1)) + 1  # sum of (c + 1) over rare words, and the unseen
    shared = {"keys": keys, "counts": c, "vocab": size}

    rate = min(1.0, fit_tokens / max(n, 1))
    pick = F.pmod(F.xxhash64("id", F.lit(53)), F.lit(1 << 30)) / (1 << 30)
    sent = spark.sparkContext.broadcast(shared)
    got = pool.where(pick < rate).select(pick.alias("h"), "text").mapInArrow(_sample_symbols(sent), "h double, s binary").toArrow().sort_by("h")
    texts = [np.append(np.frombuffer(x.as_buffer(), np.uint16), 0) for x in got["s"]]
    model = gru.new_model(model_counts, float(max(n_words - c[: size - 1].sum(), 0)), BUCKETS, hidden)
    if texts:
        gru.train(model, texts, size, epochs=epochs)
        model = _averaged(spark, pool, shared, model, rounds, rate)
    all_ = spark.sparkContext.broadcast(shared | {"model": model})
    parts = scratch.keep(base.mapInArrow(_score_parts(all_), _PART).withColumn("row", F.monotonically_increasing_id()))
    left = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("h"), F.col("x.times").alias("times"))
    met = left.join(counts, "h").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("s"), F.sum("times").alias("k"))
    out = parts.drop("words", "times").join(met.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    s, k = F.coalesce("s", F.lit(0.0)), F.coalesce("k", F.lit(0))
    end = math.log10(n_docs + 1)
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + k + int(n_docs > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + s + end - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("model") + F.col("rare_sum") + s - F.col("n_rare") * math.log10(rare_mass)).alias("score"),
    )
