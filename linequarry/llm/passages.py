"""Repeated passages, also inexact ones, by collinear chaining of shared k-mer seeds.

1. Words (A-Z lower-cased) form k-mers; in every window of ``w`` k-mers of a
   document the one with the least hash is a seed, so two documents that share
   k + w - 1 words in a row share a seed.  A seed's number in its document is
   part of it, so repeated lines and runs of one word meet in order.
2. A seed that several documents hold links each of its places to the one in
   its first document: a star, not all pairs, so a passage that a third of all
   documents share costs one match per place.  Longer runs (``context``) are
   seeds of their own: where the short ones of a passage stand in earlier
   documents one by one, the long ones still link it to the first document
   that holds them in this order.
3. The matches of a document with one earlier document are merged to anchors
   along diagonals and chained: the best chain ending at an anchor is its
   length plus the best earlier chain on both sides less a cost for the gap,
   found with prefix maxima in a Fenwick tree for each diagonal in reach.
   Chains of fewer than ``least`` matched words (one short seed alone, mostly
   chance) end here.
4. Each chain is widened and aligned word by word (along its diagonal, and
   over the runs of equal words in a band around it) to get the borders and
   the identity of the passage; where the passage runs on to the end of what
   was read, more is read.

Only documents that take part in a chain send text through a shuffle.  The
earliest document keeps the passage.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, broadcast_if_small, one_text, unused
from .textops import Tokenizer, binary_array, chunks, mix64, shingle_hashes
from .vectors import runs_of_keys

_SALT = 0x9E3779B97F4A7C15


def _minimizers(words, n_docs: int, k: int, w: int):
    """(document, place in it, hash) of the least k-word run of every window of w, or of all where there are fewer."""
    long_ = np.diff(words.first) >= k
    if len(words.hash) < k or not long_.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, d = shingle_hashes(words, k)
    if not long_.all():
        some = long_[d]
        h, d = h[some], d[some]
    first = np.searchsorted(d, np.arange(n_docs + 1))
    take = np.zeros(len(h), bool)
    if len(h) >= w:
        inside = np.flatnonzero(d[: len(h) - w + 1] == d[w - 1 :])
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        for a in range(0, len(inside), 1 << 16):
            at = inside[a : a + (1 << 16)]
            take[at + view[at].argmin(axis=1)] = True
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < w))
    for x in few:
        take[first[x] + int(h[first[x] : first[x + 1]].argmin())] = True
    at = np.flatnonzero(take)
    return d[at], at - first[d[at]], h[at]


def _ranks(d, pos, h):
    """How many earlier entries of the same document have the same hash, and how far back the last one is; entries are in order of place."""
    order = np.lexsort((h, d))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])
    at = np.flatnonzero(new)
    rank, back = np.empty(len(h), np.int64), np.zeros(len(h), np.int64)
    rank[order] = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    back[order[1:]] = np.where(new[1:], 0, pos[order[1:]] - pos[order[:-1]])
    return rank, back


def _local_stars(ids, pos, seed, own, often: int):
    """For seeds that a batch holds more than ``often`` times: (rows that link inside the batch, their centres' rows); the centre is the first place."""
    order = np.lexsort((pos, ids, ~own, seed))
    at = np.flatnonzero(np.append(True, seed[order][1:] != seed[order][:-1]))
    size = np.diff(np.append(at, len(order)))
    hot = size > often
    centre = order[np.repeat(at[hot], size[hot])]
    inside = order[np.flatnonzero(np.repeat(hot, size))]
    ok = (inside != centre) & own[centre]
    return inside[ok], centre[ok]


_SEED = "seed long, id long, place long, rid long, rpos long"


def _seeds(*kinds, often: int = 8):
    """Rows (seed, id, place) of every kind (k, w); place packs position, k and ``own``.

    A seed that a document repeats has its number there in the key, so that
    the second one meets the second one of another document and a repeated
    line stays on one diagonal; it is also given under the key of the first
    one (``own`` is false there: it can't be the place others link to), unless
    it overlaps the one before, as in a run of one word.

    Of a seed that stands in a batch more than ``often`` times only the first
    place goes on; the others are matches (rid, rpos) of that place at once,
    so that the most frequent seeds make no long group later.
    """

    def run(batches):
        tok = Tokenizer()
        for batch in batches:
            got = []
            for i, j, buf, off in chunks(batch.column(1)):
                words = tok.words(buf, off)
                for k, w in kinds:
                    d, pos, h = _minimizers(words, j - i, k, w)
                    if not len(d):
                        continue
                    rank, back = _ranks(d, pos, h)
                    more = np.flatnonzero(back >= k)
                    own = np.append(np.ones(len(d), bool), np.zeros(len(more), bool))
                    key = np.append(np.where(rank > 0, mix64(h + rank.astype(np.uint64) * np.uint64(_SALT)), h), h[more])
                    got.append((key.view(np.int64), i + np.append(d, d[more]), np.append(pos, pos[more]), np.full(len(key), k), own))
            if not got:
                continue
            seed, row, pos, size, own = (np.concatenate(x) for x in zip(*got))
            ids = batch.column(0).to_numpy()[row]
            place = pos << 8 | size << 1 | own
            inside, centre = _local_stars(ids, pos, seed, own, often)
            stays = np.ones(len(seed), bool)
            stays[inside] = False
            # matches need no seed any more; their key only spreads them over the partitions
            link = ids[inside] != ids[centre]
            inside, centre = inside[link], centre[link]
            none = pa.nulls(int(stays.sum()), pa.int64())
            columns = [
                (pa.array(seed[stays]), pa.array(mix64((ids[inside] + pos[inside]).view(np.uint64)).view(np.int64))), (pa.array(ids[stays]), pa.array(ids[inside])),
                (pa.array(place[stays]), pa.array(place[inside])), (none, pa.array(ids[centre])), (none, pa.array(pos[centre])),
            ]
            yield pa.record_batch([pa.concat_arrays(c) for c in columns], names=["seed", "id", "place", "rid", "rpos"])

    return run


def _stars(batches):
    """Matches (id, rid, pos, rpos, len) of every place of a seed with its first own one, from partitions sorted by seed, not own, id, place."""
    last, centre = None, (0, 0, False)
    for batch in batches:
        if not batch.num_rows:
            continue
        linked = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        done = batch.filter(pa.array(linked))
        seed, ids, place = (batch.column(c).to_numpy()[~linked] for c in range(3))
        pos, size, own = place >> 8, place >> 1 & 0x7F, (place & 1).astype(bool)
        rid, rpos, valid = np.zeros(len(seed), np.int64), np.zeros(len(seed), np.int64), np.zeros(len(seed), bool)
        if len(seed):
            new = np.append(last is None or seed[0] != last, seed[1:] != seed[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(seed)), -1))
            begun = at >= 0  # the others go on with the seed of the batch before
            rid[begun], rpos[begun], valid[begun] = ids[at[begun]], pos[at[begun]], own[at[begun]]
            rid[~begun], rpos[~begun], valid[~begun] = centre
            last, centre = seed[-1], (rid[-1], rpos[-1], valid[-1])
        keep = valid & (rid != ids)
        place2 = done.column(2).to_numpy()
        data = [np.append(a[keep], b) for a, b in ((ids, done.column(1)), (rid, done.column(3)), (pos, place2 >> 8), (rpos, done.column(4)), (size, place2 >> 1 & 0x7F))]
        yield pa.record_batch([pa.array(x) for x in data], names=["id", "rid", "pos", "rpos", "len"])


def anchors_of(pos, rpos, size, join: int):
    """Matches of ``size`` words merged along diagonals where at most ``join`` words apart: rows (start, end, other start, other end), sorted by start."""
    diagonal = pos - rpos
    order = np.lexsort((pos, diagonal))
    p, g, end = pos[order], diagonal[order], (pos + size)[order]
    step = np.zeros(len(p), np.int64)
    step[1:] = np.cumsum(g[1:] != g[:-1])
    reach = np.maximum.accumulate(end + (step << 40)) - (step << 40)
    new = np.ones(len(p), bool)
    new[1:] = (g[1:] != g[:-1]) | (p[1:] - reach[:-1] > join)
    a = np.flatnonzero(new)
    s, e = p[a], reach[np.append(a[1:], len(p)) - 1]
    out = np.stack([s, e, s - g[a], e - g[a]], 1)
    return out[np.argsort(s, kind="stable")]


class _Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n):
        self.n, self.best = n, [(-1e18, -1)] * (n + 1)

    def put(self, i, item):
        i += 1
        while i <= self.n:
            if item > self.best[i]:
                self.best[i] = item
            i += i & -i

    def top(self, i):
        """Best of places below i."""
        got = (-1e18, -1)
        while i > 0:
            if self.best[i] > got:
                got = self.best[i]
            i -= i & -i
        return got


def chains_of(anchors, cost: float, max_shift: int):
    """Disjoint chains of anchors, each a list of rows, best first.

    An anchor may follow one that ends before it on both sides; the gap costs
    ``cost`` per word skipped on either side.  Only anchors whose diagonal is
    at most ``max_shift`` away are looked up, so a better anchor on a far one
    hides none of them.
    """
    n = len(anchors)
    if n == 1:
        return [anchors]
    score, before = np.zeros(n), np.full(n, -1)
    # a tree for each diagonal, over its anchors by end: they are disjoint, so by start as well
    on = anchors[:, 0] - anchors[:, 2]
    ends = {int(d): anchors[on == d, 1].tolist() for d in np.unique(on)}
    trees, held = {d: _Fenwick(len(e)) for d, e in ends.items()}, dict.fromkeys(ends, 0)
    near = {d: [x for x in range(d - max_shift, d + max_shift + 1) if x in ends] if len(ends) > 2 * max_shift else [x for x in ends if abs(x - d) <= max_shift] for d in ends}
    # anchors are taken by start; those that end at or before it are in the trees by then
    for i, (s, e, rs, re_) in enumerate(anchors.tolist()):
        value, j = -1e18, -1
        for d in near[s - rs]:
            value, j = max((value, j), trees[d].top(bisect_right(ends[d], min(s, rs + d))))
        gain = value - cost * (s + rs)
        score[i] = e - s
        if j >= 0 and gain > 0:
            score[i] += gain
            before[i] = j
        trees[s - rs].put(held[s - rs], (score[i] + cost * (e + re_), i))
        held[s - rs] += 1
    used, out = np.zeros(n, bool), []
    for i in np.argsort(-score, kind="stable"):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(anchors[chain[::-1]])
    return out


def _pairs(batches, least: int):
    """(key, matches) of the pairs of documents whose matches come to ``least`` words or more, from partitions sorted by pair; smaller ones are passed over in bulk."""
    def whole(rows):
        new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)) if len(rows) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        for k in np.flatnonzero(np.add.reduceat(rows[:, 4], at) >= least) if len(at) else ():
            part = rows[at[k] : at[k + 1] if k + 1 < len(at) else len(rows)]
            yield (int(part[0, 0]), int(part[0, 1])), part

    held_parts = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy().astype(np.int64, copy=False) for c in batch.columns], 1)
        last = rows[-1, :2]
        cut = int(np.flatnonzero((rows[:, :2] != last).any(axis=1))[-1]) + 1 if (rows[0, :2] != last).any() else 0
        if held_parts and (cut or (held_parts[-1][-1, :2] != last).any()):
            yield from whole(np.concatenate([*held_parts, rows[:cut]]))
            held_parts = []
        elif cut:
            yield from whole(rows[:cut])
        held_parts.append(rows[cut:])
    if held_parts:
        yield from whole(np.concatenate(held_parts))


def _chain(join: int, cost: float, max_shift: int, least: int):
    def run(batches):
        rows = []
        for key, t in _pairs(batches, least):
            for chain in chains_of(anchors_of(t[:, 2], t[:, 3], t[:, 4], join), cost, max_shift):
                if (chain[:, 1] - chain[:, 0]).sum() < least:
                    continue
                s, e, rs, re_ = chain[:, 0].min(), chain[:, 1].max(), chain[:, 2].min(), chain[:, 3].max()
                shift = chain[:, 0] - chain[:, 2]
                rows.append((*key, s, e, rs, re_, shift.min(), shift.max()))
            if len(rows) > 20_000:
                yield _chain_rows(rows)
                rows = []
        if rows:
            yield _chain_rows(rows)

    return run


_CHAIN = ["id", "rid", "s", "e", "rs", "re", "lo", "hi"]


def _chain_rows(rows):
    cols = np.array(rows, np.int64).T
    return pa.record_batch([pa.array(c) for c in cols], names=_CHAIN)


def _codes(batches):
    """Rows (id, text) become (id, words), four bytes of the hash of each word."""
    tok = Tokenizer()
    for batch in batches:
        for i, j, buf, off in chunks(batch.column(1)):
            words = tok.words(buf, off)
            yield pa.record_batch([batch.column(0).slice(i, j - i), binary_array((words.hash >> np.uint64(32)).astype(np.uint32), words.first)], names=["id", "words"])


def runs_in_band(a, b, lo: int, hi: int, least: int, cells: int = 1 << 23):
    """Maximal runs of ``least`` equal words or more on the diagonals lo .. hi (a[i] ~ b[i - d]), as anchors sorted by start."""
    found = []
    # as many diagonals at once as fit in ``cells`` comparisons; a long text or a wide band takes more rounds
    step = max(1, cells // max(1, len(a)))
    for d0 in range(lo, hi + 1, step):
        d1 = min(hi, d0 + step - 1)
        padded = np.zeros(len(a) + d1 - d0, a.dtype)
        inside = np.zeros(len(padded), bool)  # row d of the strided view is b moved by d; places outside b never equal
        x, y = max(0, d1), min(len(padded), len(b) + d1)
        if y > x:
            padded[x:y], inside[x:y] = b[x - d1 : y - d1], True
        view = np.lib.stride_tricks.sliding_window_view(padded, len(a))[::-1]
        same = (view == a) & np.lib.stride_tricks.sliding_window_view(inside, len(a))[::-1]
        edge = np.zeros((d1 - d0 + 1, len(a) + 2), np.int8)
        edge[:, 1:-1] = same
        edge = np.diff(edge, axis=1)
        d, s = np.nonzero(edge == 1)
        e = np.nonzero(edge == -1)[1]
        keep = e - s >= least
        d, s, e = d[keep] + d0, s[keep], e[keep]
        found.append(np.stack([s, e, s - d, e - d], 1))
    out = np.concatenate(found)
    return out[np.argsort(out[:, 0], kind="stable")]


def align(a, b, lo: int, hi: int, slack: int = 4, least: int = 3, need: int = 0):
    """Local alignment of two word arrays near the diagonals lo .. hi: (start, end, equal words) in a.

    On one diagonal it is a maximal sum of +1 for equal and -1 for other
    words.  To allow for words left out or put in, the runs of equal words in a
    band around the diagonals are chained as well, a skipped word costing half
    a point on either side; the alignment with more equal words counts.  Runs
    that do not come to ``need`` words in all are not chained.
    """
    if not len(a) or not len(b):
        return 0, 0, 0
    best = (0, 0, 0)
    if lo == hi:
        i0, i1 = max(0, lo), min(len(a), len(b) + lo)
        if i1 > i0:
            same = a[i0:i1] == b[i0 - lo : i1 - lo]
            total = np.concatenate([[0], np.cumsum(np.where(same, 1, -1))])
            low = np.minimum.accumulate(total)
            e = int(np.argmax(total[1:] - low[:-1])) + 1
            s = int(np.flatnonzero(total[:e] == low[e - 1])[-1])
            best = (i0 + s, i0 + e, int(same[s:e].sum()))
    runs = runs_in_band(a, b, lo - slack, hi + slack, least)
    if len(runs) and (runs[:, 1] - runs[:, 0]).sum() >= need:
        chain = chains_of(runs, 0.5, hi - lo + 2 * slack)[0]
        got = (int(chain[0, 0]), int(chain[-1, 1]), int((chain[:, 1] - chain[:, 0]).sum()))
        if got[2] > best[2]:
            best = got
    return best


_FOUND = [*_CHAIN, "at", "end", "same"]


def _align(min_words: int, percent: int, slack: int, edge: int = 32):
    """Rows of a chain and two slices of words become rows of _FOUND and ``open``: the alignment comes near a cut of both slices."""
    need = -(-min_words * percent // 100)

    def run(batches):
        for batch in batches:
            rows, more = [], []
            get = {n: batch.column(n).to_numpy() for n in (*_CHAIN, "from", "rfrom", "n", "rn")}
            for x in range(batch.num_rows):
                a = np.frombuffer(batch["words"][x].as_buffer(), np.uint32)
                b = np.frombuffer(batch["rwords"][x].as_buffer(), np.uint32)
                f, rf = int(get["from"][x]), int(get["rfrom"][x])
                lo, hi = int(get["lo"][x]) - f + rf, int(get["hi"][x]) - f + rf
                s, e, same = align(a, b, lo, hi, slack, need=need)
                right = f + len(a) < get["n"][x] and rf + len(b) < get["rn"][x] and e > len(a) - edge
                left = f > 0 and rf > 0 and s < edge
                grows = e > s and (left or right)
                if grows or (e - s >= min_words and 100 * same >= percent * (e - s)):
                    rows.append((*(get[c][x] for c in _CHAIN), f + s, f + e, same))
                    more.append(grows)
            cols = np.array(rows, np.int64).reshape(-1, len(_FOUND)).T
            yield pa.record_batch([*(pa.array(c) for c in cols), pa.array(more, pa.bool_())], names=[*_FOUND, "open"])

    return run


def _outermost(batches):
    """Rows (id, rid, at, end, same) sorted by id, without those that lie inside another one of their document."""
    for key, t in runs_of_keys(batches, 1):
        rid, s, e, same = (t[c].to_numpy() for c in ("rid", "at", "end", "same"))
        order = np.lexsort((rid, -same, -e, s))
        last = np.append(-1, np.maximum.accumulate(e[order])[:-1])
        keep = order[e[order] > last]
        yield pa.record_batch([pa.array([key[0]] * len(keep), pa.int64()), *(pa.array(c[keep]) for c in (rid, s, e, same))], names=["id", "rid", "at", "end", "same"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, w: int = 4, min_words: int = 50, percent: int = 80, cost: float = 0.1, max_shift: int = 12, slack: int = 4, margin: int = 60, context: tuple = (20, 24), least: int = 10) -> DataFrame:
    """One row per repeated passage of a later document: id, start_word, end_word, n_same, first_id.

    Words are counted from 0; n_same of the end_word - start_word words equal
    the aligned ones of document ``first_id``, which has a smaller id.  At
    least ``min_words`` words and ``percent`` per cent must agree; what lies
    inside another passage of its document is not listed again.  Passages
    inside one document, texts that are null, empty or shorter than k words,
    and null ids give no rows.  Rows of one id count as one document; if their
    texts differ, the one with the least hash is its text.  Only the id and
    the text are read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    base = one_text(docs, id_col, text_col, scratch)[0]
    # one shuffle of the seeds; where the first place of each is known, its matches go on to their pair of documents
    seeds = base.mapInArrow(_seeds((k, w), context), _SEED).repartition("seed").sortWithinPartitions("seed", F.expr("1 - place & 1"), "id", "place")
    matches = seeds.mapInArrow(_stars, "id long, rid long, pos long, rpos long, len long")
    grouped = matches.repartition("id", "rid").sortWithinPartitions("id", "rid")
    chains = scratch.keep(grouped.mapInArrow(_chain(w, cost, max_shift, least), ", ".join(f"{c} long" for c in _CHAIN)))

    wanted = scratch.keep(chains.select("id").union(chains.select("rid")).distinct())
    codes = base.join(broadcast_if_small(wanted), "id", "left_semi").mapInArrow(_codes, "id long, words binary").dropDuplicates(["id"])
    codes = scratch.keep(codes)

    def part(words: str, s: str, e: str, m: int, name: str):
        """Words [s - m, e + m) of a document, their start and the number of its words."""
        start = f"greatest(0, {s} - {m})"
        return F.expr(f"{start} {name}from"), F.expr(f"substring({words}, cast(4 * {start} + 1 as int), cast(4 * ({e} + {m} - {start}) as int)) {name}words"), F.expr(f"cast(length({words}) div 4 as long) {name}n")

    def words_of(rows: DataFrame, column: str = "id") -> DataFrame:
        """The words of the documents that ``rows`` name; later rounds name few, the others stay out of the shuffle."""
        if not parts:
            return codes
        return codes.join(broadcast_if_small(scratch.keep(rows.select(F.col(column).alias("id")).distinct())), "id", "left_semi")

    todo, parts = chains, []
    while not parts or todo.head(1):
        own = todo.join(words_of(todo), "id").select(*_CHAIN, *part("words", "s", "e", margin, ""))
        ref = words_of(todo, "rid").toDF("xid", "xwords")
        both = own.join(ref, own.rid == ref.xid).select(*own.columns, *part("xwords", "rs", "re", margin, "r"))
        got = scratch.keep(both.mapInArrow(_align(min_words, percent, slack), ", ".join(f"{c} long" for c in _FOUND) + ", open boolean"))
        parts.append(got.where("not open").select("id", "rid", "at", "end", "same"))
        # passages that run on beyond their slices are aligned anew in wider ones
        todo, margin = got.where("open").select(*_CHAIN), 8 * margin
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    out = out.repartition("id").sortWithinPartitions("id").mapInArrow(_outermost, "id long, rid long, at long, end long, same long")
    return out.select(F.col("id").alias(id_col), F.col("at").alias("start_word"), F.col("end").alias("end_word"), F.col("same").alias("n_same"), F.col("rid").alias("first_id"))


def _cut(text_at: int, spans_at: int):
    """Texts without the words of their spans (what lies between two kept words stays)."""

    def run(batches):
        tok = Tokenizer()
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            spans = batch.column(spans_at)
            for x in range(batch.num_rows):
                if not spans[x].is_valid or texts[x] is None:
                    continue
                raw = texts[x].encode()
                buf = np.frombuffer(raw, np.uint8)
                words = tok.words(buf, np.array([0, len(raw)]))
                gone = np.zeros(len(words.start) + 1, bool)
                for span in spans[x].as_py():
                    gone[span["s"] : span["e"]] = True
                gone[-1] = False
                out, at = [], 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(np.int8)))
                for a, b in edge.reshape(-1, 2):
                    out.append(raw[at : words.start[a]])
                    at = int(words.start[b]) if b < len(words.start) else len(raw)
                out.append(raw[at:])
                texts[x] = b"".join(out).decode().rstrip() if any(out) else ""
            cols = list(batch.columns)
            cols[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            del cols[spans_at]
            yield pa.record_batch(cols, names=[n for k, n in enumerate(batch.schema.names) if k != spans_at])

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated passages cut out of all documents but the first; rows of which no word is left go.

    Texts without a repeated passage are untouched, blank ones among them; so
    are further texts of an id (see ``repeated_passages``).
    """
    scratch = Scratch(docs.sparkSession)
    _, several = one_text(docs, id_col, text_col, scratch)
    ident, spans_, had = unused(docs.columns, "id", "spans", "had")
    spans = repeated_passages(docs, id_col=id_col, text_col=text_col, **options)
    spans = spans.groupBy(F.col(id_col).alias(ident)).agg(F.array_sort(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e")))).alias(spans_))
    spans = scratch.keep(spans)
    few = broadcast_if_small(spans, 200_000, bytes_=64_000_000)
    joined = docs.join(few, docs[id_col] == F.col(ident), "left")
    if several is not None:
        other, digest = unused([*docs.columns, ident, spans_, had], "other", "digest")
        joined = joined.join(several.toDF(other, digest), docs[id_col] == F.col(other), "left")
        joined = joined.withColumn(spans_, F.when(F.col(digest).isNull() | (F.col(digest) == F.xxhash64(F.col(text_col).cast("string"))), F.col(spans_))).drop(other, digest)
    joined = joined.drop(ident).withColumn(had, F.col(spans_).isNotNull())
    at = joined.columns.index(text_col), joined.columns.index(spans_)
    schema = type(docs.schema)(list(docs.schema.fields)).add(had, "boolean")
    out = joined.mapInArrow(_cut(*at), schema)
    return out.where(~F.col(had) | (F.trim(text_col) != "")).drop(had)
