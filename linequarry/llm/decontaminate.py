"""Benchmark items inside documents: size-partitioned MinHash containment search, confirmed by exact shingle containment.

Containment cannot be read off the Jaccard similarity of a short item and a
long document, so both sides are cut to comparable sizes: items fall into
classes by their number of shingles (at most 32, 64, ...), and for each class a document is covered by overlapping windows of twice the class size, of
which one holds any contiguous occurrence.  A window and an item that share a
minimum under any of ``hashes`` hash functions are candidates; a document's
exact shingle set then decides.  At containment 0.8 a window and an item of its
class have a Jaccard similarity of 0.19 or more, so 48 hashes miss one item in
25,000; the pieces of an item that is scattered over a document add up to
about the same chance.  Items of at most 16 shingles, for which a window's
similarity would be too small, are looked up: of an item that may lack m
shingles any m + 1 are taken, of which a document that holds it has one.

Items are read in blocks of ``block_bytes`` of text, each broadcast and held
against all documents in a map over whole texts without a shuffle; a gigabyte
of items takes 32 such passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, broadcast_if_small, small_batches, unused
from .textops import Tokenizer, chunks, random_u64, shingle_hashes

BASE = 16


def _item_block(items, width: int, percent: int, hashes: int, seed: int):
    """Sets and minima of one block of items: (ids, sets, {class size: (values, item index) sorted per hash}, (shingles, item index) of the small items, sorted)."""
    mult, add = random_u64(hashes, seed), random_u64(hashes, seed + 1)
    tok, ids, sets, classes, keys, owners = Tokenizer(), [], [], {}, [], []
    for item_id, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        got = np.unique(shingle_hashes(tok.words(raw, np.array([0, len(raw)])), width)[0])
        if not len(got):
            continue
        if len(got) <= BASE:
            some = got[: len(got) - -(-percent * len(got) // 100) + 1]
            keys.append(some)
            owners += [len(ids)] * len(some)
            ids.append(item_id)
            sets.append(got)
            continue
        size = BASE
        while size < len(got):
            size *= 2
        low = ((got[:, None] * mult + add) >> np.uint64(32)).astype(np.uint32).min(axis=0)
        classes.setdefault(size, ([], []))
        classes[size][0].append(low)
        classes[size][1].append(len(ids))
        ids.append(item_id)
        sets.append(got)
    tables = {}
    for size, (lows, index) in classes.items():
        lows, index = np.stack(lows), np.array(index)
        order = np.argsort(lows, axis=0, kind="stable")
        tables[size] = (np.take_along_axis(lows, order, 0), index[order])
    keys, owners = np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.array(owners, np.int64)
    order = np.argsort(keys, kind="stable")
    return ids, sets, tables, (keys[order], owners[order])


def _bits(values):
    seen = np.zeros(1 << 16, bool)
    seen[values & values.dtype.type(0xFFFF)] = True
    return seen


def _search(sent, width: int, percent: int, hashes: int, seed: int):
    def run(batches):
        yield from _finder(sent.value, width, percent, hashes, seed)(batches)

    return run


def _finder(block, width: int, percent: int, hashes: int, seed: int):
    ids, sets, tables, (keys, owners) = block
    few = _bits(keys) if len(keys) else None
    mult, add = random_u64(hashes, seed), random_u64(hashes, seed + 1)
    top = max(tables, default=BASE)

    def candidates(h, first):
        """(document, item) pairs; h: shingle hashes, first: offsets of the documents' shingles."""
        n = np.diff(first)
        full = np.flatnonzero(n > 0)
        if not len(full):
            return set()
        found = set()
        if len(keys):
            at = np.flatnonzero(few[h & np.uint64(0xFFFF)])
            a, b = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            hit = np.flatnonzero(b > a)
            doc = np.searchsorted(first, at[hit], "right") - 1
            for d, x, y in zip(doc.tolist(), a[hit], b[hit]):
                found.update((d, int(i)) for i in owners[x:y])
        if not tables:
            return found
        blocks = -(-n[full] // BASE)  # base blocks of each document
        start = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(len(full)), blocks)
        at = first[full][owner] + (np.arange(start[-1]) - start[:-1][owner]) * BASE
        for k in range(hashes):
            low = np.minimum.reduceat(((h * mult[k] + add[k]) >> np.uint64(32)).astype(np.uint32), at)
            size, counts, own = BASE, blocks, owner
            while True:
                if size in tables:
                    window = low.copy()
                    same = own[1:] == own[:-1]
                    window[:-1][same] = np.minimum(low[:-1][same], low[1:][same])
                    values, index = tables[size][0][:, k], tables[size][1][:, k]
                    for w in np.flatnonzero(_SEEN(size, k)[window & np.uint32(0xFFFF)]):
                        a, b = np.searchsorted(values, window[w], "left"), np.searchsorted(values, window[w], "right")
                        found.update((int(full[own[w]]), int(x)) for x in index[a:b])
                if size >= top:
                    break
                first_of = np.concatenate([[0], np.cumsum(counts)])[:-1]
                halved = -(-counts // 2)
                own2 = np.repeat(np.arange(len(counts)), halved)
                s2 = np.concatenate([[0], np.cumsum(halved)])[:-1]
                low = np.minimum.reduceat(low, first_of[own2] + 2 * (np.arange(len(own2)) - s2[own2]))
                size, counts, own = size * 2, halved, own2
        return found

    seen = {}

    def _SEEN(size, k):
        if (size, k) not in seen:
            seen[size, k] = _bits(tables[size][0][:, k])
        return seen[size, k]

    def run(batches):
        tok = Tokenizer()
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                h, d = shingle_hashes(tok.words(buf, off), width)
                first = np.searchsorted(d, np.arange(j - i + 1))
                rows = []
                for doc, item in sorted(candidates(h, first)):
                    mine = sets[item]
                    shared = int(np.isin(mine, h[first[doc] : first[doc + 1]]).sum())
                    if 100 * shared >= percent * len(mine):
                        rows.append((doc, ids[item], len(mine), shared))
                if rows:
                    doc, item, size, shared = zip(*rows)
                    yield pa.record_batch(
                        [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(size, pa.int64()), pa.array(shared, pa.int64())],
                        names=["doc_id", "item_id", "n_item", "n_shared"],
                    )

    return run


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 80, hashes: int = 48, block_bytes: int = 32_000_000, seed: int = 41) -> DataFrame:
    """One row per (document, item) with 100 * shared >= percent * item shingles: doc id, item id, n_item, n_shared, containment.

    Shingles are distinct runs of ``width`` words (A-Z lower-cased); a shorter
    text is one shingle.  Null, empty or blank texts hold and match nothing;
    items with a null id are skipped.  Repeated rows give repeated results for
    documents and one result for repeated (id, text) items.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    parts: list[DataFrame] = []

    def search(block):
        data = _item_block(block, width, percent, hashes, seed)
        if data[0]:
            parts.append(base.mapInArrow(_search(spark.sparkContext.broadcast(data), width, percent, hashes, seed), schema))

    block, size = [], 0
    for row in wanted.orderBy("i", "t").toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t)
        if size >= block_bytes:
            search(block)
            block, size = [], 0
    search(block)
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for more in parts[1:]:
        out = out.union(more)
    return out.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay as they are."""
    (name,) = unused(docs.columns, "hit")
    hit = contained_items(docs, items, id_col=id_col, **options).select(F.col(id_col).alias(name)).where(F.col(name).isNotNull()).distinct()
    hit = Scratch(docs.sparkSession).keep(hit)
    return docs.join(broadcast_if_small(hit), docs[id_col] == F.col(name), "left_anti")


ORACLE = r"""
with w as (select 0 kind, doc_id id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents
  union all select 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') from benchmark),
s as (select distinct kind, id, case when len(ws) < 5 then ws else ws[i : i + 4] end sh
  from w, unnest(range(1, greatest(2, len(ws) - 3))) t(i) where len(ws) > 0),
n as (select id, count(*) n_item from s where kind = 1 group by 1)
select d.id doc_id, b.id item_id, n_item, count(*) n_shared, count(*) / n_item containment
from s b join s d on d.kind = 0 and b.kind = 1 and b.sh = d.sh join n on n.id = b.id
group by d.id, b.id, n_item having 100 * count(*) >= 80 * n_item"""
