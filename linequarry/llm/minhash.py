"""Near-duplicate documents: MinHash bands, verified on full shingle sets, components by large-star and small-star.

Steps (every table between them lies in the shared folder):

1. Each text becomes its set of distinct word shingles, a 128-bit fingerprint
   of that set and ``bands * rows`` universal-hash minima.
2. Documents with equal sets collapse onto their least id, so a group of
   copies is one row from here on, however large.
3. Representatives that share a band hash form a bucket.  Two members per
   bucket, other ones in every band, serve as its centres; each member is
   paired with the centres only.  No bucket is ever gathered.
4. A pair whose signatures agree in far fewer places than the threshold asks
   is dropped; the others are confirmed on their full sets.
5. Confirmed links are joined into components.  A bucket whose members still
   still lie in several components is then compared across these components, in
   tiles of bounded size, so that a link no centre saw is not lost; members that
   came near another component by signature are confirmed on their full sets in
   the tile, which emits a forest of links and not their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .tables import Scratch, broadcast_if_small, unused
from .textops import Tokenizer, binary_array, chunks, distinct_sets, mix64, random_u64, shingle_hashes


def _fingerprints(values, bounds):
    """128-bit order-free digest of each set (sums of two mixes), with its size folded in."""
    n = len(bounds) - 1
    out = []
    for salt in (0x1234567, 0x7654321):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values + np.uint64(salt)), dtype=np.uint64)])
        out.append(mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * np.uint64(salt)).view(np.int64) if n else np.zeros(0, np.int64))
    return out


def _minima(values, bounds, mult, add):
    """uint32 minima (n_sets, k) of the universal hashes (a x + b) >> 32; sets must not be empty."""
    out = np.empty((len(bounds) - 1, len(mult)), np.uint32)
    for k in range(len(mult)):
        out[:, k] = np.minimum.reduceat(((values * mult[k] + add[k]) >> np.uint64(32)).astype(np.uint32), bounds[:-1])
    return out


def _featurise(width: int, bands: int, rows: int, seed: int):
    mult, add, weight = random_u64(bands * rows, seed), random_u64(bands * rows, seed + 1), random_u64(rows, seed + 2)

    def run(batches):
        tok = Tokenizer()
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                n = j - i
                h, d = shingle_hashes(tok.words(buf, off), width)
                values, bounds = distinct_sets(h, d, n)
                f1, f2 = _fingerprints(values, bounds)
                full = np.flatnonzero(np.diff(bounds) > 0)
                minima = _minima(values, np.concatenate([bounds[full], bounds[-1:]]), mult, add) if len(full) else np.zeros((0, bands * rows), np.uint32)
                keys = minima.reshape(len(full), bands, rows).astype(np.uint64) @ weight if len(full) else np.zeros((0, bands), np.uint64)
                keys = mix64(keys + (np.arange(bands, dtype=np.uint64) << np.uint64(56))).view(np.int64)
                size = np.zeros(n + 1, np.int64)
                size[1:][full] = 1
                at = np.cumsum(size)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, n), pa.array(np.diff(bounds)), pa.array(f1), pa.array(f2),
                        binary_array(minima.astype(np.uint8).ravel(), at * (bands * rows)),
                        pa.ListArray.from_arrays(pa.array((at * bands).astype(np.int32)), pa.array(keys.ravel())),
                    ],
                    names=["id", "n", "f1", "f2", "sig", "keys"],
                )

    return run


def _sets(width: int):
    def run(batches):
        tok = Tokenizer()
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                h, d = shingle_hashes(tok.words(buf, off), width)
                values, bounds = distinct_sets(h, d, j - i)
                yield pa.record_batch([batch.column(0).slice(i, j - i), binary_array(values, bounds * 1)], names=["id", "set"])

    return run


def similar(x, y, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) < len(y):
        x, y = y, x
    at = np.searchsorted(x, y)
    at[at == len(x)] = len(x) - 1
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Keeps pairs of similar full sets."""

    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _halves(table, length: int):
    """(rows, columns) of a tile and the signatures, ids and components of all its members."""
    side = table["side"].to_numpy()
    row, col = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, length)
    return row, col if len(col) else row, sig, table["id"].to_numpy(), table["comp"].to_numpy()


def _suspects(need: int, length: int):
    """Members of a bucket tile that have a partner in another component whose signature agrees in ``need`` places or more."""

    def run(key, table):
        row, col, sig, ids, comp = _halves(table, length)
        hit = np.zeros(len(ids), bool)
        for k in row:
            other = col[comp[col] != comp[k]]
            near = other[(sig[other] == sig[k]).sum(axis=1) >= need]
            hit[near] = True
            hit[k] |= len(near) > 0
        n = int(hit.sum())
        return pa.table({"bucket": pa.array([key[0].as_py()] * n, pa.int64()), "id": pa.array(ids[hit], pa.int64())})

    return run


def _across(need: int, length: int, percent: int):
    """Links that join the components of a bucket tile, confirmed on full sets: a forest, never all pairs.

    A pair whose components were joined by an earlier link of the tile is not
    compared any more; of two components every other pair is, once, in the
    first bucket that it shares.
    """

    def run(key, table):
        row, col, sig, ids, comp = _halves(table, length)
        sets, keys = table["set"], table["keys"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        _, group = np.unique(comp, return_inverse=True)
        held: dict[int, np.ndarray] = {}

        def values(x):
            if x not in held:
                held[x] = np.frombuffer(sets[x].as_buffer(), np.uint64)
            return held[x]

        a, b = [], []
        for k in row:
            other = col[group[col] != group[k]]
            other = other[(sig[other] == sig[k]).sum(axis=1) >= need]
            first = keys[k][(keys[other] == keys[k]).argmax(axis=1)]
            for x in other[first == key[0].as_py()]:
                if group[x] != group[k] and similar(values(k), values(x), percent):
                    group[group == group[x]] = group[k]
                    a.append(ids[k])
                    b.append(ids[x])
        lo, hi = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        return pa.table({"a": pa.array(lo, pa.int64()), "b": pa.array(hi, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, tile: int = 1024, tile_bytes: int = 16_000_000, seed: int = 7) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable over links), kept.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets
    of distinct ``width``-word shingles; a text of fewer words is one shingle,
    its whole sequence.  Null, empty or blank texts have an empty set and link
    with nothing.  Repeated rows of one id count as copies; rows with a null
    id come out with a null component and are kept.  Shingles are held as
    64-bit hashes.  At the default 25 bands of 5 a pair at the threshold shares
    no band with probability 5e-5 and fails the signature screen (4.5 standard
    deviations) with 1e-5; both together are the chance of missing a pair that
    no chain of others connects.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feats = scratch.keep(base.mapInArrow(_featurise(width, bands, rows, seed), "id long, n long, f1 long, f2 long, sig binary, keys array<long>"))

    # copies: the least id of each set stands for it
    some = feats.where("n > 0 and id is not null")
    rep = some.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    rep = scratch.keep(rep)  # a table of its own, so that the join may split a large group of copies
    member = scratch.keep(some.select("id", "n", "f1", "f2").join(rep, ["n", "f1", "f2"]).select("id", "rep").distinct())
    unique = some.join(member.where("id = rep").select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "f1", "f2"])

    bucketed = unique.select("id", F.posexplode("keys").alias("band", "bucket")).select("id", "bucket", F.xxhash64("id", "band").alias("r"))
    centres = bucketed.groupBy("bucket").agg(F.min_by("id", "r").alias("c1"), F.max_by("id", "r").alias("c2")).where("c1 <> c2")
    centres = scratch.keep(centres)
    in_bucket = scratch.keep(bucketed.select("id", "bucket").join(centres, "bucket"))
    pairs = in_bucket.select("id", F.explode(F.array("c1", "c2")).alias("c")).where("id <> c")
    pairs = pairs.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()

    length = bands * rows
    need = int(length * (percent / 100 - 4.5 * math.sqrt(percent / 100 * (1 - percent / 100) / length)))
    wanted = scratch.keep(in_bucket.select("id").distinct())
    sets = scratch.keep(base.join(broadcast_if_small(wanted), "id", "left_semi").mapInArrow(_sets(width), "id long, set binary").dropDuplicates(["id"]))
    sigs = scratch.keep(unique.select("id", "sig").join(broadcast_if_small(wanted), "id", "left_semi"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
        return scratch.keep(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"))

    agree = F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.lit(0), lambda n, k: n + (F.substring("s", k, F.lit(1)) == F.substring("t", k, F.lit(1))).cast("int"))
    screened = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("s")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("t")), "b")
    links = confirmed(scratch.keep(screened.where(agree >= need).select("a", "b")))
    comps = scratch.keep(connected_components(links, scratch))

    # buckets in several components: compare across these, first by signature alone, then on the sets of those that came near
    at = in_bucket.select("id", "bucket").join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", "bucket", F.coalesce("component", "id").alias("comp"))
    at = scratch.keep(at)

    def tiled(rows: DataFrame, size) -> DataFrame:
        """Rows of open buckets (id, bucket, comp) with their tiles; ``size``: tiles' worth of a bucket's rows."""
        open_ = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(size).cast("int").alias("tiles")).where("lo < hi")
        out = rows.join(scratch.keep(open_.select("bucket", "tiles")), "bucket")
        return out.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))

    place = [F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side")]
    spread = tiled(at, F.count("*") / tile).join(sigs, "id").select("id", "comp", "sig", "bucket", *place)
    near = scratch.keep(spread.groupBy("bucket", "p", "q").applyInArrow(_suspects(need, length), "bucket long, id long"))
    if near.head(1):
        sizes = unique.select("id", F.col("n").alias("size"), "keys")
        some = scratch.keep(near.distinct().join(at, ["bucket", "id"]).join(sizes, "id"))
        spread = tiled(some, F.greatest(F.count("*") / tile, F.sum("size") * 8 / tile_bytes)).join(sigs, "id").join(sets, "id").select("id", "comp", "sig", "set", "keys", "bucket", *place)
        more = scratch.keep(spread.groupBy("bucket", "p", "q").applyInArrow(_across(need, length, percent), "a long, b long"))
        if more.head(1):
            comps = scratch.keep(connected_components(links.union(more), scratch))

    joined = member.join(comps, member.rep == comps.node, "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = feats.select("id", "n").join(joined, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component; all columns stay as they are."""
    verdict = near_duplicates(docs, id_col=id_col, **options)
    (name,) = unused(docs.columns, "gone")
    gone = verdict.where("not kept").select(F.col(id_col).alias(name)).distinct()
    gone = Scratch(docs.sparkSession).keep(gone)
    return docs.join(broadcast_if_small(gone), docs[id_col] == F.col(name), "left_anti")
