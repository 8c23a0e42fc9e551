"""Near-duplicate embeddings by collision-counting projections.

Each vector, scaled to unit length, is projected on ``m`` random lines.  A
query's window on a line reaches ``h`` to both sides of its own value; a pair
collides on a line when one lies in the other's window.  At the cosine limit c
the difference on a line is normal with deviation sqrt(2 - 2c), so the number
of collisions is binomial; pairs with at least its ``miss`` quantile are
verified by their exact cosine in double precision.

Sorting whole lines does not give right results at scale: windows wide enough
for the recall meet about a fifth of all pairs on every line, which grows with
the square of the table (measured: see the README).  Windows are therefore laid
over cells: the signs of ``k`` further projections, in ``tables`` independent
tables.  k grows with log2 of the table so that a cell holds about
``per_cell`` vectors, and the number of tables follows from k so that a pair at
the limit shares no cell with probability ``miss`` at most.  In a cell the
lines are compared in tiles of bounded size; a cell of many vectors becomes
many tiles.  Only pairs whose count passes have their cosine computed.

Equal vectors collapse onto their least id first.  A pair found in several
tables is counted in the first one only, so link counts add up without any
list of pairs leaving a tile; tiles emit counts per vector and a spanning
forest of their links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blas import one_thread
from .graph import connected_components
from .tables import Scratch, broadcast_if_small
from .textops import binary_array, mix64, random_u64


def _unpack(wide: bool):
    """(id, f1, f2, dim, vec): bytes of each usable vector, null for the others."""
    kind = np.float64 if wide else np.float32

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                    else:  # by a power of two, so that squares neither overflow nor vanish; cosines stay as they are
                        v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
                out.append(v)
            salts = random_u64(max([len(v) for v in out if v is not None], default=1) * 2, 61)
            f = np.zeros((len(out), 2), np.int64)
            for k, v in enumerate(out):
                if v is not None:
                    bits = mix64((v + kind(0)).astype(np.float64).view(np.uint64))
                    for side in (0, 1):
                        f[k, side] = mix64(np.array([(bits * salts[side::2][: len(v)]).sum(dtype=np.uint64) + np.uint64(len(v))], np.uint64)).view(np.int64)[0]
            yield pa.record_batch(
                [batch.column(0), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array([None if v is None else len(v) for v in out], pa.int64()), pa.array([None if v is None else v.tobytes() for v in out], pa.binary())],
                names=["id", "f1", "f2", "dim", "vec"],
            )

    return run


def _matrix(column, kind, dim):
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _lines(dim, n, seed):
    return np.random.default_rng([seed, dim, n]).standard_normal((dim, n))


def _keys(x, bits, tables, seed):
    """The cell of each row of ``x`` in each table: table number, dimension and k signs in one long."""
    dim = x.shape[1]
    signs = (x @ _lines(dim, bits * tables, seed) > 0).reshape(len(x), tables, bits)
    code = (signs.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return mix64(code + (np.arange(tables, dtype=np.uint64) << np.uint64(48)) + mix64(np.full(1, dim, np.uint64)))


def _cells(wide, bits, tables, seed):
    """(id, mult, dim, vec, cells) of rows (id, mult, dim, vec)."""
    kind = np.float64 if wide else np.float32

    def run(batches):
        one_thread()
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(2).to_numpy()
            keys = np.zeros((batch.num_rows, tables), np.uint64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                keys[at] = _keys(_matrix(batch.column(3).take(pa.array(at)), kind, dim), bits, tables, seed)
            bounds = np.arange(batch.num_rows + 1) * tables
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.ravel().view(np.int64)))], names=[*batch.schema.names, "cells"])

    return run


def runs_of_keys(batches, n_keys: int):
    """Tables of the rows that share their first ``n_keys`` (long) columns, from partitions sorted by these."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in range(n_keys)], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(k[a])
            if key is not None and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _forest(linked):
    """Star edges (row index, column index) that connect what ``linked`` (rows x columns) connects."""
    n, m = linked.shape
    left, right = np.arange(n), np.full(m, n + m)
    while True:
        low = np.where(linked, left[:, None], n + m).min(axis=0)
        right2 = np.minimum(right, low)
        back = np.where(linked, right2[None, :], n + m).min(axis=1)
        left2 = np.minimum(left, back)
        if (left2 == left).all() and (right2 == right).all():
            return left, right
        left, right = left2, right2


def _cosines(x, i, j, step: int = 1 << 14):
    """Inner products of the rows i and j of ``x``, a bounded number at a time."""
    return np.concatenate([np.einsum("ij,ij->i", x[i[a : a + step]], x[j[a : a + step]]) for a in range(0, len(i), step)])


def _link(wide, limit, m, h, need, bits, tables, seed):
    kind = np.float64 if wide else np.float32

    def run(batches):
        one_thread()
        ids, others, counts = [], [], []
        for key, t in runs_of_keys(batches, 3):
            if t.num_rows < 2:
                continue
            dim = int(t["dim"][0].as_py())
            side = t["side"].to_numpy()
            row, col = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            square = not len(col)
            if square:
                col = row
            if not len(row):
                continue
            x = _matrix(t["vec"], kind, dim)
            raw = x
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            at = (x @ _lines(dim, m, seed + 1)).astype(np.float32)
            hits = np.zeros((len(row), len(col)), np.uint8)
            for j in range(m):
                hits += np.abs(at[row, j][:, None] - at[col, j]) <= h
            vid = t["id"].to_numpy()
            linked = (hits >= need) & (vid[row][:, None] != vid[col])
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            close = _cosines(x, row[i], col[j]) >= limit
            linked[i[~close], j[~close]] = False
            i, j = i[close], j[close]
            if not len(i):
                continue
            cells = _keys(raw, bits, tables, seed)
            table = int(t["tab"][0].as_py())
            for before in range(table):
                linked[i, j] &= cells[row[i], before] != cells[col[j], before]
                keep = linked[i, j]
                i, j = i[keep], j[keep]
            mult = t["mult"].to_numpy()
            n_row = linked @ mult[col]
            parts = [(vid[row], n_row)] if square else [(vid[row], n_row), (vid[col], linked.T @ mult[row])]
            for v, n in parts:
                ids.append(v[n > 0])
                others.append(v[n > 0])
                counts.append(n[n > 0])
            left, right = _forest(linked)
            for v, root in ((vid[row], left), (vid[col], right)):
                ok = root < len(row)
                ids.append(v[ok])
                others.append(vid[row][root[ok]])
                counts.append(np.zeros(ok.sum(), np.int64))
            if sum(map(len, ids)) > 50_000:
                yield _rows(ids, others, counts)
                ids, others, counts = [], [], []
        if ids:
            yield _rows(ids, others, counts)

    return run


def _rows(ids, others, counts):
    a, b, n = np.concatenate(ids), np.concatenate(others), np.concatenate(counts).astype(np.int64)
    keep = (a != b) | (n > 0)
    return pa.record_batch([pa.array(a[keep]), pa.array(b[keep]), pa.array(n[keep])], names=["a", "b", "n"])


def _quantile(m, p, miss):
    """Largest count that a binomial (m, p) reaches with probability 1 - miss or more."""
    total = 0.0
    for k in range(m + 1):
        total += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if total > miss:
            return k
    return m


def near_vectors(vectors: DataFrame, limit: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", m: int = 48, per_cell: int = 64, miss: float = 1e-3, tile: int = 512, seed: int = 71) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; so do vectors of different lengths with one another.
    Repeated rows of an id count as copies that link with each other (of
    different vectors of one id the one with the least fingerprint counts); a
    row with a null id comes out with a null component, unlinked and kept.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    wide = "float" not in dict(vectors.select(vec_col).dtypes)[vec_col]
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>" if wide else "array<float>").alias("v"))
    feats = scratch.keep(base.mapInArrow(_unpack(wide), "id long, f1 long, f2 long, dim long, vec binary"))
    usable = feats.where("dim is not null and id is not null")
    prints = usable.select("id", F.xxhash64("f1", "f2", "dim").alias("f")).groupBy("id").agg(F.min("f").alias("one"), F.max("f").alias("most"))
    several = scratch.keep(prints.where("one <> most").select(F.col("id").alias("_of"), "one"))
    if several.head(1):
        usable = usable.join(broadcast_if_small(several), F.col("id") == F.col("_of"), "left").where("one is null or one = xxhash64(f1, f2, dim)").drop("_of", "one")
    reps = usable.groupBy("f1", "f2", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    reps = scratch.keep(reps)  # a table of its own, so that the join may split a large group of copies
    member = scratch.keep(usable.select("id", "f1", "f2", "dim").join(reps, ["f1", "f2", "dim"]).select("id", "rep", "mult"))
    firsts = member.where("id = rep").select("id", "mult").distinct()
    unique = scratch.keep(usable.select("id", "dim", "vec").join(firsts, "id").dropDuplicates(["id"]).select("id", "mult", "dim", "vec"))
    n = unique.count()

    bits = max(4, min(40, round(math.log2(max(n, 1) / per_cell))))
    same = (1 - math.acos(limit) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(miss) / math.log(1 - same)))
    spread = math.sqrt(2 - 2 * limit)
    h = 1.15 * spread
    need = _quantile(m, math.erf(1.15 / math.sqrt(2)), miss)

    celled = unique.mapInArrow(_cells(wide, bits, tables, seed), "id long, mult long, dim long, vec binary, cells array<long>")
    celled = scratch.keep(celled)
    open_ = celled.select(F.explode("cells").alias("cell")).groupBy("cell").count()
    large = broadcast_if_small(open_.where(F.col("count") > tile).select(F.col("cell").alias("c"), F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    rows = celled.select("id", "mult", "dim", "vec", F.posexplode("cells").alias("tab", "cell"))
    rows = rows.join(large, rows.cell == large.c, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)))
    rows = rows.select("cell", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "id", "mult", "dim", "vec", "tab", F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))
    rows = rows.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q")
    found = scratch.keep(rows.mapInArrow(_link(wide, limit, m, h, need, bits, tables, seed), "a long, b long, n long"))

    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select("a", "b"), scratch)
    out = member.join(counts, member.rep == counts.a, "left").join(comps, member.rep == comps.node, "left")
    out = out.select(F.col("id").alias("_id"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = out.dropDuplicates(["_id"])
    got = feats.select("id").join(out, F.col("id") == F.col("_id"), "left")
    component = F.coalesce("component_id", "id")
    return got.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


ORACLE = """
with recursive v as (select vec_id id, embedding::double[] e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(embedding::double[], embedding::double[]) > 0),
l as (select a.id a, b.id b from v a join v b on a.id <> b.id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
c as (select id, id root from v union select l.b, c.root from c join l on l.a = c.id),
m as (select id, min(root) root from c group by id)
select vec_id, coalesce((select count(*) from l where l.a = vec_id), 0)::bigint n_links, coalesce(root, vec_id) component_id, coalesce(root, vec_id) = vec_id kept
from embeddings left join m on m.id = vec_id"""
