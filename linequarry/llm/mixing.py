"""Source mixing by temperature, realised as budgeted block permutations.

1. A source with token share p gets the weight p^a / sum(p^a).  The exponent a
   in [0, 1] is found on a grid of 4096 steps by 64-fold bisection over the
   table of source totals: the flattest mix (least a) that repeats no source
   more than ``max_epochs`` times, and the largest a at or above it whose
   entropy still reaches ``min_entropy`` nats, if that is given.
2. Each source is read in epochs; every epoch is a fresh permutation of all its
   documents by a hash of (seed, source, epoch, id).  Whole epochs are used as
   often as the source's share of the budget allows; the last one is cut where
   its running token count passes what is left.
3. The stream is cut into blocks of ``block_tokens`` tokens that hold each
   source in its weight: a copy's block follows from its place in its source.
   ``order_key`` permutes the copies inside a block.

Running token counts never gather a source: a permutation is cut into slices
of about ``slice_rows`` rows by the hash itself, windows run inside a slice,
and slice totals are summed up on a table with one row per slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import Scratch

STEPS = 4096


def count_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """docs: source_key, n_tokens.  One row per source: n_docs, tokens, share (of all tokens)."""
    totals = docs.groupBy("source_key").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    all_ = totals.agg(F.sum("tokens").alias("all_tokens"))
    return totals.crossJoin(F.broadcast(all_)).withColumn("share", F.col("tokens") / F.nullif(F.col("all_tokens"), F.lit(0)))


def _epochs(weight, total, tokens, budget):
    return weight / total * budget / tokens


def find_exponent(totals: DataFrame, budget: float | None, max_epochs: float | None, min_entropy: float | None) -> int:
    """The exponent in steps of 1 / 4096; totals has share and tokens."""
    some = totals.where("tokens > 0").select("share", "tokens", "all_tokens")

    def figures(steps: list[int]) -> dict[int, tuple[float, float]]:
        g = some.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
        w = F.pow("share", F.col("step") / STEPS)
        rows = g.groupBy("step").agg(
            F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("wl"), F.max(w / F.col("tokens")).alias("hi"), F.min(w / F.col("tokens")).alias("lo"), F.max("all_tokens").alias("n")
        )
        out = {}
        for r in rows.collect():  # one row per step
            epochs = r.hi / r.lo if budget is None else r.hi / r.z * budget * r.n
            out[r.step] = (epochs, _entropy(r.z, r.wl))
        return out

    def least(ok) -> int:
        """Least step for which ok holds (it holds from there on), or STEPS."""
        lo, hi = 0, STEPS
        while lo < hi:
            width = max(1, (hi - lo) // 64)
            steps = sorted({*range(lo, hi, width), hi})
            got = figures(steps)
            if not got:
                return STEPS
            first = next((s for s in steps if ok(got[s])), None)
            if first is None:
                return STEPS
            below = [s for s in steps if s < first]
            if not below or first - below[-1] == 1:
                return first
            lo, hi = below[-1] + 1, first
        return hi

    step = 0 if max_epochs is None and min_entropy is None else None
    if max_epochs is not None:
        step = least(lambda f: f[0] <= max_epochs + 1e-9)
    if min_entropy is not None:
        low = least(lambda f: f[1] < min_entropy - 1e-12)
        top = low if low == STEPS else max(0, low - 1)
        step = top if step is None else max(step, top)
    return step


def _entropy(z, wl):
    """Entropy of weights w / z from z = sum w and wl = sum w ln w."""
    import math

    return math.log(z) - wl / z


def plan(docs: DataFrame, budget: float | None = None, max_epochs: float | None = 4.0, min_entropy: float | None = None, block_tokens: int = 1_000_000, slice_rows: int = 2000, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with one row per selected copy and the columns mix_tokens, mix_epoch, mix_block, mix_key.

    ``budget`` is a multiple of all tokens; None means the least budget that
    reads every source at least once, so that no document is left out.  A null
    source is a source of its own; sources without any token are read once.
    Existing columns of these names are replaced; an empty table gives no row.
    Rows that share id and source are permuted by a hash of their text, too.
    """
    made = ("mix_tokens", "mix_epoch", "mix_block", "mix_key")
    own = [c for c in docs.columns if c not in made]
    held = {c: f"own column {k}" for k, c in enumerate(own)}  # their names may be any; those below are free of them
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    base = docs.select(
        *[docs[f"`{c}`"].alias(n) for c, n in held.items()], key.alias("source_key"), F.col(id_col).cast("string").alias("_id"),
        count_words(F.col(text_col)).alias("mix_tokens"), F.xxhash64(F.col(text_col).cast("string")).alias("_tie"),
    )
    # texts are counted once for all totals, and once more for the copies themselves
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.keep(base.select("source_key", "_id", "mix_tokens"))
    totals = scratch.keep(source_totals(narrow.select("source_key", F.col("mix_tokens").alias("n_tokens"))))
    step = find_exponent(totals, budget, max_epochs, min_entropy)
    w = F.when(F.col("tokens") > 0, F.pow("share", F.lit(step / STEPS))).otherwise(F.lit(0.0))
    weights = totals.withColumn("w", w)
    sums = weights.agg(F.sum("w").alias("z"), F.min(F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))).alias("lo"))
    target = (F.col("w") / F.col("lo")) if budget is None else (F.col("w") / F.col("z") * F.lit(float(budget)) * F.col("all_tokens"))
    weights = weights.crossJoin(F.broadcast(sums)).select(
        F.col("source_key"), "n_docs", "tokens", (F.col("w") / F.col("z")).alias("weight"), F.coalesce(target, F.lit(0.0)).alias("target")
    )
    full = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens") + 1e-9)).otherwise(F.lit(1)).cast("long")
    weights = weights.withColumn("full", full).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("tokens")))
    last = F.when((F.col("tokens") > 0) & (F.col("rest") > 0), F.col("full")).otherwise(F.col("full") - 1)
    weights = weights.withColumn("last", last).withColumn("slices", F.ceil(F.col("n_docs") / slice_rows).cast("long")).where("last >= 0")

    def place():
        text = F.concat_ws("|", F.lit(str(seed)), "source_key", F.col("mix_epoch").cast("string"), F.coalesce(F.col("_id"), F.lit("")))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")

    shape = weights.select(F.col("source_key").alias("_s"), "tokens", "weight", "full", "rest", "last", "slices")
    shape = F.broadcast(shape) if _few(weights) else shape

    def copies_of(rows: DataFrame) -> DataFrame:
        out = rows.join(shape, F.col("source_key") == F.col("_s")).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("last"))))
        return out.withColumn("_p", place()).withColumn("slice", F.floor(F.col("_p") / F.lit(float(1 << 52)) * F.col("slices")).cast("long"))

    copies = copies_of(base)

    def slice_sums(rows: DataFrame) -> DataFrame:
        per = rows.groupBy("source_key", "mix_epoch", "slice").agg(F.sum("mix_tokens").alias("t"))
        before = F.sum("t").over(W.partitionBy("source_key", "mix_epoch").orderBy("slice")) - F.col("t")
        return per.select(F.col("source_key").alias("_k"), F.col("mix_epoch").alias("_e"), F.col("slice").alias("_sl"), before.alias("before"))

    inside = W.partitionBy("source_key", "mix_epoch", "slice").orderBy("_p", "_id", "mix_tokens", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = copies.withColumn("run", F.sum("mix_tokens").over(inside))
    sums = slice_sums(copies_of(narrow).select("source_key", "mix_epoch", "slice", "mix_tokens"))
    out = placed.join(sums, (placed.source_key == sums._k) & (placed.mix_epoch == sums._e) & (placed.slice == sums._sl))
    done = F.col("before") + F.col("run")
    out = out.where((F.col("mix_epoch") < F.col("full")) | (done <= F.col("rest") + 1e-6))
    start = F.col("mix_epoch") * F.col("tokens") + done - F.col("mix_tokens")
    block = F.when(F.col("weight") > 0, F.floor(start / (F.col("weight") * block_tokens) + 1e-9)).otherwise(F.lit(0)).cast("long")
    return out.select(*[F.col(n).alias(c) for c, n in held.items()], F.col("mix_tokens"), F.col("mix_epoch").cast("long").alias("mix_epoch"), block.alias("mix_block"), F.col("_p").alias("mix_key"))


def _few(weights: DataFrame, bound: int = 10_000) -> bool:
    """Whether the table of sources is small enough to broadcast."""
    return weights.limit(bound + 1).count() <= bound


def oracle(budget: float, max_epochs: float, block_tokens: int, slice_rows: int, seed: int) -> str:
    """DuckDB twin of a plan with a budget and a repetition limit (ids, tokens and places)."""
    return rf"""
with d as (select doc_id, source, case when source is null then 'null' else '=' || source end k,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) tok from documents),
t as (select k, sum(tok)::bigint tokens, count(*) n_docs from d group by k),
s as (select *, sum(tokens) over () n, tokens / sum(tokens) over () share from t),
g as (select i, sum(share ** (i / {STEPS}.0)) filter (tokens > 0) z, max(share ** (i / {STEPS}.0) / tokens) filter (tokens > 0) hi, max(n) n from s, range(0, {STEPS} + 1) r(i) group by i),
a as (select coalesce(min(i) filter (hi / z * {budget} * n <= {max_epochs} + 1e-9), {STEPS}) step from g),
w0 as (select *, case when tokens > 0 then share ** (step / {STEPS}.0) else 0 end w from s, a),
w1 as (select *, w / sum(w) over () weight, w / sum(w) over () * {budget} * n target from w0),
w2 as (select *, case when tokens > 0 then floor(target / tokens + 1e-9)::bigint else 1 end as full_ from w1),
w3 as (select *, greatest(0, target - full_ * tokens) rest from w2),
w as (select *, case when tokens > 0 and rest > 0 then full_ else full_ - 1 end as last_ from w3),
c as (select d.*, tokens, weight, full_, rest, e::bigint e, ('0x' || substr(md5('{seed}|' || k || '|' || e || '|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint p
  from d join w using (k), range(0, 1000) r(e) where e <= last_),
f as (select *, sum(tok) over (partition by k, e order by p, doc_id, tok rows unbounded preceding) run from c)
select doc_id, source, tok mix_tokens, e mix_epoch, p mix_key,
  case when weight > 0 then floor((e * tokens + run - tok) / (weight * {block_tokens}) + 1e-9)::bigint else 0 end mix_block
from f where e < full_ or run <= rest + 1e-6"""
