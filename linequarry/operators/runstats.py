"""Statistics of timed runs: series summaries, groups, outliers, drift, health, signals, hints.

A run table has run_id, ts, profile, ms, ref_ms, discover_ms, scan_ms,
aggregate_ms, total_ms (0 if unknown) and, for ``challengers``, a map of
structs.  Order in time is (ts, run_id).

Percentiles are order statistics, sorted[min(n - 1, floor(p n / 100))]: values
are first counted per (group, value).  No task orders a whole group: rows are
dealt to the tasks by ranges of (group, order) and cut into blocks of one Arrow
batch at most; only a few figures of each block are put together by group.
Only a few rows reach the driver, in ``signals`` and ``hints``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # what runs on executors travels with its closures

FIELDS = ("run_id", "ts", "profile", "ms", "ref_ms", "discover_ms", "scan_ms", "aggregate_ms", "total_ms")
RANKS = {"p05": 5, "p10": 10, "p25": 25, "median": 50, "p75": 75, "p90": 90, "p95": 95, "p99": 99}
RECENT = 100
LEAST_WINDOW = 10
#: up to so many groups, their figures are broadcast to the rows; beyond it the join is shuffled
FEW = 10_000
STATS = ["n", "min", *RANKS, "max", "mean", "stdev", "variance", "range", "iqr", "mad", "skew", "step", "slope", "cv_pct", "robust_cv_pct"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def speedup_pct(ms: Column, ref: Column) -> Column:
    return F.when(ref > 0, (ref - ms) / ref * 100).otherwise(F.lit(0.0))


def hotspot(discover: Column, scan: Column, aggregate: Column) -> Column:
    """The longest phase; of equal ones scan goes before discover before aggregate."""
    top = F.greatest(discover, scan, aggregate)
    return F.when(top == scan, "scan").when(top == discover, "discover").otherwise("aggregate")


def derive(runs: DataFrame) -> DataFrame:
    """Adds ratio, speedup_pct, hotspot and the phases' shares; missing numbers count as 0."""
    names = ["ms", "ref_ms", "discover_ms", "scan_ms", "aggregate_ms", "total_ms"]
    out = runs.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in runs.columns else F.lit(0.0) for n in names})
    d, s, a, t = (F.col(n) for n in names[2:])
    whole = F.when(t > 0, t).otherwise(d + s + a)
    out = out.withColumns({"ratio": ratio(F.col("ms"), F.col("ref_ms")), "speedup_pct": speedup_pct(F.col("ms"), F.col("ref_ms")), "hotspot": hotspot(d, s, a)})
    return out.withColumns({f"{n}_pct": F.when(whole > 0, x / whole * 100).otherwise(F.lit(0.0)) for n, x in (("discover", d), ("scan", s), ("aggregate", a))})


def _finite(runs: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return runs.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = column[1:], column[:-1]
    try:
        differ = pc.fill_null(pc.not_equal(a, b), False)
    except pa.ArrowNotImplementedError:  # nested keys
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
    return pc.or_(differ, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def _blocks(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], figures: Callable[..., list[np.ndarray]], fields: dict[str, object]) -> DataFrame:
    """One row per block, a run of rows of one key in the order: key, its place (_part, _block), and ``fields``.

    ``figures`` takes the blocks' starts and sizes in a batch and its ``values``.  Each row is read once, by the task of its range.
    """
    n_key = len(key)
    schema = StructType([rows.schema[k] for k in key] + [StructField("_part", IntegerType()), StructField("_block", LongType())] + [StructField(k, t) for k, t in fields.items()])

    def cut(batches):
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in range(n_key):
                new[1:] |= _changes(batch.column(k))
            starts = np.flatnonzero(new)
            got = figures(starts, np.diff(starts, append=batch.num_rows), *[batch.column(n_key + k).to_numpy(zero_copy_only=False) for k in range(len(values))])
            place = [pa.array(np.full(len(starts), part, np.int32)), pa.array(np.arange(block, block + len(starts)))]
            block += len(starts)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(starts)) for k in range(n_key)] + place + [pa.array(g) for g in got], names=schema.names)

    return rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).select(*key, *values).mapInArrow(cut, schema)


def _few(rows: DataFrame, by: Sequence[str]) -> bool:
    return not by or rows.select(*by).distinct().limit(FEW + 1).count() <= FEW


def _counts(runs: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return _finite(runs, value).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))


def _range_of(starts, sizes, v, c):
    return [v[starts], v[starts + sizes - 1], np.add.reduceat(c, starts)]


def _at_ranks(counts: DataFrame, by: Sequence[str], which: dict[str, int], few: bool) -> DataFrame:
    """ranks of values (_v) that occur _c times: the block of each rank from the blocks' counts, then the rank among the values of that block."""
    w, place = W.partitionBy(*by), W.partitionBy(*by).orderBy("_part", "_block").rowsBetween(W.unboundedPreceding, 0)
    b = _blocks(counts, by, ["_v"], ["_v", "_c"], _range_of, {"_lo": DoubleType(), "_hi": DoubleType(), "_k": LongType()})
    b = b.withColumns({"_n": F.sum("_k").over(w), "_to": F.sum("_k").over(place)})
    spots = F.array(*[F.struct(F.lit(k).alias("_rank"), F.least(F.col("_n") - 1, F.floor(F.col("_n") * p / 100)).alias("_spot")) for k, p in which.items()])
    b = b.select(*by, "_lo", "_hi", (F.col("_to") - F.col("_k")).alias("_from"), "_to", F.inline(spots)).where("_from <= _spot and _spot < _to").drop("_to")
    b = F.broadcast(b) if few else b
    near = (counts.join(b, list(by)) if by else counts.crossJoin(b)).where("_v between _lo and _hi")
    run = W.partitionBy(*by, "_rank").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("_to", F.col("_from") + F.sum("_c").over(run)).where("_to - _c <= _spot and _spot < _to")
    return near.groupBy(*by).agg(*[F.max(F.when(F.col("_rank") == k, F.col("_v"))).alias(k) for k in which])


def ranks(runs: DataFrame, value: str, by: Sequence[str], which: dict[str, int]) -> DataFrame:
    """by and one column per order statistic."""
    return _at_ranks(_counts(runs, value, by), by, which, _few(runs, by))


def _course(starts, sizes, x):
    """Size, first, last, mean, sum of steps, and sum of products of deviations of place and value."""
    step = np.abs(np.diff(x, prepend=x[:1]))
    step[starts] = 0.0
    mean = np.add.reduceat(x, starts) / sizes
    i = np.arange(len(x)) - np.repeat(starts + (sizes - 1) / 2, sizes)
    return [sizes.astype(np.int64), x[starts], x[starts + sizes - 1], mean, np.add.reduceat(step, starts), np.add.reduceat(i * (x - np.repeat(mean, sizes)), starts)]


def _timed(some: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Mean step and least-squares slope of _x against its place in the order."""
    w, place = W.partitionBy(*key), W.partitionBy(*key).orderBy("_part", "_block")
    b = _blocks(some, key, order, ["_x"], _course, {"_k": LongType()} | dict.fromkeys(["_first", "_last", "_mean", "_steps", "_lean"], DoubleType()))
    b = b.withColumns({
        "_n": F.sum("_k").over(w), "_m": F.sum(F.col("_k") * F.col("_mean")).over(w) / F.sum("_k").over(w),
        "_to": F.sum("_k").over(place.rowsBetween(W.unboundedPreceding, 0)), "_gap": F.coalesce(F.abs(F.col("_first") - F.lag("_last").over(place)), F.lit(0.0)),
    })
    middle = F.col("_to") - (F.col("_k") - 1) / 2 - (F.col("_n") + 1) / 2  # the block's mean place, from that of the group
    lean = F.col("_lean") + F.col("_k") * middle * (F.col("_mean") - F.col("_m"))
    n = F.max("_n").cast("double")
    return b.groupBy(*key).agg(
        F.when(n > 1, F.sum(F.col("_steps") + F.col("_gap")) / (n - 1)).otherwise(0.0).alias("step"), F.when(n > 1, F.sum(lean) * 12 / (n * (n * n - 1))).otherwise(0.0).alias("slope")
    )


def series(runs: DataFrame, value: str, by: Sequence[str] = (), order: Sequence[str] = ("ts", "run_id"), stats: Sequence[str] = STATS, few: bool | None = None) -> DataFrame:
    """One row per group: by and ``stats``, by default all of STATS; non-finite values are left out.

    ``few``: whether there are at most FEW groups; counted if not given.
    """
    key = list(by) or ["_all"]
    few = _few(runs, by) if few is None else few
    some = _finite(runs.withColumn("_all", F.lit(1)), value).withColumn("_x", F.col(value).cast("double"))
    out = some.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.avg("_x").alias("mean"), F.var_pop("_x").alias("variance"), F.stddev_pop("_x").alias("stdev"), F.skewness("_x").alias("_skew")
    )
    counts = _counts(some, "_x", key)
    at = _at_ranks(counts, key, RANKS, few)
    out = out.join(at, key)
    zero = F.lit(0.0)
    if {"step", "slope"} & set(stats):
        out = out.join(_timed(some, key, order), key)
    if {"mad", "robust_cv_pct"} & set(stats):
        mid = at.select(*key, F.col("median").alias("_m"))
        away = counts.join(F.broadcast(mid) if few else mid, key).groupBy(*key, F.abs(F.col("_v") - F.col("_m")).alias("_v")).agg(F.sum("_c").alias("_c")).where(F.col("_v") < float("inf"))
        out = out.join(_at_ranks(away, key, {"mad": 50}, few), key)
        out = out.withColumn("robust_cv_pct", F.when(F.col("median") != 0, 1.4826 * F.col("mad") / F.abs(F.col("median")) * 100).otherwise(zero))
    out = out.withColumns({
        "range": F.col("max") - F.col("min"), "iqr": F.col("p75") - F.col("p25"),
        "skew": F.when((F.col("n") < 3) | (F.col("stdev") == 0), zero).otherwise(F.col("_skew")),
        "cv_pct": F.when(F.col("mean") != 0, F.col("stdev") / F.col("mean") * 100).otherwise(zero),
    })
    return out.select(*by, *stats)


def semivariance_above(runs: DataFrame, value: str, limit: float, by: Sequence[str] = ()) -> DataFrame:
    return runs.groupBy(*by).agg(F.coalesce(F.avg(F.pow(F.greatest(F.col(value) - limit, F.lit(0.0)), F.lit(2.0))), F.lit(0.0)).alias("semivariance"))


def rolling_average(runs: DataFrame, value: str, width: int, by: Sequence[str] = ("profile",), order: Sequence[str] = ("ts", "run_id")) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0)
    return runs.withColumn("rolling", F.avg(value).over(w))


def valid_runs(runs: DataFrame, fields: Sequence[str] = ("ms", "ref_ms")) -> DataFrame:
    for f in fields:
        runs = _finite(runs, f)
    return runs


def run_set(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of slower, faster, tied runs and of runs at the goal (half the time), and the commonest hotspot."""
    r = derive(runs)
    n = F.count("*")

    def share(c):
        return F.count_if(c) / n * 100

    slower, faster, goal = F.col("ratio") > 1, F.col("ratio") < 1, F.col("speedup_pct") >= 50
    spots = {s: F.count_if(F.col("hotspot") == s) for s in ("scan", "discover", "aggregate")}
    top = F.greatest(*spots.values())
    return r.groupBy(*by).agg(
        n.alias("runs"), F.count_if(slower).alias("slower"), share(slower).alias("slower_pct"), F.count_if(faster).alias("faster"), share(faster).alias("faster_pct"),
        F.count_if(F.col("ratio") == 1).alias("ties"), F.count_if(goal).alias("goal_hits"), share(goal).alias("goal_pct"),
        *[c.alias(f"{s}_runs") for s, c in spots.items()], F.when(top == spots["scan"], "scan").when(top == spots["discover"], "discover").otherwise("aggregate").alias("hotspot"),
    )


def by_profile(runs: DataFrame) -> DataFrame:
    """run_set and the ratio series per profile, worst median first."""
    r = derive(runs)
    return run_set(runs, ["profile"]).join(series(r, "ratio", ["profile"]), "profile").orderBy(F.desc("median"), "profile")


def challengers(runs: DataFrame) -> DataFrame:
    """runs.competitors: map<string, struct<available boolean, duration_ms double>>; one row per name."""
    r = runs.select("run_id", "ts", "ms", F.explode("competitors").alias("name", "c")).select("run_id", "ts", "ms", "name", "c.*")
    ok = F.col("available") & F.col("duration_ms").isNotNull() & ~F.isnan("duration_ms")
    r = r.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_q", F.when(F.col("_ok"), ratio(F.col("ms"), F.col("duration_ms"))))
    usable = F.col("_q") > 0
    counts = r.groupBy("name").agg(
        F.count("*").alias("runs"), F.count_if("_ok").alias("available_runs"), F.count_if(usable & (F.col("_q") < 1)).alias("wins"), F.count_if(usable & (F.col("_q") > 1)).alias("losses")
    )
    mid = ranks(r.where("_ok"), "duration_ms", ["name"], {"median_ms": 50})
    out = counts.join(mid, "name", "left").join(ranks(r.where(usable), "_q", ["name"], {"median_ratio": 50, "p95_ratio": 95}), "name", "left")
    status = F.when(F.col("available_runs") > 0, "available").otherwise("unavailable")
    out = out.withColumn("status", status).withColumn("availability_pct", F.col("available_runs") / F.col("runs") * 100)
    return out.withColumn("win_pct", F.when(F.col("available_runs") > 0, F.col("wins") / F.col("available_runs") * 100).otherwise(0.0)).orderBy("status", F.coalesce("median_ms", F.lit(0.0)), "name")


def authority(runs: DataFrame, expression: str, own: str, other: str) -> DataFrame:
    """Whether a comparison counts: a case-blind query with non-ASCII text needs equal match counts."""
    strict = F.contains(F.col(expression), F.lit("(?i)")) & F.rlike(F.col(expression), F.lit(r"[^\x00-\x7F]"))
    return runs.withColumn("authority", F.when(~strict | (F.col(own) == F.col(other)), "authoritative").otherwise("timing_only"))


def outliers(runs: DataFrame) -> DataFrame:
    """Runs over Q3 + 1.5 IQR of the ratio, with threshold and severity_pct."""
    r = derive(runs)
    q = ranks(r, "ratio", [], {"_q1": 25, "_q3": 75}).select((F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))).alias("threshold"))
    over = r.crossJoin(F.broadcast(q)).where(F.col("ratio") > F.col("threshold"))
    return over.withColumn("severity_pct", F.greatest(F.lit(0.0), (F.col("ratio") - F.col("threshold")) / F.col("threshold") * 100))


def slowest(runs: DataFrame, n: int = 25) -> DataFrame:
    return derive(runs).orderBy(F.desc("ratio"), "ts", "run_id").limit(n)


def outlier_summary(runs: DataFrame) -> DataFrame:
    over = outliers(runs)
    per = over.groupBy("profile").count()
    top = per.agg(F.max_by("profile", F.struct("count", "profile")).alias("dominant_profile"), F.max("count").alias("_top"), F.sum("count").alias("_all"))
    whole = runs.agg(F.count("*").alias("runs"))
    sums = over.agg(F.count("*").alias("outliers"), F.coalesce(F.avg("severity_pct"), F.lit(0.0)).alias("severity_pct"), F.max("threshold").alias("threshold"))
    out = whole.crossJoin(sums).crossJoin(top)
    return out.select("runs", "outliers", (F.col("outliers") / F.col("runs") * 100).alias("outlier_pct"), "severity_pct", "threshold", "dominant_profile", F.coalesce(F.col("_top") / F.col("_all") * 100, F.lit(0.0)).alias("dominance_pct"))


def recent_runs(runs: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """The last n runs in time before the last ``skip`` ones."""
    latest = runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n + skip)
    if not skip:
        return latest
    return latest.withColumn("_r", F.row_number().over(W.orderBy(F.desc("ts"), F.desc("run_id")))).where(F.col("_r") > skip).drop("_r")


def self_improvement(runs: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """The last window against the one before it, or against stored medians (profile, median_ms, runs).

    One row: available, window, baseline_ms, recent_ms, improvement_pct, direction, coverage_pct.
    """
    r = derive(runs)
    if baseline is None:
        w = min(RECENT, runs.count() // 2)
        if w < LEAST_WINDOW:
            return runs.sparkSession.createDataFrame([(False, w, 0.0, 0.0, 0.0, "stable", 0.0)], "available boolean, window long, baseline_ms double, recent_ms double, improvement_pct double, direction string, coverage_pct double")
        new, old = recent_runs(r, w), recent_runs(r, w, w)
        old = ranks(old, "ms", ["profile"], {"old": 50})
    else:
        w = min(RECENT, runs.count())
        new = recent_runs(r, w)
        old = baseline.where("runs >= 3").select("profile", F.col("median_ms").alias("old"))
    mine = ranks(new, "ms", ["profile"], {"new": 50}).join(new.groupBy("profile").agg(F.count("*").alias("k")), "profile").join(old, "profile", "left")
    both = F.col("old").isNotNull()
    out = mine.agg(
        F.sum(F.when(both, F.col("k"))).alias("k"), F.sum(F.when(both, F.col("new") * F.col("k"))).alias("a"), F.sum(F.when(both, F.col("old") * F.col("k"))).alias("b"), (F.count_if(both) / F.count("*") * 100).alias("coverage_pct")
    )
    now, then = F.coalesce(F.col("a") / F.col("k"), F.lit(0.0)), F.coalesce(F.col("b") / F.col("k"), F.lit(0.0))
    better = F.when(then > 0, (then - now) / then * 100).otherwise(F.lit(0.0))
    direction = F.when(better > 0, "improved").when(better < 0, "regressed").otherwise("stable")
    return out.select(F.coalesce(F.col("k") > 0, F.lit(False)).alias("available"), F.lit(w).cast("long").alias("window"), then.alias("baseline_ms"), now.alias("recent_ms"), better.alias("improvement_pct"), direction.alias("direction"), "coverage_pct")


def performance_class(median: Column, p95: Column) -> Column:
    return F.when((median < 1) & (p95 < 1), "strong").when((median < 1) & (p95 < 1.2), "good").when(median < 1, "volatile").when(p95 >= 1, "regressed").otherwise("mixed")


def health(runs: DataFrame) -> DataFrame:
    """One row: drift of the recent median, its direction, penalties, score, grade, class."""
    r = derive(runs)
    n = recent_runs(runs, RECENT)

    def brief(some: DataFrame, raw: DataFrame, p: str) -> DataFrame:
        cv = _finite(some, "ratio").agg(F.coalesce(F.stddev_pop("ratio") / F.nullif(F.avg("ratio"), F.lit(0.0)) * 100, F.lit(0.0)).alias(f"{p}cv"))
        slow = raw.agg((F.count_if(F.col("ratio") > 1) / F.count("*") * 100).alias(f"{p}s"))
        return ranks(some, "ratio", [], {f"{p}m": 50, f"{p}95": 95}).crossJoin(cv).crossJoin(slow)

    o, late = brief(r, r, "o"), derive(n)
    t = brief(late, late, "r")
    x = o.crossJoin(t).crossJoin(outlier_summary(runs).select("outlier_pct"))

    def over(c, limit):
        return F.greatest(F.lit(0.0), F.col(c) - limit)

    x = x.withColumns({
        "drift_pct": F.when(F.col("om") > 0, (F.col("rm") - F.col("om")) / F.col("om") * 100).otherwise(0.0),
        "slower_penalty": F.col("rs") * 1.2 + F.col("os") * 0.4, "tail_penalty": over("r95", 1) * 100 + over("o95", 1) * 20,
        "variance_penalty": over("rcv", 35) * 0.2 + over("ocv", 80) * 0.05, "outlier_penalty": F.least(F.lit(20.0), F.col("outlier_pct") * 0.6),
    })
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - F.col("slower_penalty") - F.col("tail_penalty") - F.col("variance_penalty") - F.col("outlier_penalty")))
    x = x.withColumn("score", score)
    s = F.col("score")
    return x.select(
        F.col("om").alias("overall_median"), F.col("rm").alias("recent_median"), "drift_pct",
        F.when(F.col("drift_pct") >= 8, "worsening").when(F.col("drift_pct") <= -8, "improving").otherwise("stable").alias("direction"),
        "slower_penalty", "tail_penalty", "variance_penalty", "outlier_penalty", "score",
        F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F").alias("grade"),
        F.when(s >= 85, "stable").when(s >= 70, "watch").when(s >= 50, "risk").otherwise("critical").alias("health"),
        performance_class(F.col("om"), F.col("o95")).alias("performance"),
    )


def _one(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict() if row is not None else {}


def _figures(runs: DataFrame) -> dict:
    """All summaries that signals and hints read: everything of the ratio, of all and of the recent runs; of the other measures what is read."""
    last = recent_runs(runs, RECENT).select(*[c for c in runs.columns if c in FIELDS])
    last = runs.sparkSession.createDataFrame(last.toArrow(), last.schema)  # read once
    r, new = (derive(x).withColumn("delta", F.col("ms") - F.col("ref_ms")).withColumn("goal_gap", F.col("ms") - 0.5 * F.col("ref_ms")) for x in (runs, last))
    phases = ["scan_pct", "discover_pct", "aggregate_pct"]
    brief = ["mean", "median", "p95"]

    def measures(some: DataFrame, name: str, names: list[str]) -> DataFrame:
        return some.select(F.lit(name).alias("set"), F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("measure", "x"))

    both = r.select("ts", "run_id", "ratio", F.lit("o").alias("set")).unionByName(new.select("ts", "run_id", "ratio", F.lit("r").alias("set")))
    long_ = measures(r, "o", ["delta", "goal_gap", "ref_ms", *phases]).unionByName(measures(new, "r", phases)).unionByName(measures(r.where("ratio > 1"), "s", ["delta", *phases]))

    def figures(x) -> dict:
        return {k: 0 if v is None else v for k, v in x.asDict().items()}

    whole = {x.set: figures(x) for x in series(both, "ratio", ["set"], few=True).collect()}  # 2 rows
    got = {(x.set, x.measure): figures(x) for x in series(long_, "x", ["set", "measure"], stats=brief, few=True).collect()}  # 13 rows

    empty, nothing = dict.fromkeys(STATS, 0), dict.fromkeys(brief, 0)
    fig = {"o": whole.get("o", empty), "r": whole.get("r", empty), "delta": got.get(("o", "delta"), nothing), "goal": got.get(("o", "goal_gap"), nothing)}
    fig |= {"ref": got.get(("o", "ref_ms"), nothing), "debt": got.get(("s", "delta"), nothing)}
    for phase in ("scan", "discover", "aggregate"):
        for name in "ors":
            fig[f"{name}_{phase}"] = got.get((name, f"{phase}_pct"), nothing)["median"]
    fig["oset"], fig["rset"] = _one(run_set(runs)), _one(run_set(last))
    fig["out"], fig["self"] = _one(outlier_summary(runs)), _one(self_improvement(runs))
    limit = fig["o"]["p75"] + 1.5 * fig["o"]["iqr"]
    fig["recent_out"] = new.where(F.col("ratio") > F.lit(limit)).count()
    drift = (fig["r"]["median"] - fig["o"]["median"]) / fig["o"]["median"] * 100 if fig["o"]["median"] else 0.0
    fig["health"] = {"direction": "worsening" if drift >= 8 else "improving" if drift <= -8 else "stable"}
    medians = ranks(r, "ratio", ["profile"], {"m": 50}).join(r.groupBy("profile").agg(F.count("*").alias("k")), "profile")
    fig["profiles"] = _one(medians.agg(F.coalesce(F.stddev_pop("m") / F.nullif(F.avg("m"), F.lit(0.0)) * 100, F.lit(0.0)).alias("cv"), F.coalesce(F.max("m"), F.lit(0.0)).alias("worst"), F.max_by("k", F.struct("m", "profile")).alias("worst_runs")))
    fig["semi"] = (_one(semivariance_above(r, "ratio", 1.0)).get("semivariance") or 0.0) ** 0.5
    return fig


def _values(f: dict) -> dict[str, float]:
    o, r, oset, rset, out = f["o"], f["r"], f["oset"], f["rset"], f["out"]

    def part(a, b):
        return a / b if b else 0.0

    def change(k):
        return part(r[k] - o[k], o[k]) * 100

    n, m = oset.get("runs", 0), rset.get("runs", 0)
    recent_out = part(f["recent_out"], m) * 100
    spots = [oset.get(f"{s}_runs", 0) for s in ("scan", "discover", "aggregate")]
    losses, wins = oset.get("slower", 0), oset.get("faster", 0)
    return {
        "median_gap_to_goal_pct": max(0, (o["median"] - 0.5) / 0.5 * 100), "p95_gap_to_goal_pct": max(0, (o["p95"] - 0.5) / 0.5 * 100),
        "median_gap_to_parity_pct": max(0, (o["median"] - 1) * 100), "p95_gap_to_parity_pct": max(0, (o["p95"] - 1) * 100),
        "median_ms_gap_to_goal": max(0, f["goal"]["median"]), "median_ms_gap_to_parity": max(0, f["delta"]["median"]), "p95_ms_gap_to_parity": max(0, f["delta"]["p95"]),
        "tail_spread_abs": o["p95"] - o["median"], "tail_spread_pct": part(o["p95"] - o["median"], o["median"]) * 100, "ratio_iqr": o["iqr"], "ratio_p99": o["p99"],
        "ratio_mad": o["mad"], "ratio_robust_cv_pct": o["robust_cv_pct"], "ratio_skewness": o["skew"], "ratio_step_jitter_pct": part(o["step"], o["median"]) * 100,
        "recent_ratio_slope_pct_per_run": part(r["slope"], r["median"]) * 100, "recent_median_drift_pct": change("median"), "recent_p95_drift_pct": change("p95"),
        "recent_mean_drift_pct": change("mean"), "recent_cv_drift_pct": change("cv_pct"), "slower_run_drift_pts": rset.get("slower_pct", 0) - oset.get("slower_pct", 0) if n else 0.0,
        "goal_hit_drift_pts": rset.get("goal_pct", 0) - oset.get("goal_pct", 0) if n else 0.0, "recent_outlier_pct": recent_out, "outlier_drift_pts": recent_out - (out.get("outlier_pct") or 0.0),
        "outlier_severity_pct": out.get("severity_pct") or 0.0, "outlier_dominance_pct": out.get("dominance_pct") or 0.0, "hotspot_dominance_pct": part(max(spots), sum(spots)) * 100,
        "profile_dispersion_pct": f["profiles"]["cv"], "worst_profile_median_ratio": f["profiles"]["worst"], "worst_profile_goal_gap_pct": max(0, (f["profiles"]["worst"] - 0.5) / 0.5 * 100) if n else 0.0,
        "win_loss_ratio": wins / losses if losses else 999.0 if wins else 0.0, "downside_semideviation": f["semi"], "slowdown_debt_mean_ms": f["debt"]["mean"], "slowdown_debt_p95_ms": f["debt"]["p95"],
        "slowdown_debt_mean_pct_of_rg": part(f["debt"]["mean"], f["ref"]["median"]) * 100, "scan_pressure_delta_pts": f["s_scan"] - f["o_scan"], "discover_pressure_delta_pts": f["s_discover"] - f["o_discover"],
        "aggregate_pressure_delta_pts": f["s_aggregate"] - f["o_aggregate"], "recent_scan_share_drift_pts": f["r_scan"] - f["o_scan"], "self_improvement_pct": f["self"].get("improvement_pct") or 0.0,
        "self_profile_coverage_pct": f["self"].get("coverage_pct") or 0.0, "recent_ratio_range_pct": part(r["range"], r["median"]) * 100, "recent_p99_drift_pct": change("p99"),
        "recent_mad_drift_pct": change("mad"), "recent_robust_cv_drift_pct": change("robust_cv_pct"), "recent_step_jitter_drift_pct": change("step"),
    }


#: good and warn limits; most signals are better the lower they are
LIMITS = {
    "median_gap_to_goal_pct": (0, 30), "p95_gap_to_goal_pct": (0, 50), "median_gap_to_parity_pct": (0, 5), "p95_gap_to_parity_pct": (0, 10), "median_ms_gap_to_goal": (0, 25), "median_ms_gap_to_parity": (0, 10),
    "p95_ms_gap_to_parity": (0, 20), "tail_spread_abs": (0.05, 0.2), "tail_spread_pct": (10, 30), "ratio_iqr": (0.05, 0.15), "ratio_p99": (1, 1.2), "ratio_mad": (0.02, 0.08), "ratio_robust_cv_pct": (5, 15),
    "ratio_skewness": (0.5, 1.0), "ratio_step_jitter_pct": (3, 8), "recent_ratio_slope_pct_per_run": (0, 0.2), "recent_median_drift_pct": (-3, 3), "recent_p95_drift_pct": (-5, 5), "recent_mean_drift_pct": (-3, 3),
    "recent_cv_drift_pct": (-5, 5), "slower_run_drift_pts": (0, 2), "recent_outlier_pct": (1, 4), "outlier_drift_pts": (0, 1), "outlier_severity_pct": (5, 20), "outlier_dominance_pct": (35, 60),
    "hotspot_dominance_pct": (45, 70), "profile_dispersion_pct": (10, 25), "worst_profile_median_ratio": (0.75, 1), "worst_profile_goal_gap_pct": (0, 40), "downside_semideviation": (0.02, 0.08),
    "slowdown_debt_mean_ms": (5, 20), "slowdown_debt_p95_ms": (10, 40), "slowdown_debt_mean_pct_of_rg": (5, 20), "scan_pressure_delta_pts": (5, 15), "discover_pressure_delta_pts": (5, 15),
    "aggregate_pressure_delta_pts": (5, 15), "recent_scan_share_drift_pts": (0, 3), "recent_ratio_range_pct": (20, 60), "recent_p99_drift_pct": (-5, 5), "recent_mad_drift_pct": (-5, 5),
    "recent_robust_cv_drift_pct": (-5, 5), "recent_step_jitter_drift_pct": (-5, 5),
}
#: better the higher
FLOORS = {"goal_hit_drift_pts": (0, -5), "win_loss_ratio": (3, 1), "self_profile_coverage_pct": (90, 70)}


def _status(name: str, v: float) -> str:
    if name == "self_improvement_pct":
        return "good" if v > 0 else "warn" if v == 0 else "bad"
    if name in FLOORS:
        good, warn = FLOORS[name]
        return "good" if v >= good else "warn" if v >= warn else "bad"
    v = abs(v) if name == "ratio_skewness" else v
    good, warn = LIMITS[name]
    return "good" if v <= good else "warn" if v <= warn else "bad"


def signals(runs: DataFrame) -> DataFrame:
    """The 46 diagnostic signals: signal, value, status (good, warn, bad)."""
    values = _values(_figures(runs))
    rows = [(k, float(v), _status(k, v)) for k, v in values.items()]
    return runs.sparkSession.createDataFrame(rows, "signal string, value double, status string")


Rule = tuple[str, Callable[[dict, dict], bool], Callable[[dict, dict], str], int]


def _level(key: str, limit: float, below: bool = False):
    return lambda v, f: "high" if (v[key] < limit if below else v[key] > limit) else "medium"


def _over(name: str, title: str, limit: float, high: float, priority: int) -> Rule:
    return title, lambda v, f: v[name] > limit, _level(name, high), priority


def _is(x: str):
    return lambda v, f: x


def _rules() -> list[Rule]:
    def phase(name):
        return lambda v, f: max(("scan", "discover", "aggregate"), key=lambda p: f[f"o_{p}"]) == name and f["oset"].get("slower", 0) > 0

    def lead(v, f):
        return f.get("challenger") or {}

    return [
        ("A challenger is ahead", lambda v, f: (lead(v, f).get("median_ratio") or 0) > 1, lambda v, f: "high" if lead(v, f)["median_ratio"] > 1.1 else "medium", 93),
        ("Ahead of the challenger in the tail too", lambda v, f: bool(lead(v, f)) and (lead(v, f).get("p95_ratio") or 9) < 1, _is("info"), 25),
        ("Too few runs to judge", lambda v, f: f["oset"]["runs"] < 15, _is("high"), 100),
        ("More runs would steady the figures", lambda v, f: 15 <= f["oset"]["runs"] < 30, _is("info"), 30),
        ("The median run is not faster", lambda v, f: f["o"]["median"] >= 1, _is("high"), 98),
        ("The median misses the goal", lambda v, f: f["o"]["median"] > 0.5, lambda v, f: "high" if f["o"]["median"] > 0.9 else "medium", 96),
        ("Recent runs are not faster", lambda v, f: f["r"]["median"] >= 1, _is("high"), 92),
        ("The tail is slower than the reference", lambda v, f: f["o"]["p95"] > 1, _is("high"), 97),
        _over("p95_gap_to_goal_pct", "The tail misses the goal", 0, 75, 88),
        ("A wide gap between median and tail", lambda v, f: v["tail_spread_abs"] > 0.4, _level("tail_spread_abs", 1), 85),
        _over("tail_spread_pct", "The tail spreads far for its median", 35, 80, 82),
        _over("ratio_p99", "Single runs are far off", 1.1, 1.5, 80),
        ("Many runs are slower", lambda v, f: f["oset"]["slower_pct"] > 8, _is("high"), 95),
        ("Some runs are slower", lambda v, f: 1 < f["oset"]["slower_pct"] <= 8, _is("medium"), 76),
        ("Slower runs have become more common", lambda v, f: v["slower_run_drift_pts"] >= 5, _is("high"), 89),
        ("Slower runs have become rarer", lambda v, f: v["slower_run_drift_pts"] <= -2, _is("info"), 22),
        ("Ratios vary widely", lambda v, f: max(f["r"]["cv_pct"], f["o"]["cv_pct"]) > 40, lambda v, f: "high" if max(f["r"]["cv_pct"], f["o"]["cv_pct"]) > 80 else "medium", 78),
        _over("ratio_robust_cv_pct", "Ratios vary even without their extremes", 15, 25, 74),
        _over("ratio_step_jitter_pct", "Ratios jump from run to run", 8, 15, 68),
        _over("recent_step_jitter_drift_pct", "Jumps have grown lately", 10, 25, 64),
        ("There are outliers", lambda v, f: f["out"]["outliers"] > 0, lambda v, f: "high" if f["out"]["outlier_pct"] >= 5 else "medium", 83),
        _over("recent_outlier_pct", "Outliers among recent runs", 2, 5, 72),
        _over("outlier_drift_pts", "Outliers have become more common", 0.5, 2, 69),
        _over("outlier_severity_pct", "Outliers lie far out", 10, 30, 75),
        _over("outlier_dominance_pct", "One profile makes most outliers", 50, 75, 71),
        ("Slow runs spend their time scanning", phase("scan"), _is("medium"), 84),
        ("Slow runs spend their time on discovery", phase("discover"), _is("medium"), 62),
        ("Slow runs spend their time aggregating", phase("aggregate"), _is("medium"), 61),
        _over("scan_pressure_delta_pts", "Scanning weighs more in slow runs", 10, 20, 79),
        _over("discover_pressure_delta_pts", "Discovery weighs more in slow runs", 10, 20, 57),
        _over("aggregate_pressure_delta_pts", "Aggregation weighs more in slow runs", 10, 20, 56),
        _over("recent_scan_share_drift_pts", "The share of scanning is growing", 3, 8, 58),
        ("The trend is worsening", lambda v, f: f["health"]["direction"] == "worsening", _is("medium"), 73),
        _over("recent_ratio_slope_pct_per_run", "Recent ratios climb", 0.2, 1, 70),
        _over("recent_p95_drift_pct", "The recent tail has grown", 5, 20, 67),
        _over("recent_mean_drift_pct", "The recent mean has grown", 3, 10, 63),
        _over("recent_cv_drift_pct", "Recent runs vary more", 5, 20, 60),
        _over("recent_p99_drift_pct", "The recent extreme tail has grown", 5, 20, 59),
        _over("recent_mad_drift_pct", "The recent spread has grown", 5, 20, 54),
        _over("recent_robust_cv_drift_pct", "The recent relative spread has grown", 5, 20, 53),
        ("Slower than its own past", lambda v, f: f["self"]["available"] and v["self_improvement_pct"] < 0, lambda v, f: "high" if v["self_improvement_pct"] <= -5 else "medium", 87),
        ("Few profiles can be compared with the past", lambda v, f: f["self"]["available"] and v["self_profile_coverage_pct"] < 70, _is("medium"), 45),
        ("A profile has fallen behind", lambda v, f: v["worst_profile_median_ratio"] > 1, lambda v, f: "high" if f["profiles"]["worst_runs"] >= 5 else "medium", 86),
        _over("profile_dispersion_pct", "Profiles differ widely", 20, 40, 65),
        _over("worst_profile_goal_gap_pct", "The worst profile is far from the goal", 25, 100, 66),
        ("Few wins for each loss", lambda v, f: v["win_loss_ratio"] < 1.5, _level("win_loss_ratio", 1, below=True), 77),
        _over("downside_semideviation", "Losses are large when they happen", 0.05, 0.12, 55),
        _over("slowdown_debt_mean_ms", "Slow runs cost much time", 10, 40, 52),
        _over("slowdown_debt_p95_ms", "The worst slow runs cost much time", 25, 75, 51),
        _over("slowdown_debt_mean_pct_of_rg", "Slow runs cost much for the reference time", 10, 30, 49),
        _over("hotspot_dominance_pct", "One phase dominates", 70, 85, 48),
        ("The goal is missed often", lambda v, f: f["oset"]["goal_pct"] < 90, lambda v, f: "high" if f["oset"]["goal_pct"] < 50 else "medium", 90),
        ("No run reached the goal", lambda v, f: f["oset"]["goal_hits"] == 0, _is("high"), 91),
        ("The goal is reached less often lately", lambda v, f: v["goal_hit_drift_pts"] < 0, _level("goal_hit_drift_pts", -5, below=True), 47),
        ("The recent tail has shrunk", lambda v, f: f["r"]["p95"] < f["o"]["p95"], _is("info"), 28),
        ("Outliers have become rarer", lambda v, f: v["outlier_drift_pts"] <= -1, _is("info"), 26),
        ("Faster than its own past", lambda v, f: f["self"]["available"] and v["self_improvement_pct"] > 2, _is("info"), 24),
        ("Close to the goal", lambda v, f: 0 < v["median_gap_to_goal_pct"] <= 15, _is("info"), 27),
    ]


def hints(runs: DataFrame, most: int = 20) -> DataFrame:
    """Up to ``most`` hints by severity (high, medium, info), then priority."""
    f = _figures(runs)
    if "competitors" in runs.columns:
        f["challenger"] = _one(challengers(runs).where("status = 'available'").limit(1))
    v, seen = _values(f), {}
    for title, when, severity, priority in _rules():
        if f["oset"].get("runs") and when(v, f) and title not in seen:
            seen[title] = (title, severity(v, f), priority)
    rank = {"high": 0, "medium": 1, "info": 2}
    rows = sorted(seen.values(), key=lambda h: (rank[h[1]], -h[2]))[:most]
    return runs.sparkSession.createDataFrame([(k + 1, *h) for k, h in enumerate(rows)], "place int, title string, severity string, priority int")


METRICS = {
    "ms": "wall time of a run", "ref_ms": "wall time of the reference", "ratio": "ms / ref_ms", "speedup_pct": "time saved against the reference, per cent",
    "slower_pct": "share of runs with a ratio over 1", "goal_pct": "share of runs that take half the time or less", "median": "middle run (upper of two)", "p95": "order statistic at 95 per cent",
    "mad": "median distance from the median", "robust_cv_pct": "1.4826 mad / median", "skew": "population skewness", "step": "mean distance of neighbouring runs", "slope": "least-squares change per run",
    "semivariance": "mean square over a limit", "threshold": "Q3 + 1.5 IQR", "severity_pct": "overshoot of outliers", "drift_pct": "recent median against all", "score": "100 less penalties",
}


def metric_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METRICS.items()), "metric string, meaning string")


def summarize(runs: DataFrame) -> dict[str, DataFrame]:
    """Everything about a history, by name."""
    r = derive(runs)
    return {
        "overall": run_set(runs), "ratio": series(r, "ratio"), "profiles": by_profile(runs), "slowest": slowest(runs), "outliers": outlier_summary(runs), "health": health(runs),
        "self_improvement": self_improvement(runs), "signals": signals(runs), "hints": hints(runs), "metrics": metric_index(runs.sparkSession),
    }
