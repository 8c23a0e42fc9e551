import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from linequarry.operators import runstats as rs


def rank(v, p):
    v = sorted(v)
    return v[min(len(v) - 1, int(p / 100 * len(v)))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(k, k, f"p{rng.randrange(3)}", rng.choice([1.0, 2.5, 4.0]) + rng.random() * (k % 7 == 0) * 9, 3.0, rng.random(), rng.random(), rng.random(), 0.0) for k in range(250)]


@pytest.fixture(scope="module")
def runs(spark, rows):
    return spark.createDataFrame(rows, "run_id long, ts long, profile string, ms double, ref_ms double, discover_ms double, scan_ms double, aggregate_ms double, total_ms double").cache()


def test_series(runs, rows):
    v = [r[3] for r in rows]
    s = rs.series(runs, "ms").first()
    assert s.n == len(v) and all(s[k] == rank(v, p) for k, p in rs.RANKS.items())
    m, sd = statistics.fmean(v), statistics.pstdev(v)
    assert math.isclose(s["mean"], m) and math.isclose(s.stdev, sd) and math.isclose(s.skew, statistics.fmean(((x - m) / sd) ** 3 for x in v))
    assert math.isclose(s.step, statistics.fmean(abs(a - b) for a, b in zip(v, v[1:]))) and s.mad == rank([abs(x - s.median) for x in v], 50)
    assert math.isclose(s.slope, statistics.linear_regression(range(len(v)), v).slope, abs_tol=1e-12)


def test_series_edges(spark):
    one = spark.createDataFrame([(1, 1, 5.0), (2, 2, float("nan")), (3, 3, None)], "run_id long, ts long, x double")
    s = rs.series(one, "x").first()
    assert (s.n, s.median, s.stdev, s.skew, s.step, s.slope) == (1, 5.0, 0.0, 0.0, 0.0, 0.0)
    assert rs.series(one.where("run_id > 5"), "x").count() == 0


def test_sets_and_outliers(runs, rows):
    q = [r[3] / 3 for r in rows]
    s = rs.run_set(runs).first()
    assert (s.slower, s.faster, s.goal_hits) == (sum(x > 1 for x in q), sum(x < 1 for x in q), sum((1 - x) * 100 >= 50 for x in q))
    t = rank(q, 75) + 1.5 * (rank(q, 75) - rank(q, 25))
    assert rs.outliers(runs).count() == sum(x > t for x in q) == rs.outlier_summary(runs).first().outliers
    assert rs.slowest(runs, 3).first().ratio == max(q)


def test_self_improvement(runs, rows):
    new, old = rows[-100:], rows[-200:-100]
    names = sorted({r[2] for r in new} & {r[2] for r in old})
    k = {p: sum(r[2] == p for r in new) for p in names}
    a = sum(rank([r[3] for r in new if r[2] == p], 50) * k[p] for p in names) / sum(k.values())
    b = sum(rank([r[3] for r in old if r[2] == p], 50) * k[p] for p in names) / sum(k.values())
    got = rs.self_improvement(runs).first()
    assert got.available and math.isclose(got.recent_ms, a) and math.isclose(got.baseline_ms, b)
    assert not rs.self_improvement(runs.limit(12)).first().available


def test_signals_and_hints(runs):
    s = {r.signal: r for r in rs.signals(runs).collect()}
    assert len(s) == 46 and {r.status for r in s.values()} <= {"good", "warn", "bad"}
    h = rs.hints(runs).collect()
    assert len(h) <= 20 and [r.place for r in h] == list(range(1, len(h) + 1)) and len({r.title for r in h}) == len(h)
    assert len(rs._rules()) == 58


def test_authority(spark):
    df = spark.createDataFrame([("re:(?i)straße", 1, 2), ("re:(?i)strasse", 1, 2), ("re:(?i)é", 3, 3)], "e string, a int, b int")
    assert [r.authority for r in rs.authority(df, "e", "a", "b").collect()] == ["timing_only", "authoritative", "authoritative"]


def test_challengers(spark):
    c = {"x": {"available": True, "duration_ms": 2.0}, "y": {"available": False, "duration_ms": None}}
    df = spark.createDataFrame([(1, 1, 1.0, c), (2, 2, 4.0, c)], "run_id int, ts int, ms double, competitors map<string, struct<available: boolean, duration_ms: double>>")
    got = {r.name: r for r in rs.challengers(df).collect()}
    assert (got["x"].wins, got["x"].losses, got["x"].median_ms, got["y"].status, got["y"].availability_pct) == (1, 1, 2.0, "unavailable", 0.0)


@pytest.fixture
def conf(spark):
    had = {}

    def put(name, value):
        had.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in had.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def most_read(spark, work):
    """The most shuffled rows that one task reads while ``work`` runs."""
    sc, name = spark.sparkContext, f"most-read-{random.random()}"
    sc.setJobGroup(name, name)
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, most = sc._jsc.sc().statusStore(), 0
    for job in sc.statusTracker().getJobIdsForGroup(name):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 1000)
            for k in range(tasks.size()):
                metrics = tasks.apply(k).taskMetrics()
                most = max(most, metrics.get().shuffleReadMetrics().recordsRead() if metrics.isDefined() else 0)
    return most


@pytest.fixture
def many(spark, conf):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    cols = {"run_id": F.col("id"), "ts": F.col("id"), "profile": F.lit("p"), "ms": F.rand(1) + 0.5, "ref_ms": F.lit(1.0), "scan_ms": F.rand(2)}
    return spark.range(40_000, numPartitions=4).select(*[c.alias(k) for k, c in cols.items()])


@pytest.mark.parametrize("by", [["profile"], []])
def test_no_task_reads_a_whole_group(spark, many, by):
    assert 5_000 < most_read(spark, lambda: rs.series(many, "ms", by).collect()) < 20_000
    assert 5_000 < most_read(spark, lambda: rs.ranks(many, "ms", by, {"m": 50}).collect()) < 20_000


def test_signals_read_no_whole_group(spark, many):
    assert most_read(spark, lambda: rs.signals(many).collect()) < 60_000


def test_hints_read_no_whole_group(spark, many):
    other = F.create_map(F.lit("x"), F.struct(F.lit(True).alias("available"), F.rand(3).alias("duration_ms")))
    assert most_read(spark, lambda: rs.hints(many.withColumn("competitors", other)).collect()) < 60_000


def test_blocks_of_a_few_rows(spark, conf):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(5)
    rows = [(k, rng.randrange(40), (f"p{min(rng.randrange(9), 3)}", 1), rng.choice([None, 1.0, -2.0, rng.gauss(0, 1e3), float("inf")])) for k in range(600)]
    rows.append((600, 1, ("alone", 1), 4.0))
    df = spark.createDataFrame(rows, "run_id long, ts long, profile struct<a: string, b: int>, x double").repartition(5)
    got = {tuple(r.profile): r for r in rs.series(df, "x", ["profile"]).collect()}
    groups = {}
    for k, ts, p, x in sorted(rows, key=lambda r: (r[1], r[0])):
        if x is not None and math.isfinite(x):
            groups.setdefault(p, []).append(x)
    assert got.keys() == groups.keys()
    for p, v in groups.items():
        s = got[p]
        assert s.n == len(v) and all(s[k] == rank(v, q) for k, q in rs.RANKS.items()) and s.mad == rank([abs(x - s.median) for x in v], 50)
        if len(v) > 1:
            assert math.isclose(s.step, statistics.fmean(abs(a - b) for a, b in zip(v, v[1:]))) and math.isclose(s.slope, statistics.linear_regression(range(len(v)), v).slope, rel_tol=1e-9)
        else:
            assert (s.step, s.slope) == (0.0, 0.0)


@pytest.mark.parametrize("few", [rs.FEW if hasattr(rs, "FEW") else 0, 2])
def test_ranks_of_many_groups(spark, monkeypatch, few):
    monkeypatch.setattr(rs, "FEW", few, raising=False)
    df = spark.range(3000).select((F.col("id") % 50).alias("g"), F.when(F.col("id") % 50 == 7, 1.5).otherwise(F.col("id").cast("double")).alias("x"))
    got = {r.g: (r.m, r.top) for r in rs.ranks(df, "x", ["g"], {"m": 50, "top": 99}).collect()}
    assert got == {g: (1.5, 1.5) if g == 7 else (float(g + 50 * 30), float(g + 50 * 59)) for g in range(50)}
