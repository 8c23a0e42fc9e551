"""Registered queries over the test tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.strategy import classify
from .operators import runstats as rs
from .operators import search as se
from .operators import windows as wi
from .plans.explain import explain_json
from .sources.roots import prune_roots

QUERIES, ORACLE = {}, {}

UP, LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


# --- lines ---------------------------------------------------------------------------------------------------------

_LINES = "(select {key}, rtrim(unnest(string_split({text}, chr(10))), chr(13)) s, unnest(range(1, len(string_split({text}, chr(10))) + 1)) n from {table} where {text} is not null)"


def lines_sql(table_="documents", key="doc_id", text="text"):
    return _LINES.format(table=table_, key=key, text=text)


def lit_col(v, s="s"):
    v = v.replace("'", "''")
    return f"case when contains({s}, '{v}') then strlen({s}[: strpos({s}, '{v}') - 1]) + 1 end"


def re_col(rx, s="s"):
    return f"case when {s} <> '' and regexp_matches({s}, '{rx}') then strlen(regexp_extract({s}, '^(.*?)(?:{rx})', 1)) + 1 end"


def _hits(name, query, column_sql, tables=("documents", "doc_id"), fold=False):
    table_, key = tables
    keys = key.split(", ")
    register(
        name,
        lambda spark, d: se.hits(table(spark, d, table_), query, keys, fold=fold),
        f"select {key}, n::bigint as line, c::bigint as \"column\", s as preview from (select *, {column_sql} c from {lines_sql(table_, key)}) where c is not null",
    )


def fold_sql(s="s"):
    return f"translate({s}, '{UP}', '{LO}')"


_hits("lit_hits", "lit:tion the", lit_col("tion the"))
_hits("bare_text_hits", "heed the", lit_col("heed the"))
_hits("lit_hits_ci", "lit:THAT THE", lit_col("that the", fold_sql()), fold=True)
_hits("prefix_hits", "prefix:The", "case when starts_with(s, 'The') then 1 end")
_hits("suffix_hits", "suffix:and the.", "case when ends_with(s, 'and the.') then strlen(s) - strlen('and the.') + 1 end")
_hits("regex_hits", r"re:th[aeiou]n\w+ion", re_col(r"th[aeiou]n\w+ion"))
_hits("regex_ci_hits", r"re:(?i)THAT [a-c]\w+ed", re_col(r"(?i)THAT [a-c]\w+ed"))
_hits("word_boundary_hits", r"re:\bwith\b", re_col(r"\bwith\b"), ("conversations", "conv_id, turn"))
_hits("alternates_hits", "re:loser|idiot|clown", re_col("loser|idiot|clown"))
_hits("fixed_width_hits", r"re:\d{3}-\d{4}", re_col(r"\d{3}-\d{4}"))
_hits("surrounding_words_hits", r"re:\w+\s+from\s+\w+", re_col(r"\w+\s+from\s+\w+"), ("conversations", "conv_id, turn"))
_hits("and_hits", "lit:that && lit:with && suffix:.", f"case when contains(s, 'that') and contains(s, 'with') and ends_with(s, '.') then least({lit_col('that')}, {lit_col('with')}, strlen(s)) end")
_hits("or_hits", "lit:disgusting || re:\\d{3}\\.\\d+ || prefix:Ciónes", f"least({lit_col('disgusting')}, {re_col(r'\d{3}\.\d+')}, case when starts_with(s, 'Ciónes') then 1 end)")
register(
    "pages_regex_hits",
    lambda spark, d: se.hits(table(spark, d, "pages").select("page_id", F.col("html").alias("text")), r're:href="/[A-Z]\w+"', ["page_id"]),
    f"select page_id, n::bigint as line, c::bigint as \"column\", s as preview from (select *, {re_col(r'href="/[A-Z]\w+"')} c from {lines_sql('pages', 'page_id', 'html')}) where c is not null",
)
register(
    "max_hits_topk",
    lambda spark, d: se.hits(table(spark, d, "documents"), "lit:the", ["doc_id"], max_hits=100),
    f"select doc_id, n::bigint as line, c::bigint as \"column\", s as preview from (select *, {lit_col('the')} c from {lines_sql()}) where c is not null order by doc_id, n limit 100",
)


# --- counts --------------------------------------------------------------------------------------------------------


def _count(name, query, sql, table_="documents", text="text", fold=False):
    register(name, lambda spark, d: se.count_matches(table(spark, d, table_), query, text=text, fold=fold), sql)


_count("count_occurrences", "lit:the", "select (sum(len(text) - len(replace(text, 'the', ''))) / 3)::bigint matches from documents")
_count("count_occurrences_ci", "re:(?i)the", f"select (sum(len(text) - len(replace({fold_sql('text')}, 'the', ''))) / 3)::bigint matches from documents")
_count("count_regex", "re:th[a-z]", f"select sum(len(regexp_extract_all(s, 'th[a-z]')))::bigint matches from {lines_sql()}")
_count("count_lines_wb", r"re:\bthat\b", rf"select count(*) matches from {lines_sql()} where regexp_matches(s, '\bthat\b')")
_count("count_lines_multi", "lit:that && lit:with", f"select count(*) matches from {lines_sql()} where contains(s, 'that') and contains(s, 'with')")
_count("count_lines_decomposed", r"re:\w+\s+the\s+\w+", rf"select count(*) matches from {lines_sql()} where regexp_matches(s, '\w+\s+the\s+\w+')")
_count("count_lines_prefix", "prefix:The", f"select count(*) matches from {lines_sql()} where starts_with(s, 'The')")
_count("whole_doc_count", "re:li", "select (sum(len(html) - len(replace(html, 'li', ''))) / 2)::bigint matches from pages", "pages", "html")

_M = f"(select doc_id, count(*) k from {lines_sql()} where contains(s, 'tion the') group by 1)"
register("per_doc_report", lambda spark, d: se.matching_lines(table(spark, d, "documents"), "lit:tion the"), f"select doc_id, k matches from {_M}")
register(
    "search_report",
    lambda spark, d: se.report(table(spark, d, "documents"), "lit:tion the"),
    f"""select count(*) files_discovered, count(*) files_scanned, 0::bigint files_skipped, sum(strlen(text))::bigint bytes_scanned, (select sum(k) from {_M})::bigint matches,
  (select count(*) from {_M}) files_matched, count(*) filter (not contains(text, 'tion the')) files_pruned, sum(strlen(text)) filter (not contains(text, 'tion the'))::bigint bytes_pruned,
  arg_min(doc_id, [-strlen(text), doc_id]) slowest_key, max(strlen(text)) slowest_bytes from documents""",
)
register(
    "slowest_by_bytes",
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")).orderBy(F.desc("bytes"), "doc_id").limit(5),
    "select doc_id, strlen(text) bytes from documents order by 2 desc, 1 limit 5",
)

# --- pruning -------------------------------------------------------------------------------------------------------

register("prefilter_admission", lambda spark, d: se.candidates(table(spark, d, "documents"), r"re:disgust\w+ && lit:the"), "select doc_id from documents where contains(text, 'disgust') and contains(text, 'the')")
register("candidate_semi_join", lambda spark, d: se.search_candidates(docs := table(spark, d, "documents"), se.candidates(docs, "lit:worthless"), "lit:worthless"), f"select doc_id, n::bigint as line, c::bigint as \"column\", s as preview from (select *, {lit_col('worthless')} c from {lines_sql()}) where c is not null")
_TRI = " and ".join(f"contains(text, '{t}')" for t in ("tio", "ion", "on ", "n t", " th", "the"))
register("trigram_division", lambda spark, d: se.divide(se.trigram_index(table(spark, d, "documents")), "lit:tion the"), f"select doc_id from documents where {_TRI}")
register(
    "prune_stats",
    lambda spark, d: se.prune_stats(table(spark, d, "documents"), "lit:tion the"),
    f"""select true eligible, count(*) checked, count(*) filter (not ({_TRI})) pruned, coalesce(sum(strlen(text)) filter (not ({_TRI})), 0)::bigint pruned_bytes, count(*) filter ({_TRI}) verified,
  (select count(*) from {_M}) matched, 0::bigint lost from documents""",
)
register("roots_pruned", lambda spark, d: prune_roots(spark, [("src", True), ("src/core", True), ("SRC/", True), ("docs", True), ("src2/a.txt", False), ("docs/a.md", False)]), "select * from (values ('docs', true), ('src', true), ('src2/a.txt', false)) t(key, is_directory)")

# --- windows -------------------------------------------------------------------------------------------------------

_OWN = """(select doc_id, unnest(string_split(b, chr(10))) s0, unnest(range(1, len(string_split(b, chr(10))) + 1)) n
  from (select doc_id, case when ends_with(text, chr(10)) then left(text, length(text) - 1) else text end b from documents where text <> ''))"""
register("inspect_range", lambda spark, d: wi.window(table(spark, d, "documents"), wi.bounds(range_="3:7")), f"select doc_id, n::bigint as number, rtrim(s0, chr(13)) as content from {_OWN} where n between 3 and 7")
register("inspect_skip_limit", lambda spark, d: wi.window(table(spark, d, "documents"), wi.bounds(skip=4, limit=3)), f"select doc_id, n::bigint as number, rtrim(s0, chr(13)) as content from {_OWN} where n between 5 and 7")
register(
    "inspect_total", lambda spark, d: wi.window_report(table(spark, d, "documents"), wi.bounds(total=True)),
    "select doc_id, '1:*' as label, 1::bigint as start, 0::bigint as \"end\", 0::bigint shown, true eof, (case when text = '' then 0 else len(string_split(text, chr(10))) - (ends_with(text, chr(10)))::int end)::bigint total from documents",
)
register(
    "context_lines", lambda spark, d: wi.context(table(spark, d, "documents"), "lit:disgusting", 1, 2),
    f"""select doc_id, n::bigint as line, case when m then 'match' else 'context' end as role, s as content from (
  select *, contains(s, 'disgusting') m, max(contains(s, 'disgusting')) over (partition by doc_id order by n rows between 2 preceding and 1 following) near from {lines_sql()}) where near""",
)
register("explain_plan", lambda spark, d: spark.createDataFrame([(explain_json(q),) for q in (r"lit:auth && re:token_\d+", r"re:\d+", "lit:auth || re:(?i)key")], "json string"))
register(
    "strategies", lambda spark, d: spark.createDataFrame([(p, classify(p)) for p in ("foo", "a|b", r"\bword\b", "(?i)x", r"ab\d{2}", r"\w+\s+x\s+\w+", "a+b")], "pattern string, strategy string"),
    r"select * from (values ('foo', 'regex_plain_literal'), ('a|b', 'regex_literal_alternates'), ('\bword\b', 'regex_word_boundary_literal'), ('(?i)x', 'regex_ascii_casefold_literal'), ('ab\d{2}', 'regex_fixed_width_bytes'), ('\w+\s+x\s+\w+', 'regex_decomposition_candidate_lines'), ('a+b', 'regex_full')) t(pattern, strategy)",
)

# --- run statistics over events: profile = event_type, ms = value, reference = props.k ------------------------------


def runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    part = (F.col("user_id") % 5).cast("double")
    v = F.col("value")
    return e.select(
        F.col("event_id").alias("run_id"), "ts", F.col("event_type").alias("profile"), v.alias("ms"), F.get_json_object("props", "$.k").cast("double").alias("ref_ms"),
        (v * part / 10).alias("discover_ms"), (v * (6 - part) / 10).alias("scan_ms"), (v * 0.4).alias("aggregate_ms"), v.alias("total_ms"),
        F.create_map(
            F.lit("alpha"), F.struct((F.col("event_id") % 3 != 0).alias("available"), (v * 1.25).alias("duration_ms")),
            F.lit("beta"), F.struct(F.lit(True).alias("available"), F.get_json_object("props", "$.k").cast("double").alias("duration_ms")),
        ).alias("competitors"),
    )


_R = """(select *, case when ref > 0 then ms / ref else 0 end ratio, case when ref > 0 then (ref - ms) / ref * 100 else 0 end speedup,
  case when scan >= disc and scan >= agg then 'scan' when disc >= agg then 'discover' else 'aggregate' end spot,
  case when ms > 0 then scan / ms * 100 else 0 end scan_pct from (select event_id run_id, ts, event_type profile, value ms, (props->>'$.k')::double ref,
  value * (user_id % 5) / 10 disc, value * (6 - user_id % 5) / 10 scan, value * 0.4 agg from events))"""


def rank_sql(list_, p):
    return f"list_sort({list_})[least(len({list_}) - 1, floor(len({list_}) * {p} / 100.0))::bigint + 1]"


def series_sql(value, by, src=_R):
    v = "l"
    ranks = ", ".join(f"{rank_sql(v, p)} {k}" for k, p in rs.RANKS.items())
    key = ", ".join(by)
    g = f"group by {key}" if by else ""
    pre = f"{key}, " if by else ""
    on = f"using ({key})" if by else "on true"
    part = f"partition by {key} " if by else ""
    return f"""
with r as (select * from {src}),
o as (select *, {value} x, row_number() over ({part}order by ts, run_id) i, abs({value} - lag({value}) over ({part}order by ts, run_id)) d from r),
a as (select {pre}count(*) n, min(x) "min", max(x) "max", avg(x) mean, var_pop(x) variance, stddev_pop(x) stdev, avg(d) step, regr_slope(x, i) slope, list(x) l from o {g}),
b as (select *, {ranks} from a),
c as (select *, {rank_sql('list_transform(l, lambda x: abs(x - median))', 50)} mad from b),
k as (select {pre.replace(key, ', '.join('o.' + x for x in by))}avg(((x - mean) / nullif(stdev, 0)) ** 3) skew from o join c {on} {('group by ' + ', '.join('o.' + x for x in by)) if by else ''})
select {pre}n, "min", p05, p10, p25, median, p75, p90, p95, p99, "max", round(mean, 6) mean, round(stdev, 6) stdev, round(variance, 6) variance, round("max" - "min", 6) as "range", round(p75 - p25, 6) iqr, round(mad, 6) mad,
  round(coalesce(skew, 0), 6) skew, round(coalesce(step, 0), 6) step, round(coalesce(slope, 0), 8) slope, round(case when mean <> 0 then stdev / mean * 100 else 0 end, 6) cv_pct,
  round(case when median <> 0 then 1.4826 * mad / abs(median) * 100 else 0 end, 6) robust_cv_pct from c join k {on}"""


def rounded(df: DataFrame, digits=6, **special) -> DataFrame:
    return df.withColumns({c: F.round(c, special.get(c, digits)) for c, t in df.dtypes if t == "double"})


ROUNDED = ("mean", "stdev", "variance", "range", "iqr", "mad", "skew", "step", "cv_pct", "robust_cv_pct")


def _series(spark, d, value, by):
    out = rs.series(rs.derive(runs(spark, d)), value, by)
    return out.withColumns({c: F.round(c, 6) for c in ROUNDED} | {"slope": F.round("slope", 8)})


register("series_summary", lambda spark, d: _series(spark, d, "ms", ["profile"]), series_sql("ms", ["profile"]))
register("series_ratio_all", lambda spark, d: _series(spark, d, "ratio", []), series_sql("ratio", []))
register("percentiles", lambda spark, d: rs.ranks(runs(spark, d), "ms", ["profile"], rs.RANKS), "select profile, " + ", ".join(f"{rank_sql('list(ms)', p)} {k}" for k, p in rs.RANKS.items()) + f" from {_R} group by profile")
register("semivariance", lambda spark, d: rounded(rs.semivariance_above(rs.derive(runs(spark, d)), "ratio", 1.0, ["profile"])), f"select profile, round(avg(greatest(ratio - 1, 0) ** 2), 6) semivariance from {_R} group by 1")
register(
    "rolling_average", lambda spark, d: rounded(rs.rolling_average(runs(spark, d), "ms", 5).select("run_id", "profile", "rolling")),
    f"select run_id, profile, round(avg(ms) over (partition by profile order by ts, run_id rows 4 preceding), 6) rolling from {_R}",
)
register("hotspots", lambda spark, d: rs.derive(runs(spark, d)).groupBy("profile", "hotspot").agg(F.count("*").alias("n")), f"select profile, spot hotspot, count(*) n from {_R} group by all")
register("valid_runs", lambda spark, d: rs.valid_runs(runs(spark, d)).select("run_id"), f"select run_id from {_R} where isfinite(ms) and isfinite(ref)")
_SET = """count(*) runs, count(*) filter (ratio > 1) slower, round(count(*) filter (ratio > 1) / count(*) * 100, 6) slower_pct, count(*) filter (ratio < 1) faster, round(count(*) filter (ratio < 1) / count(*) * 100, 6) faster_pct,
  count(*) filter (ratio = 1) ties, count(*) filter (speedup >= 50) goal_hits, round(count(*) filter (speedup >= 50) / count(*) * 100, 6) goal_pct, count(*) filter (spot = 'scan') scan_runs, count(*) filter (spot = 'discover') discover_runs,
  count(*) filter (spot = 'aggregate') aggregate_runs, case when scan_runs >= discover_runs and scan_runs >= aggregate_runs then 'scan' when discover_runs >= aggregate_runs then 'discover' else 'aggregate' end hotspot"""
register("run_set_summary", lambda spark, d: rounded(rs.run_set(runs(spark, d))), f"select {_SET} from {_R}")
register(
    "by_profile", lambda spark, d: rounded(rs.by_profile(runs(spark, d)).select("profile", "runs", "slower", "slower_pct", "goal_pct", "hotspot", "median", "p95")),
    f"select profile, runs, slower, slower_pct, goal_pct, hotspot, round(median, 6) median, round(p95, 6) p95 from (select profile, {_SET}, {rank_sql('list(ratio)', 50)} median, {rank_sql('list(ratio)', 95)} p95 from {_R} group by 1)",
)
_Q = f"(select {rank_sql('list(ratio)', 75)} + 1.5 * ({rank_sql('list(ratio)', 75)} - {rank_sql('list(ratio)', 25)}) t from {_R})"
register(
    "outliers", lambda spark, d: rounded(rs.outliers(runs(spark, d)).select("run_id", "profile", "ratio", "threshold", "severity_pct")),
    f"select run_id, profile, round(ratio, 6) ratio, round(t, 6) threshold, round((ratio - t) / t * 100, 6) severity_pct from {_R}, {_Q} where ratio > t",
)
register(
    "outlier_summary", lambda spark, d: rounded(rs.outlier_summary(runs(spark, d))),
    f"""with v as (select * from {_R}, {_Q} where ratio > t), p as (select profile, count(*) c from v group by 1)
select (select count(*) from events) runs, count(*) outliers, round(count(*) / (select count(*) from events) * 100, 6) outlier_pct, round(avg((ratio - t) / t * 100), 6) severity_pct, round(max(t), 6) threshold,
  (select profile from p order by c desc, profile desc limit 1) dominant_profile, round((select max(c) / sum(c) * 100 from p), 6) dominance_pct from v""",
)
register("slowdown_topk", lambda spark, d: rounded(rs.slowest(runs(spark, d)).select("run_id", "profile", "ratio")), f"select run_id, profile, round(ratio, 6) ratio from {_R} order by ratio desc, ts, run_id limit 25")
register(
    "challengers",
    lambda spark, d: rounded(rs.challengers(runs(spark, d)).select("name", "runs", "available_runs", "wins", "losses", "median_ms", "median_ratio", "p95_ratio", "status", "availability_pct", "win_pct")),
    f"""with c as (select run_id, ms, 'alpha' as name, run_id % 3 <> 0 as ok, ms * 1.25 as dur from {_R} union all select run_id, ms, 'beta', true, ref from {_R}),
q as (select *, case when ok then case when dur > 0 then ms / dur else 0 end end q from c)
select name, count(*) runs, count(*) filter (ok) available_runs, count(*) filter (q > 0 and q < 1) wins, count(*) filter (q > 1) losses, round({rank_sql('(list(dur) filter (ok))', 50)}, 6) median_ms,
  round({rank_sql('(list(q) filter (q > 0))', 50)}, 6) median_ratio, round({rank_sql('(list(q) filter (q > 0))', 95)}, 6) p95_ratio, 'available' as status,
  round(count(*) filter (ok) / count(*) * 100, 6) availability_pct, round(count(*) filter (q > 0 and q < 1) / count(*) filter (ok) * 100, 6) win_pct from q group by name""",
)
_W = f"(select *, row_number() over (order by ts desc, run_id desc) w from {_R})"
register(
    "self_improvement", lambda spark, d: rounded(rs.self_improvement(runs(spark, d))),
    f"""with n as (select profile, count(*) k, {rank_sql('list(ms)', 50)} a from {_W} where w <= 100 group by 1), o as (select profile, {rank_sql('list(ms)', 50)} b from {_W} where w between 101 and 200 group by 1),
x as (select sum(k) filter (b is not null) k, sum(a * k) filter (b is not null) a, sum(b * k) filter (b is not null) b, count(b) / count(*) * 100 cov from n left join o using (profile)), y as (select (b / k - a / k) / (b / k) * 100 i, * from x)
select true as available, 100::bigint as "window", round(b / k, 6) baseline_ms, round(a / k, 6) recent_ms, round(i, 6) improvement_pct, case when i > 0 then 'improved' when i < 0 then 'regressed' else 'stable' end as direction, round(cov, 6) coverage_pct from y""",
)
_HS = f"select {rank_sql('list(ratio)', 50)} m, {rank_sql('list(ratio)', 95)} p, stddev_pop(ratio) / avg(ratio) * 100 cv, count(*) filter (ratio > 1) / count(*) * 100 s"
register(
    "health", lambda spark, d: rounded(rs.health(runs(spark, d))),
    f"""with o as ({_HS} from {_R}), r as ({_HS} from {_W} where w <= 100), q as (select count(*) / (select count(*) from events) * 100 op from {_R}, {_Q} where ratio > t),
x as (select o.m om, r.m rm, o.p o95, (r.m - o.m) / o.m * 100 dr, r.s * 1.2 + o.s * 0.4 sp, greatest(0, r.p - 1) * 100 + greatest(0, o.p - 1) * 20 tp, greatest(0, r.cv - 35) * 0.2 + greatest(0, o.cv - 80) * 0.05 vp, least(20, op * 0.6) xp from o, r, q),
y as (select *, least(100, greatest(0, 100 - sp - tp - vp - xp)) sc from x)
select round(om, 6) overall_median, round(rm, 6) recent_median, round(dr, 6) drift_pct, case when dr >= 8 then 'worsening' when dr <= -8 then 'improving' else 'stable' end as direction, round(sp, 6) slower_penalty, round(tp, 6) tail_penalty,
  round(vp, 6) variance_penalty, round(xp, 6) outlier_penalty, round(sc, 6) score, case when sc >= 90 then 'A' when sc >= 80 then 'B' when sc >= 70 then 'C' when sc >= 60 then 'D' else 'F' end grade,
  case when sc >= 85 then 'stable' when sc >= 70 then 'watch' when sc >= 50 then 'risk' else 'critical' end health,
  case when om < 1 and o95 < 1 then 'strong' when om < 1 and o95 < 1.2 then 'good' when om < 1 then 'volatile' when o95 >= 1 then 'regressed' else 'mixed' end performance from y""",
)
register("signals", lambda spark, d: rounded(rs.signals(runs(spark, d))))
register("hints", lambda spark, d: rs.hints(runs(spark, d)))
register("metric_index", lambda spark, d: rs.metric_index(spark))
