"""Named queries over the driver's tables, each with an independent SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import record_queries  # noqa: F401  registers its queries
from .functions import text as T
from .operators import dashboards as D
from .operators import metrics as M
from .plans.tpch import BRANDS, prompts, read, responses
from .registry import ORACLES, QUERIES, query  # noqa: F401

_BASE = """
lines as (select l_orderkey id, l_linenumber ord, l_partkey part, l_suppkey supp, l_extendedprice price, s_name as "domain", case l_returnflag when 'R' then 'cited' when 'A' then 'fetched' else 'mentioned' end outcome, p_brand brand, case when l_returnflag = 'N' then 0 else cast(l_quantity as bigint) end cnt
 from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey),
resp as (select o_orderkey id, o_orderdate ts, o_orderpriority platform, o_custkey prompt_id, c_name prompt, o_orderstatus status, c_mktsegment seg,
 'See ' || o_orderpriority || ': ' || ['Brand', 'BRAND', 'brand'][o_orderkey % 3 + 1] || '#' || (o_orderkey % 25) || ' and others.' answer from orders left join customer on o_custkey = c_custkey),
ment as (select id, brand, min(ord) fi, cast(sum(cnt) as bigint) cnt from lines group by all),
brands(ord, name, is_own, dom) as (values """ + ", ".join(f"({k}, '{b.name}', {str(b.is_own).lower()}, '{b.domain}')" for k, b in enumerate(BRANDS)) + ")"

_PRESENCE = _BASE + """,
src as (select id, "domain" dom, bool_or(outcome = 'cited') cited from lines group by all),
told as (select id, name, case when regexp_matches(answer, '\\b(?:Brand|BRAND)#' || substr(name, 7) || '\\b') then length(regexp_extract(answer, '^(.*?)\\b(?:Brand|BRAND)#[0-9]+\\b', 1)) end idx from resp cross join brands),
pres as (select r.id, r.ts, r.platform, r.prompt_id, b.ord, b.name, b.is_own, coalesce(m.fi, t.idx) fi, coalesce(m.cnt, 0) cnt, m.id is not null or t.idx is not null present, s.id is not null any_src, coalesce(s.cited, false) cited
 from resp r cross join brands b join told t on t.id = r.id and t.name = b.name left join ment m on m.id = r.id and m.brand = b.name left join src s on s.id = r.id and s.dom = b.dom where r.status = 'F'),
rk as (select *, case when fi is not null then row_number() over (partition by id, fi is null order by fi, ord) end rnk from pres)"""


def _metrics_sql(bucket: str | None) -> str:
    key, part = (f"{bucket} as bucket, ", "partition by bucket") if bucket else ("", "")
    return f"""with {_PRESENCE}, g as (select {key}ord brand_ord, name, is_own, count(*) total, count_if(present) responses_present, cast(sum(cnt) as bigint) mentions, sum(rnk) ranks, count(rnk) ranked, count_if(cited) citations, count_if(any_src) source_responses from rk group by all)
select {'bucket, ' if bucket else ''}brand_ord, name, is_own, total, responses_present, mentions, 100.0 * responses_present / total::double visibility, case when sum(mentions) over ({part}) > 0 then 100.0 * mentions / (sum(mentions) over ({part}))::double else 0 end share_of_voice,
 case when ranked > 0 then ranks::double / ranked end avg_position, citations, source_responses, 100.0 * source_responses / total::double source_visibility from g"""


def _tracked(spark, d):
    return M.select_tracked(responses(spark, d, "F"), profile_id="p1")


# -- campaign metrics --------------------------------------------------------
@query(_metrics_sql(None))
def brand_metrics(spark, d):
    """QRY-01, AGG-01..06, JON-01..03, WIN-01."""
    return M.brand_metrics(_tracked(spark, d), BRANDS).drop("sentiment")


@query(_metrics_sql("strftime(date_trunc('day', ts), '%Y-%m-%d')"))
def brand_metrics_daily(spark, d):
    """QRY-02, AGG-07, DAT-01."""
    return M.brand_series(_tracked(spark, d), BRANDS, "day").drop("sentiment")


@query(_metrics_sql("strftime(date_trunc('week', ts), '%Y-%m-%d')"))
def brand_metrics_weekly(spark, d):
    return M.brand_series(_tracked(spark, d), BRANDS, "week").drop("sentiment")


@query(f"""with {_BASE}, t as (select * from resp where status = 'F'), l as (select l.* from lines l join t on t.id = l.id)
select (select count(*) from t) captures, (select count(distinct id) from l where outcome <> 'mentioned') searched, (select count_if(outcome <> 'mentioned') from l) fanout, (select count_if(outcome = 'cited') from l) cited, (select count_if(outcome = 'fetched') from l) fetched, (select count(distinct "domain") from l) unique_domains""")
def overview(spark, d):
    """QRY-03, AGG-08."""
    return M.overview(_tracked(spark, d))


@query(f"""with {_PRESENCE}, own as (select * from rk where is_own), s as (select id, string_agg("domain" || ' ' || part || ' ' || outcome, ', ' order by ord, part, supp, price, "domain") sources from lines group by 1)
select prompt_id, row_number() over (partition by prompt_id order by ts desc, own.id desc) as run, own.id capture_id, platform, present mentioned, rnk as position, cited, coalesce(sources, '') sources from own left join s using (id) where prompt_id is not null""")
def prompt_performance(spark, d):
    """QRY-04: every run of every prompt, with its sources."""
    df = M.prompt_performance(_tracked(spark, d), BRANDS)
    text = F.array_join(F.transform("sources", lambda s: F.concat_ws(" ", s["domain"], s["url"], s["outcome"])), ", ")
    return df.select("prompt_id", F.col("run").cast("long").alias("run"), "capture_id", "platform", "mentioned", F.col("position").cast("long").alias("position"), "cited", text.alias("sources"))


@query(f"""with {_PRESENCE}, own as (select * from rk where ord = 0), n as (select id, count(*) n from lines group by 1)
select prompt_id, platform, runs, id as capture_id, present, rnk as rank, cited, coalesce(n, 0) n_sources from
 (select *, count(*) over (partition by prompt_id, platform) runs, row_number() over (partition by prompt_id, platform order by ts desc, own.id desc) k from own left join n using (id)) where k = 1""")
def prompt_performance_latest(spark, d):
    """WIN-04: the latest run of a prompt on a platform."""
    df = M.latest_performance(_tracked(spark, d), BRANDS).drop("captured_at")
    return df.select("prompt_id", "platform", "runs", "capture_id", "present", F.col("rank").cast("long").alias("rank"), "cited", F.col("n_sources").cast("long").alias("n_sources"))


@query(f"""with {_PRESENCE}, hit as (select distinct id from lines where part = 7)
select rk.id capture_id, strftime(any_value(ts), '%Y-%m-%d') as day, any_value(platform) platform, any_value(coalesce(c_name, '(prompt no longer tracked)')) prompt_text, bool_or(present) filter (is_own) mentioned, coalesce(string_agg(case when present then name end, ', ' order by ord), '') brands_present
from rk join hit on hit.id = rk.id left join customer on c_custkey = prompt_id and c_custkey % 3 <> 0 group by 1""")
def url_detail(spark, d):
    """QRY-05, FLT-09, JON-04, AGG-32: a third of the prompts is no longer tracked."""
    df = M.url_detail(_tracked(spark, d), "7", BRANDS, prompts(spark, d).where("prompt_id % 3 <> 0"))
    return df.select("capture_id", T.day_key(F.col("captured_at")).alias("day"), "platform", "prompt_text", "mentioned", "brands_present")


@query(f"with {_BASE} select id capture_id, platform, prompt_id from resp where status = 'F' and platform in ('1-URGENT', '2-HIGH') and seg in ('BUILDING', 'MACHINERY') and ts >= timestamp '1996-01-01' and ts <= timestamp '1998-12-31'")
def scoped_select(spark, d):
    """FLT-01..03, SET-09."""
    df = M.select_tracked(responses(spark, d), profile_id="p1", engines=("1-URGENT", "2-HIGH"), tags=("BUILDING", "MACHINERY"), since="1996-01-01", until="1998-12-31")
    return df.select("capture_id", "platform", "prompt_id")


@query(f"with {_BASE} select coalesce(status = 'F', false) tracked, count(*) n from resp group by 1")
def tracked_partition(spark, d):
    """FLT-02: both sides of the partition add up to all records."""
    a, b = M.partition_records(responses(spark, d))
    return a.agg(F.lit(True).alias("tracked"), F.count("*").alias("n")).union(b.agg(F.lit(False), F.count("*")))


@query(f"with {_BASE} select status run_id, platform, count(*) completed from resp where prompt <> '' group by all")
def completed_turns(spark, d):
    """AGG-25, FLT-04."""
    df = responses(spark, d).withColumns({"fanout": F.lit(None).cast("struct<search:array<int>,shopping:array<int>,image:array<int>>"), "answer_chars": F.lit(0)})
    df = df.withColumn("sources", F.filter("sources", lambda s: F.lit(False)))
    return M.completed(df)


@query(f"""with {_BASE}, n as (select id, count_if(outcome = 'cited') c, count_if(outcome = 'fetched') f, count(*) n from lines group by 1),
x as (select *, coalesce(n, 0) n_, coalesce(c, 0) c_, coalesce(f, 0) f_ from resp left join n using (id))
select status run_id, platform, count(*) completed from x where id % 6 = 0 and prompt <> '' or id % 6 = 1 and n_ > 0 or id % 6 = 2 and c_ > 0 or id % 6 = 3 and f_ > 0 or id % 6 = 4 and length(answer) > 0 group by all""")
def completed_signals(spark, d):
    """AGG-25, FLT-04: a sixth of the records each has only a prompt, sources, one of two fan-outs, an answer, or nothing."""
    df = responses(spark, d)
    k = F.col("capture_id") % 6
    only = lambda n, c, other: F.when(k == n, c).otherwise(other)
    none = F.array().cast("array<struct<query:string>>")
    fanout = F.struct(only(2, F.col("fanout.search"), none).alias("search"), only(3, F.col("fanout.shopping"), none).alias("shopping"), none.alias("image"))
    df = df.withColumns({"user_prompt": only(0, F.col("user_prompt"), F.lit(None)), "sources": only(1, F.col("sources"), F.filter("sources", lambda s: F.lit(False))), "fanout": fanout, "answer_chars": only(4, F.col("answer_chars"), F.lit(0))})
    return M.completed(df)


# -- dashboards --------------------------------------------------------------
def _drill_sql(where: str) -> str:
    return f"""with {_BASE} select "domain", count_if(outcome = 'cited') cited, count_if(outcome <> 'cited') not_cited, count(*) total, count(distinct prompt_id) prompts, arg_min(cast(part as varchar), row(ts, id, ord, part, supp, price)) first_url from lines join resp using (id) where {where} group by 1"""


@query(_drill_sql("true"))
def drill_domains(spark, d):
    """QRY-09, AGG-09."""
    return D.drill_domains(responses(spark, d))


@query(_drill_sql("outcome = 'cited'"))
def drill_cited(spark, d):
    return D.drill_domains(responses(spark, d), "cited")


@query(_drill_sql("outcome = 'fetched'"))
def drill_fetched(spark, d):
    return D.drill_domains(responses(spark, d), "fetched")


_LEADERS = """with {base} select cast({key} as varchar) as key, count_if(outcome = 'cited') citations, count_if(outcome = 'fetched') fetched from lines join resp using (id) where status = 'F' and outcome <> 'mentioned' group by 1 order by 2 desc, 3 desc, 1 limit 50"""


@query(_LEADERS.format(base=_BASE, key='"domain"'))
def source_leaderboard(spark, d):
    """QRY-19, AGG-10, SRT-06."""
    return D.leaderboard(_tracked(spark, d), "domain")


@query(_LEADERS.format(base=_BASE, key="part"))
def url_leaderboard(spark, d):
    return D.leaderboard(_tracked(spark, d), "url")


@query(f"""with {_BASE} select "domain", count(*) n, string_agg(distinct outcome, ', ' order by outcome) labels from lines group by 1 order by 2 desc, 1 limit 15""")
def domain_labels(spark, d):
    """QRY-18, AGG-11, SRT-05."""
    return D.domain_labels(responses(spark, d))


@query(f"""with {_BASE}, n as (select id, count(*) n, count_if(outcome = 'cited') c from lines group by 1)
select id capture_id, platform, prompt, coalesce(n, 0) sources, coalesce(c, 0) cited from resp left join n using (id) where n > 0""")
def drill_searched(spark, d):
    """QRY-06, QRY-07."""
    df = responses(spark, d).where(F.size("sources") > 0)
    return df.select("capture_id", "platform", F.col("user_prompt").alias("prompt"), F.size("sources").cast("long").alias("sources"), F.size(F.filter("sources", lambda s: s["outcome"] == "cited")).cast("long").alias("cited"))


@query(f"with {_BASE} select id capture_id, platform from resp where contains(lower(prompt), '00012') and platform = '1-URGENT' and ts >= timestamp '1996-06-01'")
def dashboard_filter(spark, d):
    """FLT-05."""
    return D.filter_records(responses(spark, d), "00012", "1-URGENT", since="1996-06-01").select("capture_id", "platform")


def _timeline(spark, d, values, **by):
    df = D.with_prompt_key(responses(spark, d), **by)
    return D.timelines(df), values(df)


def _matrix(spark, d):
    df = D.with_prompt_key(responses(spark, d))
    return D.matrix_rows(df, D.brand_values(df))


def _moved(spark, d, values):
    df = D.with_prompt_key(responses(spark, d))
    return D.moved(df, values(df)).drop("in_first", "in_last")


_KEYED = _BASE + """, keyed as (select *, trim(regexp_replace(regexp_replace(lower(prompt), '\\s+', ' ', 'g'), '[.?!,]+$', '')) prompt_key from resp where prompt <> '')"""
_POINTS = _KEYED + """, pts as (select *, row_number() over (partition by prompt_key order by ts, id) k, count(*) over (partition by prompt_key) n from keyed qualify n > 1)"""
_BRAND_MOVE = _POINTS + """, names as (select distinct prompt_key, brand from pts join ment using (id)),
mv as (select x.prompt_key, x.brand as name, cast(coalesce(sum(case when k = 1 then cnt end), 0) as bigint) as first, cast(coalesce(sum(case when k = n then cnt end), 0) as bigint) as last from names x left join (select pts.prompt_key, k, n, brand, cnt from pts join ment using (id)) y on x.prompt_key = y.prompt_key and x.brand = y.brand group by all)"""
_DOMAIN_MOVE = _POINTS + """, v as (select id, "domain" as name, count(*) v from lines group by all),
mv as (select prompt_key, name, cast(coalesce(sum(v) filter (k = 1), 0) as bigint) as first, cast(coalesce(sum(v) filter (k = n), 0) as bigint) as last from pts join v using (id) group by 1, 2)"""


@query(f"with {_BRAND_MOVE} select *, last - first as delta from mv")
def timeline_delta(spark, d):
    """QRY-13, WIN-02, WIN-03, JON-12: prompts of any key and any number of captures."""
    return _moved(spark, d, D.brand_values)


@query(f"with {_BRAND_MOVE} select prompt_key, name, case when first = 0 then 'gained' else 'lost' end change from mv where (first = 0) <> (last = 0)")
def gained_lost_brands(spark, d):
    """QRY-15, SET-01."""
    return D.gained_lost(_moved(spark, d, D.brand_values))


@query(f"with {_DOMAIN_MOVE} select *, last - first as delta from mv")
def timeline_domains(spark, d):
    """QRY-14, AGG-16."""
    return _moved(spark, d, D.domain_values)


@query(f"""with {_POINTS}, v as (select prompt_key, "domain" as name, k as ordinal, count(*) n, bool_or(outcome = 'cited') c from pts join lines using (id) group by all) select prompt_key, name, ordinal, n as value, n || case when c then ' (c)' else '' end as label from v""")
def timeline_domain_cells(spark, d):
    """QRY-14, AGG-16: how often each capture of a prompt has a domain; "(c)" marks one that was cited."""
    df = D.with_prompt_key(responses(spark, d))
    return D.timeline_cells(df, D.domain_values(df)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"""with {_POINTS}, b as (select prompt_key, brand x, bool_or(k = 1) f, bool_or(k = n) l from pts join ment using (id) group by all), d as (select prompt_key, "domain" x, bool_or(k = 1) f, bool_or(k = n) l from pts join lines using (id) group by all),
bs as (select prompt_key, count_if(l and not f) g, count_if(f and not l) t from b group by 1), ds as (select prompt_key, count_if(l and not f) g, count_if(f and not l) t, count_if(l) n from d group by 1)
select p.prompt_key, p.n as captures, coalesce(bs.g, 0) brands_gained, coalesce(bs.t, 0) brands_lost, coalesce(ds.g, 0) domains_gained, coalesce(ds.t, 0) domains_lost, coalesce(ds.n, 0) domains_now from (select distinct prompt_key, n from pts) p left join bs using (prompt_key) left join ds using (prompt_key)""")
def timeline_headline(spark, d):
    """QRY-15: what changed from the first to the latest capture of each prompt, in numbers."""
    return D.timeline_headline(D.with_prompt_key(responses(spark, d)))


@query(f"with {_DOMAIN_MOVE} select *, last - first as delta from mv order by abs(last - first) desc, last desc, prompt_key, name limit 60")
def most_moved_domains(spark, d):
    """SRT-08: the 60 that moved most."""
    return D.most_moved(_moved(spark, d, D.domain_values), 60)


@query(f"""with {_POINTS.replace("where prompt <> ''", "where prompt <> '' and platform = '1-URGENT'")} select prompt_key, id capture_id, k as ordinal, n as points from pts""")
def timeline_of_platform(spark, d):
    """FLT-08: the captures of one platform only."""
    points, _ = _timeline(spark, d, D.capture_brands, platform="1-URGENT")
    return points.select("prompt_key", "capture_id", F.col("ordinal").cast("long").alias("ordinal"), "points")


@query(f"""with {_POINTS}, names as (select distinct prompt_key, brand from pts join ment using (id)),
cells as (select p.prompt_key, x.brand, p.k, p.n, coalesce(m.cnt, 0) cnt from pts p join names x on p.prompt_key = x.prompt_key left join ment m on m.id = p.id and m.brand = x.brand)
select prompt_key, brand as name, k as ordinal, n as points, cast(cnt as bigint) as value, cast(sum(case when k = n then cnt else 0 end) over w - sum(case when k = 1 then cnt else 0 end) over w as bigint) as delta from cells window w as (partition by prompt_key, brand)""")
def timeline_matrix(spark, d):
    """QRY-13, SNK-11: the matrix in long form, for prompts of any number of captures."""
    return _matrix(spark, d)


@query(f"with {_KEYED} select prompt_key, count(*) captures, arg_min(prompt, row(ts, id)) as label from keyed group by 1 having count(*) > 1")
def repeat_prompts(spark, d):
    """QRY-16, AGG-31, STR-03, SRT-07."""
    return D.repeat_prompts(D.with_prompt_key(responses(spark, d)))


@query(f"""with {_BASE}, per as (select "domain", count_if(outcome = 'cited') c, count_if(outcome <> 'cited') f from lines group by 1)
select (select count(*) from resp) captures, (select count(distinct lower(prompt)) from resp) unique_prompts, (select count(distinct id) from lines where outcome <> 'mentioned') searched, (select count(*) from lines) sources, (select strftime(min(ts), '%Y-%m-%d') from resp) first_day, (select strftime(max(ts), '%Y-%m-%d') from resp) last_day,
 (select "domain" from per order by c desc, 1 limit 1) top_cited, (select "domain" from per order by f desc, 1 limit 1) top_not_cited""")
def session_summary(spark, d):
    """QRY-20, AGG-12."""
    df = D.session_summary(responses(spark, d))
    return df.withColumn("first_day", T.day_key(F.col("first_at"))).withColumn("last_day", T.day_key(F.col("last_at"))).drop("first_at", "last_at")


@query(f"""with {_BASE}, n as (select id, count(*) n, count_if(outcome = 'cited') c from lines group by 1)
select lower(prompt) as key, count(*) runs, arg_min(prompt, row(ts, id)) as prompt, cast(coalesce(sum(c), 0) as bigint) cited, cast(coalesce(sum(n), 0) as bigint) sources, coalesce(sum(c), 0)::double / count(*) avg_cited, coalesce(sum(n), 0)::double / count(*) avg_sources from resp left join n using (id) group by 1""")
def prompt_frequency(spark, d):
    """AGG-13, STR-04."""
    return D.prompt_frequency(responses(spark, d))


@query(f"""with {_BASE}, n as (select count(*) total, count_if(outcome = 'cited') cited, count(distinct "domain") unique_domains, count(distinct case when outcome <> 'mentioned' then id end) s from lines), r as (select count(*) captures, epoch(max(ts))::bigint - epoch(min(ts))::bigint t from resp)
select captures, cited, total - cited as fetched, unique_domains, round(cited / captures::double, 1) avg_cited, round((total - cited) / captures::double, 1) avg_fetched, round(total / captures::double, 1) avg_sources, round(100.0::double * s / captures, 1) search_rate, printf('%d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) duration from n, r""")
def session_details(spark, d):
    """QRY-20, AGG-12: averages, search rate and duration of the summary sheet."""
    return D.session_details(responses(spark, d))


@query(f"""with {_BASE}, per as (select "domain", count_if(outcome = 'cited') cited, count(*) total from lines group by 1)
select *, 100.0 * cited / (sum(cited) over ())::double cited_share, 100.0 * total / (sum(total) over ())::double total_share, row_number() over (order by cited desc, total desc, "domain") as rank from per""")
def source_analysis(spark, d):
    """QRY-22, AGG-14, WIN-06, WIN-07."""
    return D.source_analysis(responses(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {_BASE}, g as (select id, count_if(outcome = 'cited') n_cited, count(*) n_sources, coalesce(string_agg(distinct case when outcome = 'cited' then "domain" end, '; ' order by case when outcome = 'cited' then "domain" end), '') cited_domains from lines group by 1)
select id capture_id, platform, prompt user_prompt, coalesce(n_cited, 0) n_cited, coalesce(n_sources, 0) n_sources, coalesce(cited_domains, '') cited_domains from resp left join g using (id)""")
def audit_log(spark, d):
    """QRY-21, SNK-04."""
    df = D.audit_log(responses(spark, d))
    return df.withColumn("n_cited", F.col("n_cited").cast("long")).withColumn("n_sources", F.col("n_sources").cast("long"))


@query(f"""with {_BASE}, o as (select *, row_number() over (partition by id order by ord, part, supp, price, "domain", outcome, brand, cnt) k from lines),
g as (select id, string_agg(case when outcome = 'cited' then "domain" end, '; ' order by k) c, count_if(outcome = 'cited') cn, string_agg(case when outcome = 'fetched' then "domain" end, '; ' order by k) f, count_if(outcome = 'fetched') fn, count(*) n from o group by 1)
select resp.id capture_id, row_number() over (order by ts, resp.id) as "#", strftime(ts, '%d-%b-%Y') as "Date", strftime(ts, '%H:%M:%S') as "Time", platform as "Platform", coalesce(prompt, '') as "User Prompt", case when coalesce(cn, 0) + coalesce(fn, 0) > 0 then 'Yes' else 'No' end as "Search Used",
 coalesce(c, '') as "Cited Sources", coalesce(cn, 0) as "Cited Count", coalesce(f, '') as "Fetched Sources", coalesce(fn, 0) as "Fetched Count", coalesce(n, 0) as "Total Sources", concat_ws(' | ', replace(c, '; ', ' | '), replace(f, '; ', ' | ')) as "Fan-Out Query" from resp left join g on g.id = resp.id""")
def audit_sheet(spark, d):
    """QRY-21, SNK-04: the log of all captures with its twelve columns."""
    df = D.audit_sheet(responses(spark, d))
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for c in ("Cited Count", "Fetched Count", "Total Sources")})


@query(f"""with {_BASE} select id capture_id, "domain", outcome, cast(part as varchar) url from lines""")
def domain_data(spark, d):
    """QRY-23, QRY-24: a row an appearance."""
    return D.source_rows(responses(spark, d)).select("capture_id", "domain", "outcome", "url")


@query(f"with {_BASE} select id capture_id, brand, cnt as count, case when cnt > 0 then 'Named' else 'Shown' end status from ment")
def workbook_mentions(spark, d):
    """QRY-26."""
    return D.mention_rows(responses(spark, d))


@query(f"""with {_BASE}, g as (select id, count(*) n, count(distinct "domain") u, count(distinct part) p, count_if(outcome = 'cited') c from lines group by 1)
select id capture_id, coalesce(u, 0) unique_domains, coalesce(p, 0) unique_urls, coalesce(100.0 * c / n::double, 0.0) cited_ratio, coalesce(100.0 * u / n::double, 0.0) diversity from resp left join g using (id)""")
def capture_stats(spark, d):
    """QRY-31, AGG-17."""
    df = D.global_stats(responses(spark, d))
    return df.withColumn("unique_domains", F.col("unique_domains").cast("long")).withColumn("unique_urls", F.col("unique_urls").cast("long"))


@query(f"with {_BASE} select outcome, count(*) n from lines group by 1 union all select 'TOTAL', count(*) from lines")
def summary_by_type(spark, d):
    """AGG-18."""
    return D.summary_by_type(responses(spark, d))


@query(f"""with {_BASE} select id capture_id, row_number() over (partition by id order by case outcome when 'cited' then 0 when 'fetched' then 1 else 2 end, ord, part, supp, price) as position, "domain", outcome, cast(part as varchar) url from lines""")
def source_list(spark, d):
    """QRY-35, SRT-09."""
    return D.source_list(responses(spark, d)).withColumn("position", F.col("position").cast("long"))


@query("""with words as (select unnest(regexp_split_to_array(lower(text), '\\s+')) term from conversations where role = 'user') select term, count(*) n from words where length(term) > 2 group by 1 order by 2 desc, 1 limit 50""")
def term_counts(spark, d):
    """AGG-28."""
    return D.search_terms(read(spark, d, "conversations").where("role = 'user'"), "text")


@query("""select case p_brand when 'Brand#1' then 'First' when 'Brand#2' then 'Second' else p_brand end brand, cast(sum(p_size) as bigint) as count from part group by 1""")
def alias_rollup(spark, d):
    """AGG-20, AGG-21."""
    aliases = spark.sql("select * from values ('brand 1', 'First'), ('BRAND#2', 'Second') t(alias, canonical)")
    return D.alias_rollup(read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("count")), aliases)


# -- text and URL functions ----------------------------------------------------
@query("""select page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@\\s]*@)?([^/?#:@\\s]+)', 1), '^www\\.', '') as "domain" from pages""")
def domain_of_url(spark, d):
    """URL-02, URL-03."""
    return read(spark, d, "pages").select("page_id", T.domain_of_url(F.col("url")).alias("domain"))


@query("""select page_id, regexp_replace(regexp_replace(url, '([?&])utm_(?:source|medium|campaign)=[^&#]*', '\\1', 'g'), '[?&]+(#|$)', '\\1') clean from pages""")
def clean_url(spark, d):
    """URL-05."""
    return read(spark, d, "pages").select("page_id", T.clean_url(F.col("url")).alias("clean"))


@query("""with h as (select page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1) h from pages), s as (select page_id, string_split(h, '.') a from h) select page_id, upper(a[-2][1]) || a[-2][2:] brand from s""")
def brand_from_domain(spark, d):
    """URL-06."""
    return read(spark, d, "pages").select("page_id", T.brand_from_domain(T.domain_of_url(F.col("url"))).alias("brand"))


@query("""with h as (select page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1) h from pages) select page_id, h = 'example.org' or ends_with(h, '.example.org') as own from h""")
def domain_match(spark, d):
    """URL-04, JON-03."""
    return read(spark, d, "pages").select("page_id", T.domain_matches(T.domain_of_url(F.col("url")), F.lit("example.org")).alias("own"))


@query("select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) norm, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') compressed from part")
def norm_name(spark, d):
    """STR-01, STR-05."""
    return read(spark, d, "part").select("p_partkey", T.norm_name(F.col("p_name")).alias("norm"), T.compressed(F.col("p_brand")).alias("compressed"))


@query("""select conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w = 'the')) mentions from conversations""")
def mention_count(spark, d):
    """STR-12."""
    return read(spark, d, "conversations").select("conv_id", "turn", T.mention_count(F.col("text"), "the").alias("mentions"))


@query("""with m as (select conv_id, turn, regexp_extract(text, '(?s)^(.*?)\\b[Tt][Hh][Ee]\\b', 1) pre, regexp_matches(text, '\\b[Tt][Hh][Ee]\\b') hit from conversations) select conv_id, turn, case when hit then length(pre) end idx from m""")
def mention_first_index(spark, d):
    """STR-11."""
    return read(spark, d, "conversations").select("conv_id", "turn", T.first_index(F.col("text"), "the").alias("idx"))


@query("""select doc_id, '"' || replace(case when regexp_matches(text, '^[=+\\-@\\t\\r]') then '''' || text else text end, '"', '""') || '"' cell from documents""")
def csv_escape(spark, d):
    """SNK-03: texts of any length."""
    return read(spark, d, "documents").select("doc_id", T.csv_cell(F.col("text")).alias("cell"))


@query("""with t as (select p_partkey, list_transform(string_split(trim(replace('| ' || p_name || ' | ' || p_brand || ' \\| ' || p_type || ' |', '\\|', chr(1)), '|'), '|'), lambda c: trim(replace(c, chr(1), '|'))) a from part) select p_partkey, array_to_string(a, ';') cells from t""")
def markdown_tables(spark, d):
    """TXT-04: an escaped pipe does not split a row."""
    line = F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit(" \\| "), "p_type", F.lit(" |"))
    cells = T.table_cells(line)
    return read(spark, d, "part").select("p_partkey", F.array_join(cells, ";").alias("cells"))


@query("select conv_id, turn, case when trim(text) = '' then 0 else len(regexp_split_to_array(trim(text), '\\s+')) end words from conversations")
def word_counts(spark, d):
    """TXT-23."""
    return read(spark, d, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).cast("long").alias("words"))


# -- stateful and lifecycle operators -----------------------------------------
@query("select event_type, user_id, event_id from events qualify row_number() over (partition by event_type, user_id order by ts, event_id) = 1")
def dedupe_first_wins(spark, d):
    """WIN-08."""
    return D.first_wins(read(spark, d, "events"), ["event_type", "user_id"], [F.col("ts"), F.col("event_id")]).select("event_type", "user_id", "event_id")


@query("""with o as (select c_custkey k, 0 v, c_acctbal b, 0 n from customer), x as (select o_custkey k, o_orderkey v, o_totalprice b, 1 n from orders), u as (select * from o union all select * from x)
select k, v, b from u qualify row_number() over (partition by k order by v desc, n desc) = 1""")
def upsert_latest(spark, d):
    """SNK-01, STM-01."""
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("v"), F.col("c_acctbal").alias("b"))
    return D.latest_wins(old, read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("b")), "k", "v")


@query("""with x as (select p_partkey, lower(p_name) k from part where p_partkey % 2 = 1), old as (select distinct lower(p_name) k from part where p_partkey % 2 = 0)
select p_partkey, case when k in (select k from old) or row_number() over (partition by k order by p_partkey) > 1 then 'duplicate' else 'added' end as status from x""")
def bulk_add_dupes(spark, d):
    """JON-07, DML-04: parts of even keys are the store, all others are new."""
    from .store import bulk_add

    part = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"))
    return bulk_add(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"), "p_partkey").select("p_partkey", "status")


@query("select event_id from events order by ts desc, event_id desc limit 300")
def retention_keep(spark, d):
    """STM-10, SRT-10."""
    return D.retention(read(spark, d, "events"), 300, "ts", "event_id").select("event_id")


@query("""with g as (select user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6 gap, ts from events)
select user_id, event_id, round(avg(gap) over (partition by user_id order by ts, event_id rows between 9 preceding and current row), 3) eta from g""")
def rolling_eta(spark, d):
    """WIN-05."""
    return D.rolling_eta(read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", F.round("eta", 3).alias("eta"))


@query("select user_id, string_agg(event_type || '=' || n, ';' order by event_type) reasons, cast(sum(n) as bigint) failed from (select user_id, event_type, count(*) n from events group by all) group by 1")
def reason_histogram(spark, d):
    """AGG-26."""
    from .store import reason_histogram as f

    df = f(read(spark, d, "events"), "user_id", "event_type")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return df.select("user_id", text.alias("reasons"), "failed")


@query("""select conv_id, turn, length(text) prompt_chars, next_len answer_chars from (select *, lead(role) over w nr, length(lead(text) over w) next_len from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant'""")
def prompt_answer_pairs(spark, d):
    """JSN-05: the last user message before an answer."""
    df = D.prompt_answer_pairs(read(spark, d, "conversations"))
    return df.select("conv_id", "turn", F.length("prompt").cast("long").alias("prompt_chars"), F.length("answer").cast("long").alias("answer_chars"))


@query("select distinct c_mktsegment tag from customer")
def all_tags(spark, d):
    """AGG-27."""
    from .store import all_tags as f

    return f(read(spark, d, "customer").select(F.array("c_mktsegment").alias("tags")))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'HOUSEHOLD' else c_mktsegment || case when c_mktsegment <> 'HOUSEHOLD' then ',HOUSEHOLD' else '' end end tags from customer")
def tag_rename(spark, d):
    """DML-05: renaming onto a tag that is there leaves one of it."""
    from .store import rename_tag

    df = read(spark, d, "customer").select("c_custkey", F.array("c_mktsegment", F.lit("HOUSEHOLD")).alias("tags"))
    return rename_tag(df, "BUILDING", "HOUSEHOLD").select("c_custkey", F.array_join("tags", ",").alias("tags"))


@query("""with c as (select user_id, count_if(event_type <> 'error') done, count(*) n, epoch_ms(max(ts)) - epoch_ms(min(ts)) ms from events group by 1)
select user_id, greatest(10, least(done, n)) as position, case when greatest(10, least(done, n)) >= n then 'done' when ms > 90000 then 'failed' else 'running' end status from c""")
def run_reconcile(spark, d):
    """AGG-25, STM-07: the larger of the snapshot and the true count."""
    from .streaming.ingest import reconcile

    ms = lambda f: F.unix_millis(f("ts").cast("timestamp"))
    df = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("done"), F.count("*").alias("n"), (ms(F.max) - ms(F.min)).alias("ms"))
    at, status = reconcile(F.lit(10).cast("long"), F.col("done"), F.col("n"), F.col("ms"))
    return df.select("user_id", at.alias("position"), status.alias("status"))


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) // 1000 t, row_number() over (partition by user_id order by ts, event_id) k from events),
f as (select user_id, event_id, t, k, t as last, true as ok from e where k = 1 union all
 select e.user_id, e.event_id, e.t, e.k, case when e.t - f.last >= 7200000 then e.t else f.last end, e.t - f.last >= 7200000 from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select user_id, event_id from f where ok""")
def debounced(spark, d):
    """STM-04: compared with the last one that counted, not the last one; in whole milliseconds that have passed."""
    return D.debounced(read(spark, d, "events"), "user_id", "ts", "event_id", 7_200_000)


@query("select user_id, event_id, ts_gap > 3600 as timed_out from (select user_id, event_id, (epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6 ts_gap from events window w as (partition by user_id order by ts, event_id)) where ts_gap is not null")
def watchdog(spark, d):
    """STM-05: silence after a turn beyond the limit."""
    from .streaming.ingest import silences

    return silences(read(spark, d, "events"), "user_id", "ts", "event_id", 3_600_000).select("user_id", "event_id", "timed_out")


# -- further dashboard and lifecycle queries ----------------------------------
@query(f"with {_BASE}, n as (select * from resp order by ts desc, id desc limit 100) select strftime(ts, '%Y-%m-%d') as day, lower(prompt) as key, count(*) captures, string_agg(distinct platform, ', ' order by platform) platforms from n group by all")
def saved_clusters(spark, d):
    """QRY-17."""
    return D.saved_clusters(responses(spark, d))


@query(f"with {_BASE}, n as (select * from resp order by ts desc, id desc limit 100) select strftime(ts + interval 330 minutes, '%Y-%m-%d') as day, lower(prompt) as key, platform, count(*) captures, arg_min(id, row(ts, id)) first_id, arg_max(id, row(ts, id)) last_id from n group by all")
def cluster_platforms(spark, d):
    """QRY-17: the newest captures by the day of a time zone and prompt, and by platform within that."""
    return D.cluster_platforms(responses(spark, d), zone="Asia/Kolkata")


@query("""select user_id id, count(*) captured, strftime(min(ts), '%Y-%m-%d') as day, epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint as "seconds" from events group by 1 order by min(ts) desc, 1 limit 10""")
def run_history(spark, d):
    """QRY-37, SRT-10, DAT-05."""
    ts = F.col("ts").cast("timestamp")
    runs = read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("captured"), F.min(ts).alias("started_at"), F.max(ts).alias("finished_at"))
    return D.run_history(runs).select("id", "captured", T.day_key(F.col("started_at")).alias("day"), "seconds")


@query(f"with {_BASE} select id capture_id from resp order by exists (select 1 from lines where lines.id = resp.id) desc, ts desc, id desc limit 1")
def default_record(spark, d):
    """FLT-13."""
    return D.default_record(responses(spark, d), F.size("sources") > 0).select("capture_id")


@query("select p_type category, string_agg(distinct p_name, '; ' order by p_name) texts from part group by 1")
def entities_by_category(spark, d):
    """QRY-36, AGG-19."""
    df = D.entities_by_category(read(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("text")))
    return df.select("category", F.array_join("texts", "; ").alias("texts"))


@query("select count(*) * 2 submissions, count(*) * 2 > 60 warn from customer")
def run_volume(spark, d):
    """QRY-40, JON-14, FLT-14."""
    return D.run_volume(read(spark, d, "customer"), sum(M.ENGINES.values()))


@query("select c_custkey, max(o_orderdate) is null or date_trunc('day', max(o_orderdate)) <> timestamp '2001-07-30' due from customer left join orders on o_custkey = c_custkey group by 1")
def due_prompts(spark, d):
    """DAT-02, JON-05: prompts without a run stay, and are due."""
    last = read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp").alias("last"))
    df = read(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return df.select("c_custkey", T.run_due(F.col("last"), F.lit("2001-07-30").cast("timestamp")).alias("due"))


@query("select event_type, cast(props ->> '$.k' as bigint) % 10 as kind, count(*) n from events group by all")
def debug_counts(spark, d):
    """AGG-29, JSN-04: a path of a JSON bag."""
    k = T.json_path(F.col("props"), "$.k", "bigint")
    return read(spark, d, "events").groupBy("event_type", (k % 10).alias("kind")).agg(F.count("*").alias("n"))


@query("select user_id, arg_min(event_type, row(ts, event_id)) as first, arg_max(event_type, row(ts, event_id)) as last from events group by 1")
def first_last_of(spark, d):
    """AGG-34."""
    return D.first_last(read(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("select (select count(*) from orders) raw, (select count(distinct l_orderkey) from lineitem) derived")
def store_stats(spark, d):
    """AGG-30, SRC-13."""
    return D.store_stats(raw=read(spark, d, "orders"), derived=read(spark, d, "lineitem").select("l_orderkey").distinct())


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def unfootnoted(spark, d):
    """SET-04: what is in one set only."""
    return D.only_in(read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("select conv_id, turn, trim(regexp_replace(text[greatest(strpos(text, 'a') - 110, 1):strpos(text, 'a') + 109], '\\s+', ' ', 'g')) passage from conversations where strpos(text, 'a') > 0")
def passages(spark, d):
    """STR-13: 110 characters around a place, white space collapsed."""
    df = read(spark, d, "conversations").withColumn("i", (F.instr("text", "a") - 1).cast("long")).where("i >= 0")
    return df.select("conv_id", "turn", T.passage(F.col("text"), F.col("i")).alias("passage"))


@query("select p_partkey, regexp_replace(p_brand || '.*', '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') escaped, list_aggregate(list_transform(string_split(p_type, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') title from part")
def name_forms(spark, d):
    """STR-06, STR-07."""
    return read(spark, d, "part").select("p_partkey", T.regex_escape(F.concat("p_brand", F.lit(".*"))).alias("escaped"), T.title_case(F.col("p_type")).alias("title"))


@query(f"""with {_BASE} select id capture_id, 'search' bucket, "domain" query from lines where outcome = 'cited' union all select id, 'shopping', "domain" from lines where outcome = 'fetched'""")
def fanout_rows(spark, d):
    """QRY-08, QRY-25, SET-03."""
    return D.fanout_rows(responses(spark, d))


# -- small forms and filters -----------------------------------------------------
@query("select page_id, coalesce(regexp_matches(url, '(?i)^https?://'), false) as http from pages")
def http_urls(spark, d):
    """URL-01."""
    return read(spark, d, "pages").select("page_id", T.is_http(F.col("url")).alias("http"))


@query("""select conv_id, turn, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') html from conversations""")
def escaped_html(spark, d):
    """TXT-21."""
    return read(spark, d, "conversations").select("conv_id", "turn", T.html_escape(F.col("text")).alias("html"))


@query("""with x as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^\\s{0,3}(?:#{1,6}|[-*+>]|\\d+[.)])\\s+', '', 'g'), '(?m)^\\s*(?:[-*_]\\s*){3,}$', ' ', 'g'), '[*_`~|]+', '', 'g') t from pages) select page_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) snippet from x""")
def plain_snippets(spark, d):
    """TXT-22."""
    return read(spark, d, "pages").select("page_id", T.plain_snippet(F.col("html")).alias("snippet"))


@query("""with x as (select doc_id, doc_id % 3 as form, split_part(text, chr(10), 1) line from documents),
l as (select doc_id, regexp_replace(case form when 0 then line when 1 then 'Overall ' || line[:30] else line[:20] || ' ' || repeat('-', doc_id % 6) end, '^\\s+|\\s+$', '', 'g') s from x)
select doc_id, coalesce(length(s) < 3 or length(s) > 60 or regexp_full_match(s, '[\\s—–|:.-]+') or contains(s, '----') or contains(s, '||') or regexp_matches(lower(s), '^(you can buy|right now|approx\\.?|approximately|overall|today|in [0-9]{4})\\b'), true) noise from l""")
def noise_labels(spark, d):
    """STR-10: first lines of documents, as they are, as a heading of a list article, and with the rule of a table."""
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    form = F.when(F.col("doc_id") % 3 == 0, line).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Overall "), F.substring(line, 1, 30))).otherwise(F.concat(F.substring(line, 1, 20), F.lit(" "), F.repeat(F.lit("-"), (F.col("doc_id") % 6).cast("int"))))
    return read(spark, d, "documents").select("doc_id", T.is_noise_label(form).alias("noise"))


@query("with s as (select user_id, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 s from events group by 1) select user_id, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) took from s")
def run_durations(spark, d):
    """DAT-05."""
    at = lambda f: F.unix_seconds(f("ts").cast("timestamp"))
    s = read(spark, d, "events").groupBy("user_id").agg((at(F.max) - at(F.min)).alias("s"))
    return s.select("user_id", T.duration_hms(F.col("s")).alias("took"))


@query("select event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as at from events")
def unix_times(spark, d):
    """DAT-06: events whose time came in seconds or in milliseconds."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    mixed = F.when(F.col("event_id") % 2 == 0, t).otherwise(t * 1000)
    return read(spark, d, "events").select("event_id", F.date_format(T.seconds_or_millis(mixed), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("select c_custkey id, c_name text from customer where contains(lower(c_name), '0001') and c_mktsegment in ('BUILDING', 'MACHINERY')")
def filtered_prompts(spark, d):
    """FLT-06."""
    from .store import filter_prompts

    df = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.array("c_mktsegment").alias("tags"))
    return filter_prompts(df, "0001", tags=("BUILDING", "MACHINERY")).select("id", "text")


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'BUILDING' else c_mktsegment || ',BUILDING' end tags from customer")
def tag_union(spark, d):
    """SET-06."""
    from .store import add_tag

    return add_tag(read(spark, d, "customer").select("c_custkey", F.array("c_mktsegment").alias("tags")), " BUILDING ").select("c_custkey", F.array_join("tags", ",").alias("tags"))


@query(f"""with {_BASE} select id capture_id, row_number() over (partition by id order by ord, part, supp, price) as position, "domain", outcome, cast(part as varchar) url from lines where outcome = 'fetched'""")
def source_list_fetched(spark, d):
    """FLT-07."""
    return D.source_list(responses(spark, d), "fetched").withColumn("position", F.col("position").cast("long"))


@query("select event_id, event_type from events order by ts desc, event_id desc limit 120")
def debug_log(spark, d):
    """STM-12: the newest 120 of the 200 that are kept."""
    return D.ring(read(spark, d, "events"), "ts", "event_id").select("event_id", "event_type")


@query("""select '"' || n_nationkey || '","' || n_name || '","' || n_regionkey || '"' as value from nation""")
def csv_rows(spark, d):
    """SNK-10, SNK-12."""
    from .sources.exports import csv_lines

    return csv_lines(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("""select '"' || conv_id || '","' || turn || '","' || replace(case when regexp_matches(text, '^[=+\\-@\\t\\r]') then '''' || text else text end, '"', '""') || '"' as value from conversations""")
def csv_rows_all(spark, d):
    """SNK-12: whole messages as lines of cells."""
    from .sources.exports import csv_lines

    return csv_lines(read(spark, d, "conversations").select("conv_id", "turn", "text"))


@query("""select '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"part":"' || p_name || '"' || case when l_returnflag = 'N' then '' else ',"flag":"' || l_returnflag || '"' end || '}' as value from lineitem join part on l_partkey = p_partkey""")
def json_dump_all(spark, d):
    """SNK-06: lines of orders as JSON objects; null fields are left out."""
    from .sources.exports import json_lines

    df = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return json_lines(df.select("l_orderkey", "l_linenumber", F.col("p_name").alias("part"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag")))


@query("""select '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' as value from region""")
def json_dump(spark, d):
    """SNK-06."""
    from .sources.exports import json_lines

    return json_lines(read(spark, d, "region").select("r_regionkey", "r_name"))


@query(f"""with {_BASE} select id capture_id, 2 as schema_version, platform, prompt user_prompt, length(answer) answer_chars, answer answer_text, 0 as n_products from resp""")
def made_records(spark, d):
    """PRJ-01: missing columns are there, unknown ones are not."""
    from .schema import make_record

    df = make_record(responses(spark, d).drop("sources", "brand_mentions", "fanout", "geo"))
    return df.select(F.col("capture_id").cast("long").alias("capture_id"), "schema_version", "platform", "user_prompt", "answer_chars", "answer_text", F.size("products").alias("n_products"))


@query("select l_orderkey, l_linenumber, case l_returnflag when 'R' then 'cited' else 'fetched' end outcome, case when l_linenumber % 2 = 0 then 'news' else 'unknown' end as \"type\" from lineitem")
def made_sources(spark, d):
    """PRJ-02: values that are not known fall back."""
    from .schema import make_source

    s = F.struct(F.when(F.col("l_returnflag") == "R", "cited").otherwise(F.col("l_returnflag")).alias("outcome"), F.when(F.col("l_linenumber") % 2 == 0, "news").otherwise("odd").alias("type"))
    return read(spark, d, "lineitem").withColumn("s", s).withColumn("s", make_source(F.col("s"))).select("l_orderkey", "l_linenumber", "s.outcome", "s.type")


@query(f"""with {_PRESENCE}, g as (select ord, name, is_own, count(*) total, count_if(present) p, cast(sum(cnt) as bigint) mentions, sum(rnk) ranks, count(rnk) ranked, count_if(cited) citations, count_if(any_src) s from rk group by all),
 m as (select *, 100.0 * p / total::double vis, case when sum(mentions) over () > 0 then 100.0 * mentions / (sum(mentions) over ())::double else 0 end sov, case when ranked > 0 then ranks::double / ranked end pos, 100.0 * s / total::double sv from g)
select name as "Brand", case when is_own then 'yes' else 'no' end as "Is own", printf('%.2f', vis) as "Visibility %", printf('%.2f', sov) as "Share of Voice %", mentions as "Mentions", case when pos is null then '' else printf('%.2f', pos) end as "Avg position", citations as "Citations", printf('%.2f', sv) as "Source visibility %", p as "Responses present", total as "Total responses" from m""")
def metric_sheet(spark, d):
    """SNK-10: two decimals, an unknown place empty."""
    from .sources.exports import metric_rows

    return metric_rows(M.brand_metrics(_tracked(spark, d), BRANDS))


@query(f"""with {_POINTS}, names as (select distinct prompt_key, brand from pts join ment using (id)),
cells as (select p.prompt_key, x.brand, p.k, p.n, coalesce(m.cnt, 0) cnt from pts p join names x on p.prompt_key = x.prompt_key left join ment m on m.id = p.id and m.brand = x.brand)
select prompt_key prompt, 'brand' as "type", brand as name, string_agg(cast(cnt as bigint)::varchar, ',' order by k) as "values", cast(sum(case when k = n then cnt else 0 end) - sum(case when k = 1 then cnt else 0 end) as bigint) as delta from cells group by prompt_key, brand""")
def timeline_sheet(spark, d):
    """SNK-11: a row a prompt and name, its values in the order of the captures."""
    from .sources.exports import timeline_rows

    return timeline_rows(_matrix(spark, d), "brand")
