"""Queries about captures and single records: provenance, run state, decoding and text analysis, each with its SQL oracle."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import store
from .files import scratch, spread
from .functions import spans
from .functions.brands import CLOSE, MID, OPEN
from .operators import evidence, footnotes, merge, segments, structure
from .plans.tpch import read
from .registry import query
from .sources import decode, workbook
from .streaming import turns
from .streaming.replay import replay


# -- provenance ----------------------------------------------------------------
def _positions(events):
    """Every fifth event begins a turn of its user on the platform of its type; the last one of a platform goes on."""
    last = events.where("event_id % 5 = 0").groupBy("event_type").agg(F.max("event_id").alias("last"))
    minutes = F.make_dt_interval(mins=((F.col("event_id") % 7 + 1) * 15).cast("int"))
    df = events.where("event_id % 5 = 0").join(F.broadcast(last), "event_type")  # a row a platform
    until = F.when(F.col("event_id") != F.col("last"), F.col("ts").cast("timestamp") + minutes)
    return df.select(F.col("event_type").alias("platform"), F.col("user_id").cast("string").alias("run_id"), F.lit("p1").alias("profile_id"), (F.col("event_id") % 4).cast("int").alias("ordinal"), F.col("ts").cast("timestamp").alias("since"), until.alias("until"))


@query("""with t as (select *, max(event_id) over (partition by event_type) last from events where event_id % 5 = 0),
pos as (select event_type platform, user_id::varchar run_id, event_id % 4 ordinal, ts since, case when event_id <> last then ts + to_minutes((event_id % 7 + 1) * 15) end until from t),
hit as (select event_id, run_id, ordinal, row_number() over (partition by event_id order by since desc, run_id desc, ordinal desc) k from events join pos on platform = event_type and ts >= since and (until is null or ts < until))
select e.event_id, h.run_id, case when h.ordinal < 3 then h.run_id || '-' || h.ordinal end prompt_id, case when h.run_id is null then null when h.ordinal = 0 then 'first,' || h.run_id else '' end tags
from events e left join hit h on h.event_id = e.event_id and k = 1""")
def provenance(spark, d):
    """STM-02, JON-15: events as captures, stamped by an interval join with where the runs stood; a run's lists end before its last ordinal."""
    events = read(spark, d, "events")
    user = F.col("run_id")
    runs = events.select(F.col("user_id").cast("string").alias("run_id")).distinct()
    runs = runs.select("run_id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat_ws("-", user, k.cast("string"))).alias("prompt_ids"), F.array(F.array(F.lit("first"), user)).alias("prompt_tags"))
    captures = events.select(F.col("event_id").alias("capture_id"), F.col("event_type").alias("platform"), F.col("ts").cast("timestamp").alias("captured_at"))
    df = store.stamp(captures, _positions(events), store.run_prompts(runs))
    return df.select(F.col("capture_id").alias("event_id"), "geo.run_id", "geo.prompt_id", F.array_join("geo.tags", ",").alias("tags"))


# -- streams: each runs as a stream over the whole table, to its end ---------------
def _day_after(events):
    return events.agg(F.date_add(F.to_date(F.max("ts")), 1).cast("timestamp")).head()[0]


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) // 1000 t, row_number() over (partition by user_id order by ts, event_id) k from events),
f as (select user_id, event_id, t, k, t as last, true as ok from e where k = 1 union all
 select e.user_id, e.event_id, e.t, e.k, case when e.t - f.last >= 7200000 then e.t else f.last end, e.t - f.last >= 7200000 from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select user_id, event_id from f where ok""")
def debounced_stream(spark, d):
    """STM-04: the rows of ``debounced``, from a value state of each user."""
    events = read(spark, d, "events").select("user_id", "event_id", "ts")
    late = dt.timedelta(hours=1)
    out = replay(events, "ts", lambda s: turns.debounce(s, "user_id", "ts", "event_id", 7_200_000, "1 hour"), _day_after(events) + late)
    return out.where("key is not null").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"))


@query("select user_id, event_id, coalesce(ts_gap > 3600, true) as timed_out from (select user_id, event_id, (epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6 ts_gap from events window w as (partition by user_id order by ts, event_id))")
def watchdog_stream(spark, d):
    """STM-05: the rows of ``watchdog``, and the last event of each user, whose silence a timer ends."""
    events = read(spark, d, "events").select("user_id", "event_id", "ts")
    close = _day_after(events) + dt.timedelta(days=1)
    out = replay(events, "ts", lambda s: turns.watchdog(s, "user_id", "ts", "event_id", 3_600_000, "1 hour"), close)
    return out.where("key is not null").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), "timed_out")


#: A run a user with twelve prompts on each platform; every eleventh event is a failure, a capture of a small value has no signal.
_DEBOUNCE, _TIMEOUT, _PROMPTS = 6 * 3_600_000, 72 * 3_600_000, 12


def _outcomes(spark, d):
    events = read(spark, d, "events")
    key = [F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("platform")]
    started = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("at")).select(*key, "at", F.lit(-1).cast("long").alias("tie"), F.lit("start").alias("kind"), F.lit(False).alias("signal"), F.lit(_PROMPTS).cast("long").alias("total"), F.lit(None).cast("string").alias("reason"))
    failed = F.col("event_id") % 11 == 0
    told = events.select(*key, F.col("ts").alias("at"), F.col("event_id").alias("tie"), F.when(failed, "failure").otherwise("capture").alias("kind"), (F.col("value") > 20).alias("signal"), F.lit(None).cast("long").alias("total"), F.when(failed, "tab closed").alias("reason"))
    out = replay(started.unionByName(told), "at", lambda s: turns.turns(s, _DEBOUNCE, _TIMEOUT, "1 hour"), _day_after(events) + dt.timedelta(hours=1))
    return started.select("run_id", "platform", "total"), out


_TURNS = f"""with recursive w as (select epoch_ms(date_trunc('day', max(ts)) + interval 1 day) closed from events),
e as (select user_id, event_type, epoch_us(ts) // 1000 ms, event_id % 11 = 0 fails, value > 20 signal, row_number() over (partition by user_id, event_type order by ts, event_id) k, min(epoch_us(ts) // 1000) over (partition by user_id, event_type) started from events),
s as (select user_id, event_type, k, ms, fails, signal, 0 as ordinal, started as began, null::bigint as last, []::bigint[] took, []::varchar[] told from e where k = 1 union all
 select t.user_id, t.event_type, n.k, n.ms, n.fails, n.signal, t.ordinal2, t.began2, t.last2, t.took2, t.told2 from ({{step}}) t left join e n on n.user_id = t.user_id and n.event_type = t.event_type and n.k = t.k + 1 where t.k is not null),
fin as (select *, least({_PROMPTS} - ordinal, greatest(0, (closed - began - 1) // {_TIMEOUT})) late from s, w where k is null),
stand as (select user_id::varchar run_id, event_type platform, ordinal + late as ordinal, took, told || list_transform(range(0, late), lambda x: 'failed timeout') told, case when len(took) > 0 then list_avg(took[-10:]) end avg_ms from fin)"""
_STEP = f"""select *, case when counts then o + 1 else o end ordinal2, case when counts then ms else b end began2, case when counts then ms else l end last2, case when counts and not fails then took || [ms - b] else took end took2,
  told || list_transform(range(0, late), lambda x: 'failed timeout') || (case when not counts then [] when fails then ['failed tab closed'] else ['done '] end) told2 from (
 select *, o < {_PROMPTS} and (fails or signal and (l is null or ms - l >= {_DEBOUNCE})) counts from (
  select *, ordinal + late as o, began + late * {_TIMEOUT} as b, case when late > 0 then began + late * {_TIMEOUT} else last end l from (
   select *, least({_PROMPTS} - ordinal, greatest(0, (ms - began - 1) // {_TIMEOUT})) late from s)))"""
_TURNS = _TURNS.format(step=_STEP)


@query(_TURNS + f""" select run_id, platform, k::bigint as ordinal, case when k < len(told) then split_part(told[k + 1], ' ', 1) when k = len(told) then 'running' else 'pending' end status, case when k < len(told) and told[k + 1] like 'failed%' then substr(told[k + 1], 8) end reason from stand, range(0, {_PROMPTS}) r(k)""")
def run_progress(spark, d):
    """STM-03, STM-06, STM-08: what became of each prompt of each run, from the outcomes of a stream."""
    platforms, out = _outcomes(spark, d)
    prompts = platforms.select("run_id", "platform", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_PROMPTS - 1).cast("long"))).alias("ordinal"))
    return turns.progress(prompts, out)


@query(_TURNS + f""" select run_id, {_PROMPTS} * count(*) as total, cast(sum(len(list_filter(told, lambda x: x = 'done '))) as bigint) done, cast(sum(len(list_filter(told, lambda x: x <> 'done '))) as bigint) failed, cast(sum(len(told)) as bigint) as position,
 case when not bool_or(ordinal < {_PROMPTS} and avg_ms is null) then coalesce(max(case when ordinal < {_PROMPTS} then avg_ms * ({_PROMPTS} - ordinal) end), 0) end eta_ms from stand group by 1""")
def run_status(spark, d):
    """QRY-38, STM-08: a run's counts and the estimate of its slowest platform, from the state of a stream."""
    platforms, out = _outcomes(spark, d)
    return turns.run_status(out, platforms)


# -- names in texts --------------------------------------------------------------
@query("""with recursive t as (select conv_id, turn, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from conversations),
w as (select conv_id, turn, x, regexp_extract_all(x, '[a-z0-9]+')[:8] a from t),
u as (select conv_id, turn, name, min(k) k from (select conv_id, turn, unnest(l) as name, generate_subscripts(l, 1) k from (select conv_id, turn, a || list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) l from w)) where length(name) > 0 group by all),
n as (select conv_id, turn, name, row_number() over (partition by conv_id, turn order by length(name) desc, k) k from u),
p as (select conv_id, turn, x, unnest(range(1, length(x) + 1)) i from t),
h as (select conv_id, turn, n.k, n.name, i from n join p using (conv_id, turn) where substr(x, i, length(name)) = name
  and (i = 1 or not regexp_matches(substr(x, i - 1, 1), '[a-z0-9_]')) and not regexp_matches(substr(x, i + length(name), 1), '[a-z0-9_]')),
g as (select conv_id, turn, k, name, list(i order by i) hits from h group by all),
f as (select conv_id, turn, 0::bigint as k, ''::varchar as name, []::struct(a bigint, z bigint)[] taken, []::struct(a bigint, z bigint)[] hits from t union all
 select f.conv_id, f.turn, f.k + 1, n.name, taken || new, new from f join n on n.conv_id = f.conv_id and n.turn = f.turn and n.k = f.k + 1 left join g on g.conv_id = n.conv_id and g.turn = n.turn and g.k = n.k,
  lateral (select coalesce(list_filter(list_transform(g.hits, lambda i: {'a': i::bigint, 'z': (i + length(n.name))::bigint}), lambda s: len(list_filter(f.taken, lambda c: c.a <= s.a and s.z <= c.z)) = 0), []) new))
select conv_id, turn, name, len(hits) as count, hits[1].a - 1 as first_index from f where len(hits) > 0""")
def claimed_mentions(spark, d):
    """WIN-10, SRT-12: names that are the first words of a message, and pairs of them; a word inside a pair is not counted again."""
    df = read(spark, d, "conversations")
    words = F.slice(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.lower(w)), 1, 8)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 8), lambda a, b: F.concat_ws(" ", a, b))
    names = F.transform(F.array_distinct(F.concat(words, pairs)), lambda n: F.struct(n.alias("name"), F.lit(False).alias("label")))
    found = df.select("conv_id", "turn", F.explode(spans.claims(F.col("text"), names)).alias("c")).where(F.size("c.hits") > 0)
    return found.select("conv_id", "turn", "c.name", F.size("c.hits").cast("long").alias("count"), F.col("c.hits")[0]["start"].cast("long").alias("first_index"))


#: Words of messages with their places; every fifth and every seventh one begin spans of three and two words.
@query("""with recursive w as (select conv_id, turn, text, unnest(string_split(text, ' ')) word, generate_subscripts(string_split(text, ' '), 1) k from conversations),
p as (select *, coalesce(sum(length(word) + 1) over (partition by conv_id, turn order by k rows between unbounded preceding and 1 preceding), 0) pos, max(k) over (partition by conv_id, turn) n from w),
ends as (select a.conv_id, a.turn, a.pos::bigint a, (b.pos + length(b.word))::bigint z, m, row_number() over (partition by a.conv_id, a.turn order by a.pos, b.pos + length(b.word), m) k
  from p a, (values ('cite', 5, 2), ('entity', 7, 1)) t(m, every, more) join p b on b.conv_id = a.conv_id and b.turn = a.turn and b.k = least(a.n, a.k + more) where a.k % every = 0 and b.pos + length(b.word) > a.pos),
g as (select conv_id, turn, 0::bigint as k, 0::bigint as cur, 0::bigint a, 0::bigint z, '' m, false as ok from (select distinct conv_id, turn from conversations) union all
 select g.conv_id, g.turn, e.k, case when e.a >= g.cur then e.z else g.cur end, e.a, e.z, e.m, e.a >= g.cur from g join ends e on e.conv_id = g.conv_id and e.turn = g.turn and e.k = g.k + 1),
kept as (select conv_id, turn, a, z, m, coalesce(lag(z) over (partition by conv_id, turn order by a), 0) before from g where ok),
every as (select conv_id, turn, a, z, m from kept union all select conv_id, turn, before, a, 'text' from kept where a > before
 union all select conv_id, turn, s, length(text), 'text' from (select c.conv_id, c.turn, c.text, coalesce(max(z), 0) s from conversations c left join kept using (conv_id, turn) group by all) where s < length(text))
select conv_id, turn, a as start, z as "end", m as "type", substr(text, a + 1, z - a) as value from every join conversations using (conv_id, turn)""")
def segment_cover(spark, d):
    """WIN-09: overlapping spans over the words of each message, and what lies between them."""
    df = read(spark, d, "conversations").select("conv_id", "turn", "text")
    w = Window.partitionBy("conv_id", "turn").orderBy("k")
    words = df.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("k", "word"))
    words = words.withColumn("start", F.coalesce(F.sum(F.length("word") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("end", F.col("start") + F.length("word"))
    last = w.rowsBetween(0, Window.unboundedFollowing)
    upto = lambda more: F.coalesce(F.lead("end", more).over(w), F.last("end").over(last))
    ends = words.select("conv_id", "turn", "start", upto(2).alias("cite"), upto(1).alias("entity"), (F.col("k") + 1).alias("n"))
    found = ends.where("n % 5 = 0").select("conv_id", "turn", "start", F.col("cite").alias("end"), F.lit("cite").alias("type")).union(ends.where("n % 7 = 0").select("conv_id", "turn", "start", F.col("entity").alias("end"), F.lit("entity").alias("type")))
    return segments.cover(df, found.where("end > start"), ["conv_id", "turn"]).select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "type", "value")


#: Lines of an order by their place: what they are to its record.  A source writes its brand as it is, in words, or squashed, or not at all.
_ROLES = """l as (select l_orderkey id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) k, p_brand brand, p_name name, p_size size, p_partkey % 4 as form, l_returnflag <> 'N' narrated, substr(p_brand, 7) num from lineitem join part on l_partkey = p_partkey)"""
_SEVENTH = {"brand#7": "Seventh", "brand 7": "Seventh", "brand7": "Seventh"}


@query(f"""with {_ROLES},
names as (select id, k, 1 as role, brand as n from l where k <= 2 union all select id, k, 2, 'Brand' || num from l where k = 3 union all select id, k, 3, brand from l where k = 4 union all select id, k, 4, 'Brand ' || num from l where k = 5),
voc as (select id, n, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') as key, row_number() over (partition by id order by role, k) place from names qualify row_number() over (partition by id, key order by role, k) = 1),
src as (select id, k - 1 as s, name || ' ' || case form when 0 then brand when 1 then 'brand ' || num when 2 then 'BRAND' || num else 'the ' || num || ' brand' end || ' ' || name || case size % 3 when 0 then ', new' when 1 then ' is here' else '; ok' end t from l),
hit as (select id, n, place, s, t from voc join src using (id) where regexp_matches(lower(t), '(^|[^a-z0-9&])' || array_to_string(string_split(key, ''), '[^a-z0-9&]*') || '($|[^a-z0-9&])')),
m as (select *, case when lower(n) in ('brand#7', 'brand 7', 'brand7') then 'Seventh' else n end canon, trim(regexp_extract(t, '(?i)\\b' || n || '\\s+([a-z0-9][a-z0-9\\-.\\s]{{1,20}})', 1)) raw from hit),
told as (select distinct id, lower(case when lower(brand) = 'brand#7' then 'Seventh' else brand end) as key from l where k <= 2 and narrated),
answers as (select id, 'About ' || name answer from l where k = 1),
x as (select m.id, lower(canon) as key, canon, s, place, case when length(raw) between 2 and 24 and not regexp_matches(raw, '\\b(is)\\b') then raw end model, told.key is not null narrated, answer from m join answers using (id) left join told on told.id = m.id and told.key = lower(canon)),
y as (select *, case when model is not null and not (narrated and contains(lower(answer), lower(model))) then model end kept, row_number() over (partition by id, key, lower(model) order by s, place) d from x),
g as (select id, key, arg_max(canon, row(s, place)) brand, bool_or(narrated) narrated, array_to_string(list_sort(list_distinct(list(s))), ',') sources, coalesce(string_agg(case when d = 1 then kept end, '; ' order by s, place), '') models from y group by all)
select id capture_id, brand, case when narrated then 'ignored models' else 'omitted' end kind, case when narrated then '' else sources end sources, models from g where not narrated or models <> ''""")
def omitted_brands(spark, d):
    """QRY-33, JON-09, TXT-08: brands that sources speak of and the answer leaves out, and models of narrated ones."""
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    lines = read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    num, form = F.substring("p_brand", 7, 9), F.col("p_partkey") % 4
    written = F.when(form == 0, F.col("p_brand")).when(form == 1, F.concat(F.lit("brand "), num)).when(form == 2, F.concat(F.lit("BRAND"), num)).otherwise(F.concat(F.lit("the "), num, F.lit(" brand")))
    size = F.col("p_size") % 3
    snippet = F.concat_ws(" ", written, F.concat("p_name", F.when(size == 0, ", new").when(size == 1, " is here").otherwise("; ok")))
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), num.alias("num"), F.when(F.col("l_returnflag") != "N", 1).otherwise(0).alias("count"), snippet.alias("snippet"))
    df = spread(lines, "l_orderkey").groupBy(F.col("l_orderkey").alias("capture_id")).agg(F.array_sort(F.collect_list(one)).alias("l"))
    at = lambda a, n, f: F.transform(F.slice("l", a, n), f)
    records = df.select(
        "capture_id", at(1, 2, lambda x: F.struct(x["brand"].alias("brand"), x["count"].alias("count"))).alias("brand_mentions"),
        at(3, 1, lambda x: F.struct(F.lit("").alias("brand"), F.concat(F.lit('"'), x["brand"], F.lit('" '), x["name"]).alias("name"))).alias("products"), at(4, 1, lambda x: F.struct(x["brand"].alias("name"))).alias("places"),
        F.concat(at(5, 1, lambda x: F.struct(F.concat(F.lit("Brand "), x["num"]).alias("text"), F.lit("Brand").alias("category"))), at(6, 1, lambda x: F.struct(x["brand"].alias("text"), F.lit("Color").alias("category")))).alias("entities"),
        F.transform("l", lambda x: F.struct(x["name"].alias("title"), x["snippet"].alias("snippet"))).alias("sources"), F.concat(F.lit("About "), F.col("l")[0]["name"]).alias("answer_text"),
    )
    out = evidence.evaluated(records, _SEVENTH)
    return out.select("capture_id", "brand", "kind", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"), F.array_join("models", "; ").alias("models"))


# -- payloads --------------------------------------------------------------------
_BIT = 40


def _payloads(spark, d):
    """Conversations as recorded event streams: each message is announced with its first characters and then grows by operations of three forms, between
    lines of other kinds and broken ones; at the end the first message is announced once more, and grows."""
    df = read(spark, d, "conversations").select("conv_id", "turn", "text", "role")
    name = F.concat_ws("-", "conv_id", "turn")
    data = lambda x: F.concat(F.lit("data: "), F.to_json(x))
    opening = lambda text: F.struct(F.struct(F.struct(name.alias("id"), F.struct("role", F.struct(F.when(F.col("turn") % 3 == 0, "tool:web").alias("real_author")).alias("metadata")).alias("author"), F.struct(F.array(text).alias("parts")).alias("content")).alias("message")).alias("v"), F.when(F.col("turn") % 4 == 1, "final").alias("channel"))
    rest = F.expr(f"substr(text, {_BIT + 1})")
    starts = F.when(F.length(rest) > 0, F.sequence(F.lit(1), F.length(rest), F.lit(_BIT))).otherwise(F.array().cast("array<int>"))
    append = lambda x: F.struct(F.lit("/message/content/parts/0").alias("p"), F.lit("append").alias("o"), x.alias("v"))
    other = F.struct(F.lit("/message/status").alias("p"), F.lit("replace").alias("o"), F.lit("going on").alias("v"))
    grown = lambda s: F.when(s % 3 == 0, data(append(rest.substr(s, F.lit(_BIT))))).when(s % 3 == 1, data(F.struct(rest.substr(s, F.lit(_BIT)).alias("v")))).otherwise(data(F.struct(F.array(other, append(rest.substr(s, F.lit(_BIT)))).alias("v"))))
    told = F.concat(F.array(F.lit("event: delta"), data(opening(F.expr(f"substr(text, 1, {_BIT})")))), F.transform(starts, grown), F.when(F.col("turn") % 5 == 0, F.array(F.lit('data: {"v": '), F.lit("data:"))).otherwise(F.array(F.lit(": idle"))))
    again = F.when(F.col("turn") == 0, F.concat_ws("\n", data(opening(F.lit("not again"))), F.lit('data: {"v":" (end)"}'), F.lit("data: [DONE]")))
    parts = df.groupBy(F.col("conv_id").alias("capture_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.array_join(told, "\n").alias("x")))).alias("l"), F.max(again).alias("again"))
    return parts.select("capture_id", F.concat_ws("\r\n", F.array_join(F.transform("l", lambda x: x["x"]), "\r\n"), "again").alias("raw"))


@query("""with m as (select conv_id, turn, case when turn = 0 then text || ' (end)' else text end t, turn % 3 = 0 or turn % 4 = 1 fin from conversations)
select conv_id capture_id, count(*) messages, arg_min(t, row(case when fin and length(t) > 0 then 0 else 1 end, -length(t), turn)) answer from m group by 1""")
def rebuilt_answers(spark, d):
    """JSN-01, JSN-07, SRC-05: conversations sent as delta streams and folded again; every operation and every broken line is found in its place."""
    nodes, _ = decode.sse_nodes(_payloads(spark, d))
    n = decode.messages(nodes).groupBy("capture_id").agg(F.count("*").alias("messages"))
    return decode.answers(nodes).join(n, "capture_id").select("capture_id", "messages", F.col("text").alias("answer"))


@query(f"""with m as (select conv_id, turn, 1 + (greatest(length(text) - {_BIT}, 0) + {_BIT - 1}) // {_BIT} n from conversations)
select conv_id capture_id, cast(sum(n) + max(case when turn = 0 then 2 else 0 end) as bigint) nodes, cast(sum(case when turn % 5 = 0 then 1 else 0 end) as bigint) broken from m group by 1""")
def decoded_lines(spark, d):
    """SRC-05, JSN-04: lines of streams that are nodes, and those kept aside as broken."""
    nodes, broken = decode.sse_nodes(_payloads(spark, d))
    both = nodes.select("capture_id", F.lit(1).alias("nodes"), F.lit(0).alias("broken")).union(broken.select("capture_id", F.lit(0), F.lit(1)))
    return both.groupBy("capture_id").agg(F.sum("nodes").alias("nodes"), F.sum("broken").alias("broken"))


@query("""select page_id, 2 - page_id % 2 as frames, case when page_id % 3 = 0 then 2 else 1 end as broken, url, length(html) chars from pages""")
def rpc_frames(spark, d):
    """SRC-06: pages sent as RPC streams, whose frames hold their payloads as JSON texts."""
    df = read(spark, d, "pages").select("page_id", "url", "html")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.to_json(c).alias("x"))), '(?s)^\\{"x":(.*)\\}$', 1)
    frame = lambda c: F.concat(F.lit('["wrb.fr",null,'), quoted(c), F.lit("]"))
    first = frame(F.array("url", "html"))
    more = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(","), frame(F.array(F.lit("second"))))).otherwise("")
    chunk = F.concat(F.lit("["), first, more, F.lit(',["di",12],["wrb.fr",null,"{broken"],["wrb.fr",null,null]]'))
    raw = F.concat(F.lit(")]}'\n\n123\n"), chunk, F.lit("\n25\n"), F.when(F.col("page_id") % 3 == 0, '[["wrb.fr",null').otherwise('["e",4]'), F.lit("\n"))
    payloads, broken = decode.rpc_payloads(df.select(F.col("page_id").alias("capture_id"), raw.alias("raw")))
    of = payloads.groupBy("capture_id").agg(F.count("*").alias("frames"), F.max(F.when(F.col("frame") == 0, F.struct(decode.at(F.col("node"), "[0]").alias("url"), F.length(decode.at(F.col("node"), "[1]")).alias("chars")))).alias("x"))
    bad = broken.groupBy("capture_id").agg(F.count("*").alias("broken"))
    return of.join(bad, "capture_id").select(F.col("capture_id").alias("page_id"), "frames", "broken", "x.url", F.col("x.chars").cast("long").alias("chars"))


def _found(spark, d):
    """Every value in the streams of orders, whose lines came as search results, as citations deeper down, and some as product cards, too."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    url = F.concat(F.lit("HTTPS://Site"), supp % 10, F.lit(".Example/p"), part % 3, F.when(n % 3 == 0, "?utm_source=x&q=1").when(n % 3 == 1, "?q=1").otherwise(""))
    title = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("T"), part))
    date = F.when(n % 5 == 0, n + 1_700_000_000)
    ref = F.struct(F.lit(0).alias("turn_index"), F.lit("search").alias("ref_type"), n.alias("ref_index"))
    result = F.to_json(F.struct(F.array(F.struct(F.lit("search_result").alias("type"), url.alias("url"), title.alias("title"), F.concat(F.lit("S"), supp).alias("snippet"), date.alias("pub_date"), ref.alias("ref_id"))).alias("r")))
    cited = F.to_json(F.struct(F.struct(F.array(F.array(F.struct(url.alias("link"), F.concat(F.lit("Site "), supp % 10).alias("attribution"), title.alias("title"), date.alias("pub_date")))).alias("list")).alias("deep")))
    card = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("p"), part % 5).alias("id"), title.alias("title"), F.when(n % 2 == 1, F.concat(F.lit("$"), supp)).alias("price"), F.when(n % 6 == 0, 4.5).alias("rating")).alias("product"))).alias("cards")))
    told = F.concat_ws("\n", F.concat(F.lit("data: "), F.when(n % 2 == 0, result).otherwise(cited)), F.when(n % 3 == 0, F.concat(F.lit("data: "), card)))
    # Texts are many times larger than the numbers they are made of, so these are shuffled.
    lines = spread(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_orderkey")
    raw = lines.select("l_orderkey", one.alias("o"), told.alias("x")).groupBy(F.col("l_orderkey").alias("capture_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]), "\n").alias("raw"))
    return decode.walk(decode.sse_nodes(raw)[0], holders=True)


_SHOWN = """l as (select l_orderkey id, l_linenumber n, l_partkey part, l_suppkey supp, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) k from lineitem),
s as (select *, 'https://site' || supp % 10 || '.example/p' || part % 3 || case when n % 3 = 2 then '' else '?q=1' end url, case when n % 4 = 0 then '' else 'T' || part end title, case when n % 5 = 0 then n + 1700000000 end as dated from l)"""


@query(f"""with {_SHOWN}, g as (select id, url, bool_or(n % 2 = 1) cited, arg_max(case when dated is not null then 'news' when n % 2 = 0 then 'other' else 'citation' end, k) as "type", arg_max(title, k) filter (title <> '') title, arg_max('S' || supp, k) filter (n % 2 = 0) snippet,
 arg_max('Site ' || supp % 10, k) filter (n % 2 = 1) attribution, arg_max(dated, k) pub_date, coalesce(string_agg(distinct case when n % 2 = 0 then 'turn0search' || n end, ',' order by case when n % 2 = 0 then 'turn0search' || n end), '') marks, min(k) first from s group by all)
select id capture_id, row_number() over (partition by id order by first) as position, url, case when cited then 'cited' else 'fetched' end outcome, "type", title, snippet, attribution, pub_date::bigint pub_date, marks from g""")
def merged_sources(spark, d):
    """AGG-22, JSN-02, JSN-03, SET-05: sources found anywhere in the nodes, as one row an address: the outcome rises, texts keep the newest that is not empty."""
    rows = decode.search_results(_found(spark, d))
    df = merge.merge_sources(rows, ["capture_id"], ["line", "path"])
    return df.withColumn("position", F.col("position").cast("long")).withColumn("marks", F.array_join(F.array_sort("marker_ids"), ",")).drop("marker_ids")


@query(f"""with {_SHOWN} select id capture_id, 'p' || part % 5 as id, arg_max(title, k) filter (title <> '') as "name", arg_max('$' || supp, k) filter (n % 2 = 1) price, max(case when n % 6 = 0 then 4.5 end)::double rating from s where n % 3 = 0 group by 1, 2""")
def merged_products(spark, d):
    """AGG-23, AGG-24: product cards found anywhere in the nodes, as one row a product."""
    rows = decode.product_cards(_found(spark, d))
    return merge.merge_fields(rows, ["capture_id"], F.coalesce("id", "name"), ["line", "path"]).select("capture_id", "id", "name", "price", "rating")


# -- structure and footnotes --------------------------------------------------------
@query("""with l as (select l_suppkey supp, p_name name, p_brand brand, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) k from lineitem join part on l_partkey = p_partkey)
select supp, case when k % 8 in (2, 3) then 'table' when k % 8 = 5 then 'heading' else 'bold' end kind, name candidate, count(*) n from l where k % 8 in (2, 3, 5, 6) group by all""")
def structural_candidates(spark, d):
    """TXT-05, TXT-06, TXT-07: the lines of each supplier as one markdown text of tables, rows without a rule, headings, bold leads and prose."""
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    one = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "p_name", "p_brand")
    lines = read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", one.alias("x"))

    def written(x, k):
        name, brand, at = x["p_name"], x["p_brand"], (k + 1) % 8
        return (
            F.when(at == 1, "| Product | Brand |\n|:---|---:|").when(at == 2, F.concat(F.lit("| **"), name, F.lit("** | "), brand, F.lit(" |"))).when(at == 3, F.concat(name, F.lit(" \\| x | "), brand)).when(at == 4, F.concat(F.lit("The "), name, F.lit(" is **good**.")))
            .when(at == 5, F.concat(F.lit("## "), (k + 1).cast("string"), F.lit(". "), name, F.lit(" — best"))).when(at == 6, F.concat(F.lit("- **"), brand, F.lit(": "), name, F.lit("** it is"))).when(at == 7, F.concat(name, F.lit(" | "), brand)).otherwise("| x | y |\n| --- |")
        )

    texts = spread(lines, "l_suppkey").groupBy(F.col("l_suppkey").alias("supp")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), written), "\n").alias("text"))
    return structure.candidates(texts, ["supp"]).groupBy("supp", "kind", "candidate").agg(F.count("*").alias("n"))


@query("""with l as (select l_orderkey id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) k, p_name name, 'https://s' || l_suppkey % 4 || '.com/' url from lineitem join part on l_partkey = p_partkey),
m as (select id, k % 3 as m, arg_max(url, k) url from l where k % 5 <> 0 group by 1, 2),
c as (select l.id, l.k, name, m.url, 'turn0search' || l.k % 3 as marker, l.k % 2 = 0 as twice from l left join m on m.id = l.id and m.m = l.k % 3),
n as (select id, url, row_number() over (partition by id order by min(k)) num from c where url is not null group by 1, 2)
select c.id capture_id, string_agg(name || ' ' || case when num is null then '' else '[' || num || ']' end || '; ', '' order by k) as "text", coalesce((select string_agg(url, ' ' order by num) from n where n.id = c.id), '') notes,
 coalesce(string_agg(case when twice then case when num is null then marker || ' turn1news9' else 'turn1news9' end when num is null then marker end, ' ' order by k), '') unresolved,
 coalesce((select string_agg(url, ' ' order by f) from (select url, min(k) f from l where l.id = c.id and url not in (select url from n where n.id = c.id) group by 1)), '') others
from c left join n on n.id = c.id and n.url = c.url group by c.id""")
def footnoted_answers(spark, d):
    """JON-06, QRY-41, SET-04: answers that cite after each of an order's lines; several sources have a marker, some markers have no source."""
    part = read(spark, d, "part").select("p_partkey", "p_name")
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_name")
    lines = read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", one.alias("x"))
    marker = lambda k: F.concat(F.lit("turn0search"), ((k + 1) % 3).cast("string"))
    cited = lambda x, k: F.concat(x["p_name"], F.lit(f" {OPEN}cite{MID}"), marker(k), F.when((k + 1) % 2 == 0, f"{MID}turn1news9").otherwise(""), F.lit(f"{CLOSE}; "))
    source = lambda x, k: F.struct(F.concat(F.lit("https://s"), (x["l_suppkey"] % 4).cast("string"), F.lit(".com/")).alias("url"), F.when((k + 1) % 5 != 0, F.array(marker(k))).otherwise(F.array().cast("array<string>")).alias("marker_ids"))
    df = spread(lines, "l_orderkey").groupBy(F.col("l_orderkey").alias("capture_id")).agg(F.array_sort(F.collect_list("x")).alias("l"))
    out = footnotes.footnoted(df.select("capture_id", F.array_join(F.transform("l", cited), "").alias("answer_text"), F.transform("l", source).alias("sources")))
    return out.select("capture_id", "text", *[F.array_join(c, " ").alias(c) for c in ("notes", "unresolved", "others")])


@query("""with c as (select 'Customers' sheet, c_custkey::varchar a, c_name b, c_mktsegment c from customer), n as (select 'Nations', n_nationkey::varchar, n_name, n_regionkey::varchar from nation), p as (select 'Parts', p_partkey::varchar, case when p_partkey % 3 = 0 then '''=' else '' end || p_name || ' <&> "é"', '["' || p_brand || '","' || p_type || '"]' from part)
select sheet, a || '|' || b || '|' || c as cells, count(*) n from (select * from c union all select * from n union all select * from p union all select 'Customers', 'id', 'name', 'extra' union all select 'Nations', 'id', 'name', 'extra' union all select 'Parts', 'id', 'name', 'extra') group by all""")
def workbook_round_trip(spark, d):
    """SRC-09, SRC-10, SNK-05: three tables as the sheets of one workbook, written by tasks and read back a sheet a partition; further sheets count as the one that they continue."""
    named = lambda df, *c: df.select(*[x.alias(n) for x, n in zip(c, ("id", "name", "extra"), strict=True)])
    col = F.col
    name = F.concat(F.when(col("p_partkey") % 3 == 0, "=").otherwise(""), "p_name", F.lit(' <&> "é"'))
    sheets = {
        "Customers": named(read(spark, d, "customer"), col("c_custkey"), col("c_name"), col("c_mktsegment")), "Nations": named(read(spark, d, "nation"), col("n_nationkey"), col("n_name"), col("n_regionkey")),
        "Parts": named(read(spark, d, "part").repartition(3), col("p_partkey"), name, F.array("p_brand", "p_type")),
    }
    path = f"{scratch(spark)}/book-{uuid.uuid4().hex}.xlsx"
    workbook.write_workbook(sheets, path)
    return workbook.continued(workbook.read_workbook(spark, path), list(sheets)).groupBy("sheet", F.array_join("cells", "|").alias("cells")).agg(F.count("*").alias("n"))
