"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, fingerprints, language_id, lexical, license_scan, near_dedup, packing, quality_rules, shards, simhash, toxicity, url_filters
from ._common import cut, in_fold, shared_dir, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = packing.pieces(docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, 2048)
    return packing.pack(found, 2048)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = in_fold(F.col("doc_id"), 4, 2)
    out = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_langs")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as read back from the compacted store, with the version that wrote each one's shard."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target=64 << 20)
    for arrival in shards.arrivals(docs, 3):
        store.append(arrival)
    store.compact()
    store.vacuum()
    born = F.regexp_extract(F.input_file_name(), r"/data/(\d+)-", 1).cast("int")
    # Numbers only are kept, so that the store need not stay behind.
    out = cut(store.read().select("doc_id", "n_chars", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), born.alias("born")))
    store.drop()
    return out


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, words=3, percent=85)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = license_scan.scan(license_scan.files_of_documents(spark, docs))
    return out.select(F.col("file").alias("doc_id"), "directory", "license", "cosine", "inherited_from")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    out = quality_rules.apply(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=10)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, radius=2)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_filters, op3_packing, op4_bpe, op5_language_id, op6_sharding, op7_near_dedup, op8_license_scan, op9_fingerprints, op10_quality_rules, op11_lexical_search, op12_simhash, op13_filter_audit)}


def _url_oracle() -> str:
    fits = "(h = '{0}' or ends_with(h, '.{0}')) and starts_with(p, '{1}')"
    rules = [(r.name, r.verdict, fits.format(*r.name.split("/", 1)[:1], "/" + r.name.split("/", 1)[1])) for r in url_filters.HOST_RULES]
    rules.sort(key=lambda r: -len(r[0]))
    case = lambda k: "case " + " ".join(f"when {r[2]} then '{r[k]}'" for r in rules)
    hits = ", ".join(f"case when regexp_matches(h || p || q, '{r.pattern}') then '{r.name}' end" for r in url_filters.PATTERN_RULES)
    return f"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end t from pages),
 parts as (select page_id, translate(regexp_extract(t, '^([^/?#]*)', 1), '{url_filters._UPPER}', '{url_filters._LOWER}') h, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) p, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) q from cut),
 judged as (select *, {case(0)} end r, {case(1)} end v, list_max([{hits}]) w from parts)
select page_id, h as host, p as path, r as rule, coalesce(v, case when w is not null then 'block' else 'allow' end) as verdict, case when r is null then w end as pattern
from judged"""


#: All pairs that share a shingle, compared on their full sets, and what each document reaches over the links.
_NEAR_ORACLE = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') a from documents),
 s as (select doc_id, unnest(case when len(a) >= 3 then list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) when len(a) > 0 then [array_to_string(a, ' ')] else [] end) g from w),
 n as (select doc_id, count(*) n from s group by 1),
 p as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
 e as (select a, b from p join n u on u.doc_id = a join n v on v.doc_id = b where 100 * c >= 85 * (u.n + v.n - c)),
 both_ways as (select a, b from e union all select b, a from e),
 reach(node, comp) as (select doc_id, doc_id from n union select both_ways.b, reach.comp from reach join both_ways on reach.node = both_ways.a),
 m as (select node, min(comp) comp from reach group by 1)
select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(m.comp, d.doc_id) component_id, d.doc_id = coalesce(m.comp, d.doc_id) kept from documents d left join n on n.doc_id = d.doc_id left join m on m.node = d.doc_id"""

def _license_oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({k}, {quote(a)}, {quote(b)})" for k, (a, b) in enumerate(license_scan.TEMPLATES))
    low = lambda c: f"translate({c}, '{license_scan.UPPER}', '{license_scan.LOWER}')"
    key = lambda c: "(" + " or ".join(f"contains({low(c)}, '{k}')" for k in license_scan.KEYS) + ")"
    usable = lambda c: f"({key(c)} and not regexp_matches({c}, {quote(license_scan.NEGATED)}))"
    words = lambda c: f"unnest(regexp_extract_all({low(c)}, '{license_scan.TOKEN}')) token"
    best = f"(license = '{license_scan.PROPRIETARY}'), equal, -cosine, license"
    return rf"""
with recursive tree as (select doc_id, doc_id % 10 = 0 lic, text, concat_ws('/', '', coalesce(source, 'none'), coalesce(lang, 'none')) as top, cast(doc_id // 100 as varchar) as leaf from documents),
 files as (select doc_id, lic, text, case when doc_id % 20 = 0 then top else top || '/' || leaf end directory from tree),
 paras as (select doc_id, lic, text, string_split_regex(text, '{license_scan.BLOCK_END}') ps from files where {key("text")}),
 headers as (select doc_id, lic, text, ps, list_transform(list_concat(string_split(array_to_string(list_transform(ps, lambda p: case when {key("p")} then p else '{license_scan._GAP}' end), chr(10)), '{license_scan._GAP}'),
   regexp_extract_all(text, '{license_scan.COMMENT_RUN}')), lambda x: trim(regexp_replace(x, '^\n+|\n+\z', '', 'g'), ' ')) hs from paras),
 cand as (select doc_id, trim(unnest(list_concat(list_filter(string_split_regex(text, '{license_scan.LINE_END}'), lambda x: {usable("x")}),
   list_filter(hs, lambda x: contains(trim(translate(x, chr(13), ' '), ' '), chr(10)) and {usable("x")}), case when lic then [text, array_to_string(list_filter(ps, lambda p: trim(p, ' ') <> '')[:2], chr(10))] else [] end)), ' ') t from headers),
 texts as (select distinct t from cand),
 mine as (select t, token, count(*) tf from (select t, {words("t")} from texts) group by all),
 tpl(template, license, notice) as (values {known}),
 theirs as (select template, license, token, count(*) tf from (select template, license, {words("notice")} from tpl) group by all),
 total as (select count(distinct t) n from mine),
 idf as (select a.token, ln((n + 2.0) / (coalesce(df, 0) + 1.0)) idf from (select distinct token from theirs) a cross join total left join (select token, count(*) df from mine group by 1) d on d.token = a.token),
 vec as (select template, license, token, idf, tf * idf w from theirs join idf using (token)),
 unit as (select template, license, token, w / sqrt(sum(w * w) over (partition by template)) u from vec),
 weighed as (select t, mine.token, tf * coalesce(idf, ln(n + 2.0) / 4) w from mine cross join total left join idf on idf.token = mine.token),
 norm as (select t, sqrt(sum(w * w)) norm from weighed group by 1),
 dots as (select t, template, license, sum(w * u) dot from weighed join unit using (token) group by all),
 near as (select t, license, max(round(dot / norm, 6)) cosine from dots join norm using (t) where norm > 0 and round(dot / norm, 6) >= 0.75 group by all),
 scored as (select t, license, cosine, count(*) filter (cosine > top - {license_scan.EQUAL}) over (partition by t) > 1 as equal from (select *, max(cosine) over (partition by t) top from near) qualify row_number() over (partition by t order by -cosine, license) = 1),
 stated as (select doc_id, license, cosine, row_number() over (partition by doc_id order by {best}) k from cand join scored using (t) ),
 own as (select files.doc_id, directory, lic, license, cosine from files left join (select * from stated where k = 1) s on s.doc_id = files.doc_id),
 given as (select directory, license, row_number() over (partition by directory order by {best.replace(' equal,', '')}) k from own where lic and license is not null),
 above(directory, path) as (select distinct directory, directory from own union select directory, regexp_replace(path, '/[^/]*$', '') from above where path <> ''),
 inherited as (select above.directory, path, license, row_number() over (partition by above.directory order by length(path) desc) k from above join given on given.directory = path and given.k = 1)
select own.doc_id, own.directory, coalesce(own.license, inherited.license) license, cosine, case when own.license is null then path end inherited_from
from own left join inherited on inherited.directory = own.directory and inherited.k = 1"""


#: Every document against every order and step, without the lookup table.
_AUDIT_ORACLE = r"""
with t as (select doc_id, coalesce(source, '') part, coalesce(text, '') text from documents),
 w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') a, min(doc_id) over (partition by text) first from t),
 f as (select doc_id, part, map {'A': len(a) < 200, 'B': 100 * len(list_distinct(a)) < 50 * len(a), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
   'D': regexp_matches(text, '[#$%&*|]'), 'E': doc_id > first} fails from w),
 letters as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
 orders as (select a.x || b.x || c.x || d.x || e.x filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 steps as (select filter_order, step, substr(filter_order, step, 1) letter, list_transform(range(1, step), lambda k: substr(filter_order, k, 1)) earlier from orders, range(1, 6) r(step)),
 kinds as (select part, fails, count(*) n, count(*) filter (quality = 1) good, count(*) filter (toxic = 1) toxic from f left join labels using (doc_id) group by all),
 hits as (select *, len(list_filter(earlier, lambda x: fails[x])) before, len(list_filter(map_values(fails), lambda x: x)) number, fails[letter] here from kinds, steps),
 found as (select part, filter_order, step, letter, coalesce(sum(n) filter (before = 0 and not here), 0) kept, coalesce(sum(n) filter (before = 0 and here), 0) removed, coalesce(sum(n) filter (before > 0 and here), 0) redundant,
   coalesce(sum(n) filter (number = 1 and here), 0) unique_fails, coalesce(sum(good) filter (before = 0 and here), 0) good_lost, coalesce(sum(toxic) filter (before = 0 and here), 0) toxic_lost from hits group by all)
select part, filter_order, cast(step as int) step, letter as "filter", kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, letter) shapley from found"""


_SEARCH_ORACLE = r"""
with d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from documents),
 q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
 n as (select doc_id, count(*) n from d group by 1),
 total as (select count(*) docs, sum(n)::bigint len from n),
 m as (select doc_id, 10 + (90 * n * docs) // len m from n, total),
 tf as (select doc_id, term, count(*) tf from d group by all),
 w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint w from tf, total group by term, docs),
 s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from q join tf using (term) join w using (term) join m using (doc_id) group by all),
 r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) k, doc_id, score from s where score > 0)
select item_id, k::int as rank, doc_id, score from r where k <= 10"""


#: Equivalent DuckDB SQL, where SQL can express the operator.
ORACLES: dict[str, str] = {"op2_url_filters": _url_oracle(), "op7_near_dedup": _NEAR_ORACLE, "op8_license_scan": _license_oracle(), "op11_lexical_search": _SEARCH_ORACLE, "op13_filter_audit": _AUDIT_ORACLE}
