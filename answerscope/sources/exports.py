"""Sinks: CSV, JSON lines, workbook sheets, HTML documents and reports."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.brands import segments
from ..functions.text import csv_cell
from ..operators import dashboards as D
from . import workbook


def to_fixed(x: float | None, digits: int) -> str:
    """Decimal text of the exact binary value, halves away from zero."""
    return "" if x is None else str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def metric_rows(metrics: DataFrame) -> DataFrame:
    """The sheet of campaign metrics: a row a brand, shares and places with two decimals, an unknown place empty."""

    @F.pandas_udf("string")
    def digits(x: pd.Series) -> pd.Series:
        return x.map(lambda v: "" if pd.isna(v) else to_fixed(float(v), 2))

    two = lambda c: digits(F.col(c).cast("double"))
    return metrics.select(
        F.col("name").alias("Brand"), F.when(F.col("is_own"), "yes").otherwise("no").alias("Is own"), two("visibility").alias("Visibility %"), two("share_of_voice").alias("Share of Voice %"), F.col("mentions").alias("Mentions"),
        two("avg_position").alias("Avg position"), F.col("citations").alias("Citations"), two("source_visibility").alias("Source visibility %"), F.col("responses_present").alias("Responses present"), F.col("total").alias("Total responses"),
    )


def timeline_rows(matrix: DataFrame, kind: str) -> DataFrame:
    """The sheet of timelines from ``matrix_rows``: a row a prompt and name with its values in order of the captures, and the change."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"].cast("string"))
    df = matrix.groupBy("prompt_key", "name").agg(values.alias("v"), F.first("delta").alias("delta"))
    return df.select(F.col("prompt_key").alias("prompt"), F.lit(kind).alias("type"), "name", F.array_join("v", ",").alias("values"), "delta")


def csv_lines(df: DataFrame) -> DataFrame:
    """Column ``value``: each row as a line of quoted, formula-safe cells."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


#: What stands above the audit log.
AUDIT_PREAMBLE = ("Audit log", "Searches, cited and fetched sources and queries of every capture", "")


def audit_lines(records: DataFrame, zone: str = "UTC") -> DataFrame:
    """``line, value``: the audit log as CSV, with its preamble and its header; a row's line is its number and four."""
    log = D.audit_sheet(records, zone)
    head = [*AUDIT_PREAMBLE, ",".join('"' + c + '"' for c in D.AUDIT)]
    first = records.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, head))).alias("line", "value")).select((F.col("line") + 1).cast("long").alias("line"), "value")
    rows = log.select((F.col("#") + len(head)).alias("line"), F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in D.AUDIT]).alias("value"))
    return first.unionByName(rows)


def json_lines(df: DataFrame) -> DataFrame:
    """Column ``value``: each row as one JSON object; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """A folder of compressed JSON lines, which Spark reads back as they are."""
    df.write.json(path, compression=compression)


def write_csv(df: DataFrame, path: str, title: list[str] = ()) -> None:
    """A folder of CSV parts, each with the header; ``title`` lines go to a file of their own."""
    safe = df.select(*[F.when(F.col(f"`{c}`").cast("string").rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(f"`{c}`").cast("string"))).otherwise(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    safe.write.csv(path, header=True, quoteAll=True, escape='"')
    if title:
        df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, title))).alias("value")).coalesce(1).write.text(f"{path}-title")


def sheets(records: DataFrame) -> dict[str, DataFrame]:
    """The workbook's sheets, each a DataFrame of its own."""
    out = {"Summary": D.session_summary(records), "Audit Log": D.audit_log(records), "Source Analysis": D.source_analysis(records), "Domain Data": D.source_rows(records).select("capture_id", "domain", "outcome"), "Sources": D.source_rows(records), "Brand Mentions": D.mention_rows(records)}
    have = set(records.columns)
    if "fanout" in have:
        out["Fan-Out"] = D.fanout_rows(records)
    for name, array, fields in (("Products", "products", ["name", "price", "merchant", "rating", "reviews"]), ("Local Businesses", "places", ["name", "category", "rating", "address", "phone", "website"]), ("Entities", "entities", ["category", "text"])):
        if array in have:
            out[name] = D.sheet(records, array, fields)
    if "answer_text" in have:
        out["Answers"] = records.select("capture_id", "platform", "user_prompt", "answer_text")
    return out


def write_workbook(records: DataFrame, path: str) -> list[str]:
    """The sheets of the records as one workbook file; their names."""
    found = sheets(records)
    workbook.write_workbook(found, path)
    return list(found)


def footnotes(answer: str, sources: list[dict]) -> dict:
    """The answer with numbered footnotes: one number a source URL, by first citation; unresolved markers are listed."""
    by_marker = {m: s for s in sources or [] for m in s.get("marker_ids") or []}
    number: dict[str, int] = {}
    text, missing = [], []
    for seg in segments(answer or ""):
        if seg["type"] == "text":
            text.append(seg["value"])
        elif seg["type"] == "cite":
            for i in seg["ids"]:
                s = by_marker.get(i)
                if s is None:
                    missing.append(i)
                else:
                    text.append(f"[{number.setdefault(s['url'], len(number) + 1)}]")
        elif seg["name"]:
            text.append(seg["name"])
    cited = sorted(number, key=number.get)
    return {"text": "".join(text), "notes": cited, "unresolved": missing, "others": [s["url"] for s in sources or [] if s["url"] not in number]}


def markdown_html(text: str) -> str:
    """Headings one level down, tables, lists, bold and italic."""
    from ..functions.brands import table_row

    def inline(t: str) -> str:
        t = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", escape(t))
        return re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<em>\1</em>", t)

    out, lines, k = [], (text or "").split("\n"), 0
    while k < len(lines):
        line = lines[k]
        if m := re.match(r"(#{1,5})\s+(.*)", line):
            out.append(f"<h{len(m[1]) + 1}>{inline(m[2])}</h{len(m[1]) + 1}>")
        elif "|" in line and k + 1 < len(lines) and (cells := table_row(lines[k + 1])) and all(re.fullmatch(r":?-+:?", c) for c in cells):
            body = []
            k += 2
            while k < len(lines) and "|" in lines[k]:
                body.append("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in table_row(lines[k])) + "</tr>")
                k += 1
            out.append("<table><tr>" + "".join(f"<th>{inline(c)}</th>" for c in table_row(line)) + "</tr>" + "".join(body) + "</table>")
            continue
        elif m := re.match(r"\s*(?:[-*•]|(\d+)[.)])\s+(.*)", line):
            tag, items = ("ol" if m[1] else "ul"), []
            while k < len(lines) and (m := re.match(r"\s*(?:[-*•]|(\d+)[.)])\s+(.*)", lines[k])):
                items.append(f"<li>{inline(m[2])}</li>")
                k += 1
            out.append(f"<{tag}>{''.join(items)}</{tag}>")
            continue
        elif line.strip():
            out.append(f"<p>{inline(line)}</p>")
        k += 1
    return "".join(out)


def bound_documents(records: list[dict]) -> str:
    """A few conversations as one document with a table of contents; for many, ``documents`` makes one each where they are."""
    title = lambda r: escape(r.get("generated_title") or r.get("user_prompt") or "Conversation")
    contents = "".join(f"<li><a href='#c{k}'>{title(r)}</a></li>" for k, r in enumerate(records))
    bodies = "".join(f"<article id='c{k}'>{document(r).split('<body>')[1].split('</body>')[0]}</article>" for k, r in enumerate(records))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'></head><body><nav><ol>{contents}</ol></nav>{bodies}</body></html>"


def document(record: dict) -> str:
    """One conversation as a standalone HTML document."""
    model = footnotes(record.get("answer_text") or "", record.get("sources") or [])
    part = lambda title, items: f"<section><h2>{escape(title)}</h2><ul>{''.join(f'<li>{escape(str(i))}</li>' for i in items)}</ul></section>" if items else ""
    fan = [q["query"] for b in (record.get("fanout") or {}).values() for q in b or []]
    body = [f"<h1>{escape(record.get('generated_title') or record.get('user_prompt') or 'Conversation')}</h1>", markdown_html(model["text"]), part("Sources", model["notes"]), part("Other sources", model["others"]), part("Searches", fan), part("Brands", [f"{b['brand']} ({b['count']})" for b in record.get("brand_mentions") or []]), part("Products", [p.get("name") for p in record.get("products") or []]), part("Places", [p.get("name") for p in record.get("places") or []]), part("Entities", [e.get("text") for e in record.get("entities") or []])]
    return "<!DOCTYPE html><html><head><meta charset='utf-8'></head><body>" + "".join(body) + "</body></html>"


def documents(records: DataFrame) -> DataFrame:
    """``capture_id, html`` of each record, made where the records are."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([document(r) for r in b.to_pylist()], pa.string())], names=["capture_id", "html"])

    cols = [c for c in ("capture_id", "generated_title", "user_prompt", "answer_text", "sources", "fanout", "brand_mentions", "products", "places", "entities") if c in records.columns]
    return records.select(*cols).mapInArrow(run, "capture_id string, html string")


def diagnostics(raw: DataFrame, derived: DataFrame, runs: DataFrame) -> str:
    """Counts, times and failure labels only, nothing of what was captured; the newest 20 runs."""
    out = ["Storage", f"  raw captures: {raw.count()}", f"  derived captures: {derived.count()}", "Runs (newest 20)"]
    rows = runs.orderBy(F.desc(F.coalesce("started_at", F.lit(0)))).limit(20).collect()
    for r in rows:
        took = f"took {(r['finished_at'] - r['started_at']) // 1000} s" if r["finished_at"] and r["started_at"] else "not finished"
        failed = f", {r['failed']} failed" if r["failed"] else ""
        out.append(f"  {r['status']} · {'+'.join(r['engines'] or []) or '-'} · {r['captured'] or 0}/{r['expected'] or 0} captured{failed} · {took}")
        if r["reasons"]:
            out.append("    reasons: " + ", ".join(f"{k}: {n}" for k, n in sorted(r["reasons"].items())))
    return "\n".join(out if rows else [*out, "  none"])
