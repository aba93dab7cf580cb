"""Prompt import: delimited text and workbook files to prompts with tags."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession

from .workbook import rows_of, sheets_of

#: Headers of the prompt column, and of the tag column in order of preference.
PROMPT_HEADERS = ("prompt", "prompts", "query", "queries")
TAG_HEADERS = ("tags", "tag", "industry", "category", "industry category", "label", "labels", "topic", "segment")
PROMPT_SCHEMA = "text string, tags array<string>"


def sniff(first_line: str) -> str:
    return "\t" if first_line.count("\t") > first_line.count(",") else ","


def parse_delimited(text: str, sep: str | None = None) -> list[list[str]]:
    """Rows of cells: quotes may hold separators and line breaks, doubled quotes stand for one, blank rows go."""
    sep = sep or sniff(text.split("\n", 1)[0])
    rows, row, cell, quoted, k = [], [], [], False, 0
    while k < len(text):
        c = text[k]
        if quoted:
            if c == '"' and text[k + 1 : k + 2] == '"':
                cell.append(c)
                k += 1
            elif c == '"':
                quoted = False
            else:
                cell.append(c)
        elif c == '"':
            quoted = True
        elif c == sep or c == "\n":
            row.append("".join(cell))
            cell = []
            if c == "\n":
                rows.append(row)
                row = []
        elif c != "\r":
            cell.append(c)
        k += 1
    rows.append([*row, "".join(cell)])
    return [r for r in rows if any(c.strip() for c in r)]


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """The same as a Spark source, for files that don't fit the driver: columns ``_c0`` and on."""
    head = spark.read.text(path).limit(1).collect()
    sep = sniff(head[0][0] if head else "")
    return spark.read.csv(path, sep=sep, quote='"', escape='"', multiLine=True).na.drop("all")


def parse_workbook(data: bytes) -> list[list[str]]:
    """Cells of the first worksheet; ragged rows are padded, blank ones go."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheets = sheets_of(z)
        if not sheets:
            raise ValueError("no worksheet")
        rows = [r for r in rows_of(z, sheets[0][1]) if any(c.strip() for c in r)]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def rows_to_prompts(rows: list[list[str]]) -> list[dict]:
    """Prompts by header names; without a known header the first two columns."""
    if not rows:
        return []
    head = [c.strip().lower() for c in rows[0]]
    at = next((k for k, h in enumerate(head) if h in PROMPT_HEADERS), None)
    tag = 1
    if at is not None:
        tag = next((head.index(h) for h in TAG_HEADERS if h in head), at + 1 if at + 1 < len(head) else None)
    out = []
    for r in rows[at is not None :]:
        cell = lambda k: r[k].strip() if k is not None and k < len(r) else ""  # noqa: B023, E731
        if text := cell(at or 0):
            out.append({"text": text, "tags": [t.strip() for t in re.split("[,;|]", cell(tag)) if t.strip()]})
    return out


def parse_lines(text: str) -> list[dict]:
    """Manual entry: a prompt a line, tags after the first comma."""
    out = []
    for line in text.split("\n"):
        first, *rest = line.split(",")
        if first.strip():
            out.append({"text": first.strip(), "tags": [t.strip() for t in rest if t.strip()]})
    return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of all workbook files under ``path``: ``path, text, tags``; each file is read where it is."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            got = [{"path": p, **x} for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in rows_to_prompts(parse_workbook(c))]
            yield pa.RecordBatch.from_pylist(got, schema=pa.schema([("path", pa.string()), ("text", pa.string()), ("tags", pa.list_(pa.string()))]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string, tags array<string>")
