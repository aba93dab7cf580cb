"""Workbook files as a Spark data source, named ``workbook``.

Rows are ``path, sheet, row, cells``.  Reading has a partition a sheet, parsed as a stream.  Writing takes ``sheet, row, cells``: every task writes its
rows as fragments beside the target, the commit strings them together by row and gives the file its name in one step, and an
abort leaves neither file nor fragments.  Rows beyond what a sheet can hold go on in a further sheet, "name (2)", which has
no head of its own; ``continued`` gives such sheets the name of the one that they continue.

Files are opened with Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, sheet string, row bigint, cells array<string>"
#: Rows that a sheet can hold.
SHEET_ROWS = 1_048_576
#: Rows of a fragment at most.
FRAGMENT_ROWS = 65_536
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Characters that XML has no form for.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(node) -> str:
    """All text runs of a node, phonetic ones aside."""
    if _local(node) == "rPh":
        return ""
    return (node.text or "") if _local(node) == "t" else "".join(map(_text, node))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and entries of the sheets in the order of the workbook; without a list of them, the entries by number."""
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        target = {e.get("Id"): e.get("Target").removeprefix("/xl/") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = [(e.get("name"), "xl/" + target.get(e.get(f"{{{_DOC}}}id"), "")) for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"]
        if found and all(entry in names for _, entry in found):
            return found
    entries = [n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
    return [(n.rsplit("/", 1)[1].removesuffix(".xml"), n) for n in sorted(entries, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])]


def rows_of(z: zipfile.ZipFile, entry: str) -> Iterator[list[str]]:
    """Cells of a sheet row by row: shared, rich and inline strings, numbers as written; gaps are empty.  Stored and deflated entries are read, other methods raise."""
    for i in z.infolist():
        if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"compression method {i.compress_type} of {i.filename}")
    shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(e) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    with z.open(entry) as f:
        for _, r in ElementTree.iterparse(f):
            if _local(r) != "row":
                continue
            cells: dict[int, str] = {}
            for k, c in enumerate(e for e in r if _local(e) == "c"):
                kind = (c.get("t") or "").lower()
                value = next((e.text or "" for e in c if _local(e) == "v"), "")
                cells[_column(c.get("r")) if c.get("r") else k] = _text(c) if kind == "inlinestr" else shared[int(value)] if kind == "s" and value else value
            yield [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]
            r.clear()


def row_xml(cells: list) -> str:
    """A row of inline strings."""
    told = (escape(_NO_XML.sub("", c or "")).replace("\r", "&#13;") for c in cells)
    return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{c}</t></is></c>' for c in told) + "</row>"


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    entry: str


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path)

    def partitions(self) -> list[Sheet]:
        info = self.fs.get_file_info(self.path)
        found = self.fs.get_file_info(pafs.FileSelector(self.path, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        paths = sorted(i.path for i in found if i.type == pafs.FileType.File and i.path.lower().endswith(".xlsx"))
        return [Sheet(p, *s) for p in paths for s in self._with(p, sheets_of)]

    def _with(self, path: str, f):
        with self.fs.open_input_file(path) as file, zipfile.ZipFile(file) as z:
            return f(z)

    def read(self, partition: Sheet) -> Iterator[tuple]:
        with self.fs.open_input_file(partition.path) as file, zipfile.ZipFile(file) as z:
            for k, cells in enumerate(rows_of(z, partition.entry)):
                yield partition.path, partition.name, k, cells


@dataclass
class Written(WriterCommitMessage):
    #: Sheet, first row, fragment and number of rows.
    fragments: list[tuple[str, int, str, int]]


class Writer(DataSourceWriter):
    """One file.  ``sheets`` names the sheets in their order (others follow by name)."""

    def __init__(self, path: str, sheets: list[str], overwrite: bool):
        self.path, self.sheets, self.overwrite = path, sheets, overwrite
        self.folder = f"{path}.{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        fs, folder = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(folder)
        out: list[tuple[str, int, str, int]] = []
        file, last = None, None
        for r in iterator:
            if last is None or r["sheet"] != last[0] or r["row"] < last[1] or out[-1][3] == FRAGMENT_ROWS:  # a fragment holds ascending rows of one sheet
                if file:
                    file.close()
                name = f"{folder}/{uuid.uuid4().hex}"
                file = fs.open_output_stream(name)
                out.append((r["sheet"], r["row"], name, 0))
            file.write(row_xml(r["cells"] or []).encode())
            last = r["sheet"], r["row"]
            out[-1] = (*out[-1][:3], out[-1][3] + 1)
        if file:
            file.close()
        return Written(out)

    def _named(self, messages) -> list[tuple[str, list[tuple[str, int]]]]:
        """Sheets of the file with their fragments; a sheet that would hold too many rows goes on in another."""
        found: dict[str, list] = {s: [] for s in self.sheets}
        for sheet, first, name, n in sorted(x for m in messages if m for x in m.fragments):
            found.setdefault(sheet, []).append((name, n))
        out = []
        for sheet, fragments in found.items():
            parts, rows = [[]], 0
            for name, n in fragments:
                if rows + n > SHEET_ROWS:
                    parts.append([])
                    rows = 0
                parts[-1].append((name, n))
                rows += n
            if any(n > SHEET_ROWS for _, n in fragments):
                raise ValueError(f"a partition of sheet {sheet} holds more than {SHEET_ROWS} rows")
            out += [((sheet if not k else f"{sheet[:25]} ({k + 1})")[:31], p) for k, p in enumerate(parts)]
        return out or [("Sheet1", [])]

    def commit(self, messages) -> None:
        fs, target = pafs.FileSystem.from_uri(self.path)
        if not self.overwrite and fs.get_file_info(target).type != pafs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{target} exists")
        whole = f"{pafs.FileSystem.from_uri(self.folder)[1]}.xlsx"
        sheets = self._named(messages)
        with fs.open_output_stream(whole) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            numbers = range(1, len(sheets) + 1)
            z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in numbers) + "</Types>")
            z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{k}" r:id="r{k}"/>' for k, (s, _) in zip(numbers, sheets, strict=True)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{_DOC}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>")
            for k, (_, fragments) in zip(numbers, sheets, strict=True):
                with z.open(f"xl/worksheets/sheet{k}.xml", "w") as out:
                    out.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    for name, _ in fragments:
                        with fs.open_input_stream(name) as part:
                            while block := part.read(io.DEFAULT_BUFFER_SIZE * 64):
                                out.write(block)
                    out.write(b"</sheetData></worksheet>")
        fs.move(whole, target)
        self.abort(messages)

    def abort(self, messages) -> None:
        """Fragments go, of tasks that never reported, too."""
        fs, folder = pafs.FileSystem.from_uri(self.folder)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        names = self.options.get("sheets", "")
        return Writer(self.options["path"], names.split("\n") if names else [], overwrite)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet, row, cells`` of every sheet of a workbook, or of all workbooks below a folder."""
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").load(path)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One workbook of these sheets, in their order, each with its column names first.  Nested values are written as JSON; a cell that looks like a formula gets an apostrophe."""
    parts = []
    for k, (name, df) in enumerate(sheets.items()):
        own = [(F.to_json(f"`{c}`") if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`").cast("string")) for c, t in df.dtypes]
        safe = [F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(F.coalesce(c, F.lit(""))) for c in own]
        head = df.sparkSession.range(1).select(F.lit(k).alias("_k"), F.lit(name).alias("sheet"), F.lit(-1).cast("long").alias("row"), F.array(*map(F.lit, df.columns)).cast("array<string>").alias("cells"))
        # Ascending within a partition and from one to the next, so fragments follow each other.
        parts += [head, df.select(F.lit(k).alias("_k"), F.lit(name).alias("sheet"), F.monotonically_increasing_id().alias("row"), F.array(*safe).cast("array<string>").alias("cells"))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both.sparkSession.dataSource.register(Workbook)
    both.sortWithinPartitions("_k", "row").select("sheet", "row", "cells").write.format("workbook").option("sheets", "\n".join(sheets)).mode("overwrite").save(path)


def continued(df: DataFrame, sheets: list[str]) -> DataFrame:
    """Rows of a workbook that ``write_workbook`` wrote of these sheets: what went on in a further sheet is of the sheet that it continues."""
    own = F.lit(None).cast("string")
    for name in sheets:
        further = F.startswith(F.col("sheet"), F.lit(f"{name[:25]} (")) & F.substring("sheet", len(name[:25]) + 2, 31).rlike(r"^\([0-9]+\)$")
        own = F.coalesce(own, F.when(further & ~F.col("sheet").isin(*sheets), name))
    return df.withColumn("sheet", F.coalesce(own, "sheet"))
