"""Inline citations as numbered footnotes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.brands import CLOSE, MID, OPEN

#: A citation in an answer: one or more reference ids between its marks.
ID = r"turn\d+[a-z]+\d+"
CITE = f"{OPEN}cite(?:{MID}{ID})+{CLOSE}?"
_ID, _CITE = re.compile(ID, re.A), re.compile(CITE, re.A)


def cited(answer: str, sources: list[dict]) -> tuple[str, list[str], list[str], list[str | None]]:
    """Text, notes, unresolved and others of one record: a marker names the last source that has it, an address is numbered by its first citation."""
    of = {m: s["url"] for s in sources for m in s["marker_ids"] or []}
    numbers: dict[str, int] = {}
    unresolved: list[str] = []

    def mark(found: re.Match) -> str:
        out = []
        for m in _ID.findall(found[0]):
            url = of.get(m)
            if url is None:
                unresolved.append(m)
            else:
                out.append(f"[{numbers.setdefault(url, len(numbers) + 1)}]")
        return "".join(out)

    text = _CITE.sub(mark, answer)
    return text, list(numbers), unresolved, [u for u in dict.fromkeys(s["url"] for s in sources) if u not in numbers]


def footnoted(records: DataFrame) -> DataFrame:
    """A row a record with an answer: ``capture_id, text`` (the answer with ``[number]`` for its citations), ``notes`` (addresses by number), ``unresolved`` (markers without a source, in order) and ``others`` (sources that no note names, in their order).

    What a footnote does not replace is left as it is; a marker without a source leaves nothing.  Everything is inside the record: one Arrow pass, no shuffle.
    """
    import pyarrow as pa

    many = pa.list_(pa.string())

    def run(batches):
        for b in batches:
            texts, sources = b.column(1).to_pylist(), b.column(2).to_pylist()
            keep = [k for k, t in enumerate(texts) if t]
            rows = [cited(texts[k], [s for s in sources[k] or [] if s is not None]) for k in keep]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(columns[0], pa.string()), *[pa.array(c, many) for c in columns[1:]]], names=["capture_id", "text", "notes", "unresolved", "others"])

    kind = records.schema["capture_id"].dataType.simpleString()
    own = "transform(sources, s -> struct(s.url as url, s.marker_ids as marker_ids)) as sources"
    return records.selectExpr("capture_id", "answer_text", own).mapInArrow(run, f"capture_id {kind}, text string, notes array<string>, unresolved array<string>, others array<string>")
