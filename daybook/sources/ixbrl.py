"""Tagged facts in filing documents: one Spark job over a table of documents."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from daybook.functions.exprs import parse_number

_FACT = (
    "raw_concept string, context_ref string, unit_ref string, raw_value string, scale string, sign string, "
    "start string, end string, dimensions map<string,string>"
)


class _Tags(HTMLParser):
    """Collects contexts and tagged facts of one document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.contexts: dict[str, dict] = {}
        self.facts: list[dict] = []
        self._ctx: dict | None = None
        self._field: str | None = None
        self._axis: str | None = None
        self._open: list[tuple[str, dict]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(attrs)
        if tag.endswith("context") and a.get("id"):
            self._ctx = {"instant": None, "start": None, "end": None, "dimensions": {}}
            self.contexts[a["id"]] = self._ctx
        elif self._ctx is not None:
            for suffix, field in (("instant", "instant"), ("startdate", "start"), ("enddate", "end")):
                if tag.endswith(suffix):
                    self._field = field
            if tag.endswith("explicitmember"):
                self._field, self._axis = "member", (a.get("dimension") or "").split(":")[-1]
        if ("nonfraction" in tag or "nonnumeric" in tag) and a.get("name"):
            fact = {
                "raw_concept": a["name"], "context_ref": a.get("contextref"), "unit_ref": a.get("unitref"),
                "scale": a.get("scale"), "sign": a.get("sign"), "text": [],
            }
            self.facts.append(fact)
            self._open.append((tag, fact))

    def handle_endtag(self, tag: str) -> None:
        if tag.endswith("context"):
            self._ctx = None
        if tag.endswith(("instant", "startdate", "enddate", "explicitmember")):
            self._field = None
        if self._open and self._open[-1][0] == tag:
            self._open.pop()

    def handle_data(self, data: str) -> None:
        t = data.strip()
        if not t:
            return
        for _, fact in self._open:
            fact["text"].append(t)
        if self._ctx is None or self._field is None:
            return
        if self._field == "member":
            if self._axis:
                self._ctx["dimensions"][self._axis] = t.split(":")[-1]
        elif self._ctx[self._field] is None:
            self._ctx[self._field] = t


def _rows(doc: object, html: str) -> list[tuple]:
    p = _Tags()
    p.feed(html or "")
    p.close()
    none = {"instant": None, "start": None, "end": None, "dimensions": {}}
    out = []
    for f in p.facts:
        c = p.contexts.get(f["context_ref"], none)
        out.append(
            (
                doc, f["raw_concept"], f["context_ref"], f["unit_ref"], " ".join(f["text"]), f["scale"], f["sign"],
                c["start"], c["instant"] or c["end"], list(c["dimensions"].items()),
            )
        )
    return out


def parse_ixbrl(docs: DataFrame, doc_id: str, html: str) -> DataFrame:
    """One row per tagged fact, with its context's dates and dimensions.

    Python only tokenises one document at a time; dates and numbers are Spark columns.
    """
    schema = f"{doc_id} {dict(docs.dtypes)[doc_id]}, {_FACT}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for d, text in zip(b[0].to_pylist(), b[1].to_pylist()) for r in _rows(d, text)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow
                )

    rows = docs.select(doc_id, html).mapInArrow(run, schema)
    start, end = F.try_to_date(F.col("start")), F.try_to_date(F.col("end"))
    return rows.select(
        doc_id,
        F.element_at(F.split("raw_concept", ":"), -1).alias("concept"),
        "raw_concept", "context_ref", "unit_ref", "raw_value",
        parse_number("raw_value", "scale", "sign").alias("value"),
        start.alias("start_date"),
        end.alias("end_date"),
        F.datediff(end, start).alias("duration_days"),
        "dimensions",
    )
