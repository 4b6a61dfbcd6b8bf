"""Document text, section extraction, payloads and scored replies."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from daybook.functions.ranking import quantiles_of_many

# fixed values: section markers per form (start, end, may run to the end of the text)
MARKERS = {
    "annual": {
        "business": (r"item\s*1(?!\s*[0-9a-c])", r"item\s*1\s*a\b", False),
        "risk": (r"item\s*1\s*a\b", r"item\s*(1\s*b|2)\b", False),
        "discussion": (r"item\s*7(?!\s*[0-9a])", r"item\s*(7\s*a|8)\b", False),
    },
    "quarterly": {"discussion": (r"item\s*2\b", r"item\s*(3|4)\b", True)},
    "foreign_annual": {
        "discussion": (r"item\s*5\b", r"item\s*6\b", False),
        "business": (r"item\s*4\b(?!\s*a)", r"item\s*(4\s*a|5)\b", False),
        "risk": (r"(item\s*3\s*\.?\s*d|risk\s+factors)", r"item\s*4\b", False),
    },
}
TITLE_START = r"management.?s\s+discussion\s+and\s+analysis"
TITLE_END = (
    r"(quantitative\s+and\s+qualitative\s+disclosures|report\s+of\s+(the\s+)?independent\s+registered|"
    r"consolidated\s+(balance\s+sheet|statements?\s+of|financial\s+statements)|critical\s+accounting\s+estimates\s+report)"
)
MIN_SECTION_CHARS = 3000
BUDGET_CHARS = 50_000
SECTION_CAPS = {"discussion": 50_000, "risk": 10_000, "business": 4_000}
TITLES = {"discussion": "MD&A", "risk": "RISK FACTORS", "business": "BUSINESS"}
SECTIONS = list(TITLES)
SLICE = 200  # documents that Python holds beside their Arrow batch


class _Text(HTMLParser):
    """Text nodes outside script and style. A node ends at a tag or comment; the parser may hand it over in pieces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self._node: list[str] = []
        self._skip = 0

    def end_node(self, *_) -> None:
        if self._node:
            self.parts.append("".join(self._node))
            self._node = []

    handle_comment = handle_decl = handle_pi = unknown_decl = end_node

    def handle_starttag(self, tag: str, attrs) -> None:
        self.end_node()
        self._skip += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.end_node()
        if tag in ("script", "style") and self._skip:
            self._skip -= 1

    def handle_data(self, data: str) -> None:
        if not self._skip:
            self._node.append(data)


def _nodes(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    p.end_node()
    return "\n".join(p.parts)


def tidy_text(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, " ", " "), r"[ \t]+", " ")
    return F.regexp_replace(c, r"\n\s*\n+", "\n")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def html_to_text(docs: DataFrame, html: str, out: str = "text") -> DataFrame:
    """Replace the markup column by its text. Python reads one document at a time and passes
    the other columns through; whitespace rules are Spark expressions."""
    keep = [c for c in docs.columns if c != html]
    schema = StructType([docs.schema[c] for c in keep]).add(out, "string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                texts = pa.array([_nodes(h) for h in b.column(len(keep)).to_pylist()], pa.string())
                cols = [b.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, texts], schema=arrow)

    return docs.select(*keep, html).mapInArrow(run, schema).withColumn(out, tidy_text(F.col(out)))


def _longest(text: str, start: re.Pattern, end: re.Pattern, eof: bool) -> tuple[int, int] | None:
    ends = [m.start() for m in end.finditer(text)]
    best = None
    for m in start.finditer(text):
        s = m.start()
        i = bisect_right(ends, s)
        e = ends[i] if i < len(ends) else len(text) if eof else None
        if e is not None and e > s and (best is None or e - s > best[1] - best[0]):
            best = (s, e)
    return best


def longest_section(text: Column, start: str, end: str, allow_eof: bool = False) -> Column:
    """Struct (start, end, section): longest slice from a start marker to its next end marker."""
    a, b = re.compile(start, re.I), re.compile(end, re.I)

    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hit = _longest(t, a, b, allow_eof) if t else None
            rows.append((hit[0], hit[1], t[hit[0] : hit[1]].strip()) if hit else (None, None, ""))
        out = pd.DataFrame(rows, columns=["start", "end", "section"])
        return out.astype({"start": "Int32", "end": "Int32"})

    @F.pandas_udf("start int, end int, section string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                yield found(whole.iloc[at : at + SLICE])

    return find(text)


def extract_sections(docs: DataFrame, text: str, form: str, markers: Mapping = MARKERS) -> DataFrame:
    """One column per section by the marker pairs of the row's form; absent ones are empty."""
    pairs: dict[str, list[tuple[str, tuple]]] = {s: [] for s in SECTIONS}
    for f, secs in markers.items():
        for s, m in secs.items():
            pairs[s].append((f, m))
    compiled = {
        s: {f: (re.compile(m[0], re.I), re.compile(m[1], re.I), m[2]) for f, m in fs} for s, fs in pairs.items()
    }

    names = docs.columns
    schema = StructType(list(docs.schema.fields))
    for s in SECTIONS:
        schema = schema.add(s, "string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                out: dict[str, list[str]] = {s: [] for s in SECTIONS}
                for t, f in zip(b.column(names.index(text)).to_pylist(), b.column(names.index(form)).to_pylist()):
                    for s in SECTIONS:
                        m = compiled[s].get(f)
                        hit = _longest(t, *m) if m and t else None
                        out[s].append(t[hit[0] : hit[1]].strip() if hit else "")
                cols = [b.column(i).cast(arrow.field(i).type) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(out[s], pa.string()) for s in SECTIONS]], schema=arrow)

    return docs.mapInArrow(run, schema)


def is_exhibit(name: Column) -> Column:
    n = F.regexp_replace(F.lower(name), r"[-_ ]", "")
    return n.contains("ex13") | n.contains("exhibit13")


def fallback_section(docs: DataFrame, siblings: DataFrame, key: str, text: str, form: str, minimum: int = MIN_SECTION_CHARS) -> DataFrame:
    """Discussion from the primary markers, else a title heading in the same document, else a
    sibling exhibit, else none. Foreign annual reports have no fallback.

    ``siblings`` holds (key, name, text). The text found and where it came from are added.
    """
    own = docs.withColumn("_title", longest_section(F.col(text), TITLE_START, TITLE_END, True)["section"])
    ex = siblings.filter(is_exhibit(F.col("name"))).withColumn("_t", longest_section(F.col("text"), TITLE_START, TITLE_END, True)["section"])
    best = ex.filter(F.length("_t") >= minimum).groupBy(key).agg(F.min_by("_t", "name").alias("_ex"))
    j = own.join(best, key, "left")
    may = F.col(form) != "foreign_annual"
    kind = (
        F.when(F.length("discussion") >= minimum, "primary")
        .when(may & (F.length("_title") >= minimum), "primary_title")
        .when(may & F.col("_ex").isNotNull(), "exhibit")
        .otherwise("none")
    )
    j = j.withColumn("section_source", kind)
    chosen = F.when(F.col("section_source") == "primary_title", F.col("_title")).when(F.col("section_source") == "exhibit", F.col("_ex")).otherwise(F.col("discussion"))
    rest = [c for c in docs.columns if c != "discussion"]
    return j.select(*rest, chosen.alias("discussion"), "section_source")


def build_payload(df: DataFrame, caps: Mapping[str, int] = SECTION_CAPS, budget: int = BUDGET_CHARS) -> DataFrame:
    """Sections in priority order under one character budget; cuts set ``truncated``."""
    used: Column = F.lit(0)
    cut: Column = F.lit(False)
    out = df
    blocks = []
    for s in SECTIONS:
        header = f"=== {TITLES[s]} ===\n"
        text = F.coalesce(F.col(s), F.lit(""))
        room = F.least(F.lit(caps[s]), F.lit(budget) - used) - len(header)
        has = F.length(text) > 0
        out = out.withColumn(f"_b_{s}", F.when(has & (room > 0), F.concat(F.lit(header), F.substring(text, F.lit(1), room))))
        out = out.withColumn(f"_c_{s}", has & ((room <= 0) | (F.length(text) > room)))
        used = used + F.coalesce(F.length(F.col(f"_b_{s}")), F.lit(0))
        cut = cut | F.col(f"_c_{s}")
        blocks.append(F.col(f"_b_{s}"))
    return out.select(*df.columns, F.concat_ws("\n\n", *blocks).alias("payload"), cut.cast("int").alias("truncated"))


Scorer = Callable[[str, str, str], str | None]


def score_documents(df: DataFrame, scorer: Scorer, key: str, payload: str, form: str, as_of: str, votes: int = 1) -> DataFrame:
    """Replies of a caller-supplied scorer, batch by batch: (key, replies, error).

    The scorer sees the payload, the form and the as-of date only. An exception of one
    document becomes its ``error`` and does not stop the batch.
    """
    keep = df.schema[key]
    schema = StructType([keep]).add("replies", ArrayType(StringType())).add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies, errors = [], []
            for p, f, a in zip(b["_p"], b["_f"], b["_a"]):
                got, err = [], None
                for _ in range(votes):
                    try:
                        got.append(scorer(p, f, a))
                    except Exception as exc:  # noqa: BLE001
                        err = str(exc)
                replies.append(got)
                errors.append(err)
            yield pd.DataFrame({key: b[key], "replies": replies, "error": errors})

    cols = df.select(key, F.col(payload).alias("_p"), F.col(form).alias("_f"), F.col(as_of).cast("string").alias("_a"))
    return cols.mapInPandas(run, schema)


def aggregate_vote_rows(votes: DataFrame, keys: Sequence[str], vote: str, replied: Column) -> DataFrame:
    """The same for one row per vote: exact median per key without gathering its votes.

    ``replied`` tells per row whether a reply came at all.
    """
    med = quantiles_of_many(votes, keys, vote, {"score_raw": 0.5})
    seen = votes.groupBy(*keys).agg(F.max(replied.cast("int")).alias("_r"))
    status = F.when(F.col("score_raw").isNotNull(), "scored").when(F.col("_r") == 1, "missing").otherwise("error")
    return seen.join(med, list(keys), "left").select(
        *keys, "score_raw", ((F.col("score_raw") - 1) / 4).alias("score"), status.alias("status")
    )


def aggregate_votes(df: DataFrame, votes: str = "votes", any_reply: Column | None = None) -> DataFrame:
    """Median of the valid votes, rescaled to 0..1; none valid is ``missing`` or ``error``."""
    v = F.array_sort(F.filter(F.col(votes), lambda x: x.isNotNull()))
    n = F.size(v)
    half = F.floor(n / 2).cast("int")
    hi = F.get(v, half)
    lo = F.get(v, F.when(n % 2 == 0, half - 1).otherwise(half))
    med = (lo + hi) / F.lit(2.0)
    replied = F.lit(True) if any_reply is None else any_reply
    status = F.when(n > 0, "scored").when(replied, "missing").otherwise("error")
    return df.withColumns({"score_raw": med, "score": (med - 1) / 4, "status": status})


def todo(reports: DataFrame, scored: DataFrame, key: str = "accession") -> DataFrame:
    return reports.join(scored.filter("status = 'scored'").select(key), key, "left_anti")


def scoring_reports(facts: DataFrame, source: str, keys: Sequence[str] = ("entity", "release_date", "accession"), rest: Sequence[str] = ("period_end", "form")) -> DataFrame:
    own = facts.filter((F.col("source") == source) & F.col(keys[1]).isNotNull())
    return own.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest])


def resolve_ids(local: DataFrame, directory: DataFrame, width: int = 10) -> DataFrame:
    """Local id -> listing id -> padded registry id; unmatched ids drop out."""
    j = local.select("local_id", F.upper("listing_id").alias("_k")).join(
        directory.select(F.upper("listing_id").alias("_k"), "registry_id"), "_k"
    )
    return j.select("local_id", F.lpad(F.col("registry_id").cast("string"), width, "0").alias("registry_id"))


def filings_since(filings: DataFrame, ids: DataFrame, form: str, since_year: int | None = None) -> DataFrame:
    own = filings.join(ids, "registry_id").filter(F.col("form") == form)
    return own if since_year is None else own.filter(F.year("filed") >= since_year)


def score_counts(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("truncated").alias("n_truncated"))
