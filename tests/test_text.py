from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from daybook.functions.exprs import parse_number, parse_score
from daybook.operators import sections as sx
from daybook.sources import filings as fl
from daybook.sources.ixbrl import parse_ixbrl


def test_parse_number(spark):
    cases = [
        ("$1,234.50", None, None, 1234.5), ("(12)", "6", None, -12e6), ("−3.5", None, None, -3.5), (" 7 ", None, None, 7.0),
        ("", None, None, None), ("-", None, None, None), ("n/a", None, None, None), ("5", "x", "-", -5.0), ("1.2.3", None, None, None), ("2", "-2", None, 0.02),
    ]
    df = spark.createDataFrame([(i, a, b, c) for i, (a, b, c, _) in enumerate(cases)], "i int, t string, s string, g string")
    got = {r.i: r.v for r in df.select("i", parse_number("t", "s", "g").alias("v")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == c[3] or abs(got[i] - c[3]) < 1e-9, c


def test_parse_score(spark):
    cases = [
        ("4", 4), ("<think>5 or 1\n2</think>\n 3 ", 3), ("Reason 2\n4\nbye 1", 4), ("I give 2 of 5", 2), ("7", None), ("10 points", None), ("é3", None), (None, None), ("1\n5\n", 5),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", parse_score("t").alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def slow_section(text, start, end, eof):
    best = ""
    ends = [m.start() for m in re.finditer(end, text, re.I)]
    for m in re.finditer(start, text, re.I):
        later = [e for e in ends if e > m.start()]
        stop = min(later) if later else len(text) if eof else None
        if stop is not None and stop - m.start() > len(best):
            best = text[m.start() : stop]
    return best.strip()


def test_longest_section(spark):
    texts = [
        "item 7 toc item 8 toc\nItem 7. Real body text here\nItem 8. End", "item 7 never ends", "nothing", "", "ITEM 7 a\nitem 7 bb item 8 item 7 ccc item 7a", "item 70 item 8",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for eof in (False, True):
        s, e = r"item\s*7(?!\s*[0-9a])", r"item\s*(7\s*a|8)\b"
        got = {r.i: r.x for r in df.select("i", sx.longest_section(F.col("t"), s, e, eof)["section"].alias("x")).collect()}
        assert [got[i] for i in range(len(texts))] == [slow_section(t, s, e, eof) for t in texts]


def test_html_to_text(spark):
    html = "<html><style>p{}</style><body><p>A&nbsp;&amp;  b\t c</p>\n\n <script>var t='<p>';</script><div>d &lt;e&gt;</div><!-- no --></body></html>"
    df = spark.createDataFrame([(1, html), (2, None)], "i int, html string")
    got = {r.i: r.text for r in sx.html_to_text(df, "html").collect()}
    assert got[1] == "A & b c\nd <e>" and got[2] is None


def test_fallback_and_payload(spark):
    long = "x" * 3100
    title = "Management's discussion and analysis " + long
    docs = [(1, "annual", long, ""), (2, "annual", "short", title), (3, "annual", "", ""), (4, "foreign_annual", "", title), (5, "annual", "", "")]
    d = spark.createDataFrame(docs, "k int, form string, discussion string, text string")
    sib = spark.createDataFrame([(3, "d-ex_13.htm", title), (5, "ex21.htm", title)], "k int, name string, text string")
    got = {r.k: r.section_source for r in sx.fallback_section(d, sib, "k", "text", "form").collect()}
    assert got == {1: "primary", 2: "primary_title", 3: "exhibit", 4: "none", 5: "none"}
    p = spark.createDataFrame([(1, "d" * 30, "r" * 50, "b" * 9), (2, "", None, "b"), (3, "d" * 200, "r", "b")], "k int, discussion string, risk string, business string")
    out = {r.k: r for r in sx.build_payload(p, {"discussion": 100, "risk": 40, "business": 30}, 110).collect()}
    assert out[1].payload == "=== MD&A ===\n" + "d" * 30 + "\n\n=== RISK FACTORS ===\n" + "r" * 19 + "\n\n=== BUSINESS ===\n" + "b" * 9
    assert out[1].truncated == 1 and out[2].payload == "=== BUSINESS ===\nb" and out[2].truncated == 0
    assert out[3].payload == "=== MD&A ===\n" + "d" * 87 and out[3].truncated == 1


def test_scorer_and_votes(spark):
    def scorer(payload, form, as_of):
        if payload == "bad":
            raise ValueError("down")
        return payload

    df = spark.createDataFrame([(1, "3"), (2, "bad"), (3, "none"), (4, "5")], "k int, p string").withColumns({"f": F.lit("annual"), "d": F.lit("2024-01-01")})
    r = sx.score_documents(df, scorer, "k", "p", "f", "d", votes=2)
    v = r.withColumn("votes", F.transform("replies", lambda x: parse_score(x)))
    got = {x.k: (x.status, x.score_raw, x.score, x.error) for x in sx.aggregate_votes(v, "votes", F.size("replies") > 0).collect()}
    assert got[1] == ("scored", 3.0, 0.5, None) and got[4][2] == 1.0
    assert got[2] == ("error", None, None, "down") and got[3][0] == "missing"
    m = spark.createDataFrame([([2, None, 5],), ([None],), ([1, 2, 5],)], "votes array<int>")
    assert [x.score_raw for x in sx.aggregate_votes(m).collect()] == [3.5, None, 2.0]


def test_ixbrl(spark):
    html = """<ix:header><xbrli:context id="c1"><xbrldi:explicitMember dimension="a:SegAxis">a:West</xbrldi:explicitMember>
    <xbrli:startDate>2020-01-01</xbrli:startDate><xbrli:endDate>2020-03-31</xbrli:endDate></xbrli:context>
    <xbrli:context id="c2"><xbrli:instant>2020-12-31</xbrli:instant></xbrli:context></ix:header>
    <p><ix:nonFraction name="us-gaap:Revenues" contextRef="c1" scale="6" unitRef="usd">(1,<b>234</b>)</ix:nonFraction>
    <ix:nonFraction name="x:Cash" contextRef="c2" sign="-">5</ix:nonFraction><ix:nonFraction name="x:Lost" contextRef="zz">9</ix:nonFraction></p>"""
    df = spark.createDataFrame([("d1", html), ("d2", None)], "doc string, html string")
    got = {r.concept: r for r in parse_ixbrl(df, "doc", "html").collect()}
    r = got["Revenues"]
    assert (r.value, str(r.start_date), str(r.end_date), r.duration_days, r.dimensions) == (-1234e6, "2020-01-01", "2020-03-31", 90, {"SegAxis": "West"})
    assert got["Cash"].value == -5.0 and str(got["Cash"].end_date) == "2020-12-31" and got["Cash"].dimensions == {}
    assert got["Lost"].end_date is None


def test_dimension_rules(spark):
    rows = [(1, {"A": "x", "B": "y"}), (2, {"A2": "x", "B": "y"}), (3, {"A": "x"}), (4, {}), (5, {"A": "z", "B": "y"})]
    df = spark.createDataFrame(rows, "i int, dimensions map<string,string>")
    need = F.expr("array(named_struct('axes', array('A','A2'), 'members', array('x')), named_struct('axes', array('B'), 'members', array('y','w')))")
    assert sorted(r.i for r in fl.filter_dimensions(df, need).collect()) == [1, 2]
    assert [r.i for r in fl.filter_dimensions(df, F.lit(None)).collect()] == [4]


def test_text_node_with_a_bare_sign(spark):
    html = "<p>margin < 5 % &amp; rising</p>a<!-- note -->b<script>x < 1</script><br>c &lt; d"
    got = sx.html_to_text(spark.createDataFrame([(html,)], "html string"), "html").first().text
    assert got.split("\n") == ["margin < 5 % & rising", "a", "b", "c < d"]


def test_unreadable_documents_are_kept_apart(spark):
    good = '{"us-gaap":{"Revenue":{"label":"R","units":{"USD":[{"val":1.0},{"val":2.0}],"EUR":[{"val":3.0}]}}}}'
    docs = spark.createDataFrame([(1, good), (2, good[:30]), (3, None), (4, "{}")], "id int, doc string")
    assert sorted((r.id, r.unit, r.val) for r in fl.flatten_facts(docs, "doc").collect()) == [(1, "EUR", 3.0), (1, "USD", 1.0), (1, "USD", 2.0)]
    assert {r.id for r in fl.unreadable_documents(docs, "doc").collect()} == {2, 3}


class _Task:
    """Stands for a DataFrame and keeps the function that its tasks would run."""

    def __init__(self, *columns):
        self.columns, self.schema = list(columns), StructType([StructField(c, StringType()) for c in columns])

    def select(self, *_):
        return self

    withColumn = select

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_text_tasks_hold_few_documents(spark):
    """A batch of many documents leaves the task in parts, in order and whole."""
    n = 5 * sx.SLICE + 7
    texts = [f"<p>Item 1. Own {i}</p><p>Item 1A. Risk</p>" for i in range(n)]
    docs = _Task("i", "html")
    sx.html_to_text(docs, "html")
    ids = pa.array([str(i) for i in range(n)])
    parts = list(docs.run(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["i", "html"])])))
    assert max(b.num_rows for b in parts) <= sx.SLICE
    plain = [r for b in parts for r in b.column(1).to_pylist()]
    assert plain == [f"Item 1. Own {i}\nItem 1A. Risk" for i in range(n)]
    docs = _Task("i", "text", "form")
    sx.extract_sections(docs, "text", "form")
    forms = pa.array(["annual" if i % 2 else None for i in range(n)], pa.string())
    parts = list(docs.run(iter([pa.RecordBatch.from_arrays([ids, pa.array(plain), forms], names=["i", "text", "form"])])))
    assert max(b.num_rows for b in parts) <= sx.SLICE
    assert [r for b in parts for r in b.column(5).to_pylist()] == [f"Item 1. Own {i}" if i % 2 else "" for i in range(n)]
    assert [r for b in parts for r in b.column(0).to_pylist()] == ids.to_pylist()
    many = spark.range(3 * sx.SLICE + 1).coalesce(1).selectExpr("id", "concat('item 2 x', id, ' item 3') t")
    got = many.withColumn("m", sx.longest_section(many.t, *sx.MARKERS["quarterly"]["discussion"])).selectExpr("count(*) n", "bool_and(m.section = concat('item 2 x', id)) ok").first()
    assert (got.n, got.ok) == (3 * sx.SLICE + 1, True)
