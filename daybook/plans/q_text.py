"""Text section and scoring queries (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions.exprs import parse_score
from daybook.operators import sections as sx
from daybook.plans import fixtures as fx
from daybook.plans.oracle import cte, sql
from daybook.plans.registry import query
from daybook.session import stage
from daybook.sources.tables import read_table

FORM = "case doc_id % 3 when 0 then 'annual' when 1 then 'quarterly' else 'foreign_annual' end"
# fixed values: headings of the composed documents, per form and section
HEADS = {
    "annual": [("business", "Item 1. Business"), ("risk", "Item 1A. Risk"), ("", "Item 2. Places"), ("discussion", "Item 7. Review"), ("", "Item 8. Tables")],
    "quarterly": [("", "Item 1. Tables"), ("discussion", "Item 2. Review"), ("", "Item 3. Market")],
    "foreign_annual": [("risk", "Item 3.D Risk"), ("business", "Item 4 Business"), ("discussion", "Item 5 Review"), ("", "Item 6 People")],
}
CONTENTS = {f: " ".join(h for _, h in hs) for f, hs in HEADS.items()}


def filing_documents(s, d):
    """Marked-up filings whose sections hold the whole text of a document, behind a table of
    contents that repeats the headings."""
    docs = read_table(s, d, "documents").withColumn("form", F.expr(FORM))
    body = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(a), F.lit(b))
    whole = {"discussion": body, "risk": F.concat(F.lit("risk: "), body), "business": F.concat(F.lit("own "), F.col("source")), "": F.lit("none")}
    html = None
    for form, heads in HEADS.items():
        parts = [F.lit(f"<html><style>item 7</style><body><p>{CONTENTS[form]}</p>")]
        for sec, head in heads:
            parts += [F.lit(f"<h2>{head}</h2><p>"), whole[sec], F.lit("</p>")]
        one = F.concat(*parts, F.lit("<script>x()</script></body></html>"))
        html = F.when(F.col("form") == form, one) if html is None else html.when(F.col("form") == form, one)
    return docs.select("doc_id", "form", html.alias("html"))


def _tidy(x):
    return f"regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g')"


def _strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_WHOLE = {"discussion": "text", "risk": "'risk: ' || text", "business": "'own ' || source", "": "'none'"}


def _composed(form):
    parts = [f"'{CONTENTS[form]}'"]
    for sec, head in HEADS[form]:
        parts += [f"chr(10) || '{head}'", f"chr(10) || {_WHOLE[sec]}"]
    return " || ".join(parts)


cte(
    "doct",
    f"""select doc_id, source, text, {FORM} form, {_tidy("case doc_id % 3 when 0 then " + _composed("annual") + " when 1 then " + _composed("quarterly") + " else " + _composed("foreign_annual") + " end")} plain from documents""",
)


def _sec(sec):
    cases = []
    for form, heads in HEADS.items():
        for name, head in heads:
            if name == sec:
                cases.append(f"when form = '{form}' then {_strip(_tidy(chr(39) + head + chr(39) + ' || chr(10) || ' + _WHOLE[sec] + ' || chr(10)'))}")
    return "case " + " ".join(cases) + " else '' end"


cte("secs", f"select doc_id, form, {', '.join(_sec(x) + ' ' + x for x in sx.SECTIONS)} from doct", "doct")


def plain(s, d):
    return stage(s, d, "plain_text", lambda: sx.html_to_text(filing_documents(s, d), "html"))


def sectioned(s, d):
    return stage(s, d, "sections", lambda: sx.extract_sections(plain(s, d), "text", "form"))


@query("q1_html_to_text", sql("select doc_id, form, length(plain) n_chars, md5(plain) digest from doct", "doct"))
def q1(s, d):
    out = sx.html_to_text(filing_documents(s, d), "html")
    return out.select("doc_id", "form", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("q1_page_text")
def q1b(s, d):
    out = sx.html_to_text(read_table(s, d, "pages").select("page_id", "html"), "html")
    return out.select("page_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


DISCUSSED = [form for form, m in sx.MARKERS.items() if "discussion" in m]


@query(
    "q2_longest_section",
    sql(f"""select doc_id, length(discussion) n_chars, md5(discussion) digest from secs where form in ({', '.join(f"'{f}'" for f in DISCUSSED)})""", "secs"),
)
def q2(s, d):
    own = None
    for form in DISCUSSED:
        one = plain(s, d).filter(F.col("form") == form).withColumn("m", sx.longest_section(F.col("text"), *sx.MARKERS[form]["discussion"]))
        own = one if own is None else own.unionByName(one)
    return own.select("doc_id", F.length("m.section").cast("long").alias("n_chars"), F.md5(F.col("m.section").cast("binary")).alias("digest"))


@query(
    "q3_extract_sections",
    sql("select doc_id, form, " + ", ".join(f"md5({x}) {x}" for x in sx.SECTIONS) + " from secs", "secs"),
)
def q3(s, d):
    out = sx.extract_sections(plain(s, d), "text", "form")
    return out.select("doc_id", "form", *[F.md5(F.col(x).cast("binary")).alias(x) for x in sx.SECTIONS])


def with_titles(s, d):
    """Sections of which some lost the discussion, with a titled copy in place or in an exhibit."""
    t = sectioned(s, d)
    lost = F.col("doc_id") % 2 == 1
    titled = F.concat(F.lit("Management's Discussion and Analysis "), F.col("text"))
    return t.withColumn("discussion", F.when(lost, "").otherwise(F.col("discussion"))).withColumn(
        "text", F.when(F.col("doc_id") % 4 == 1, titled).otherwise("nothing here")
    )


def exhibits(s, d):
    t = plain(s, d)
    a = t.filter("doc_id % 5 < 3").select("doc_id", F.lit("a-EX_13.htm").alias("name"), F.concat(F.lit("Managements discussion and analysis: "), F.col("text")).alias("text"))
    return a.unionByName(t.select("doc_id", F.lit("ex99.htm").alias("name"), F.concat(F.lit("management's discussion and analysis "), F.col("text")).alias("text")))


@query(
    "q4_fallback_section",
    sql(f"""select doc_id, form, case when doc_id % 2 = 0 and length(discussion) >= 3000 then 'primary'
  when form <> 'foreign_annual' and doc_id % 4 = 1 and tl >= 3000 then 'primary_title'
  when form <> 'foreign_annual' and doc_id % 5 < 3 and el >= 3000 then 'exhibit' else 'none' end section_source,
 case when doc_id % 2 = 0 and length(discussion) >= 3000 then length(discussion)
  when form <> 'foreign_annual' and doc_id % 4 = 1 and tl >= 3000 then tl
  when form <> 'foreign_annual' and doc_id % 5 < 3 and el >= 3000 then el when doc_id % 2 = 0 then length(discussion) else 0 end n_chars
from (select secs.*, length({_strip("'Management''s Discussion and Analysis ' || plain")}) tl, length({_strip("'Managements discussion and analysis: ' || plain")}) el
 from secs join doct using (doc_id))""", "secs", "doct"),
)
def q4(s, d):
    out = sx.fallback_section(with_titles(s, d), exhibits(s, d), "doc_id", "text", "form")
    return out.select("doc_id", "form", "section_source", F.length("discussion").cast("long").alias("n_chars"))


CAPS = {"discussion": 2500, "risk": 600, "business": 20}
BUDGET = 2600


def payloads(s, d):
    return sx.build_payload(sectioned(s, d), CAPS, BUDGET)


cte(
    "pay",
    """select doc_id, form, concat_ws(chr(10) || chr(10), b1, b2, b3) payload,
 cast((length(discussion) > 0 and length(discussion) > 2500 - 13) or (length(risk) > 0 and (r2 <= 0 or length(risk) > r2)) or (length(business) > 0 and (r3 <= 0 or length(business) > r3)) as int) truncated
from (select *, case when length(business) > 0 and r3 > 0 then '=== BUSINESS ===' || chr(10) || substr(business, 1, r3) end b3 from (
 select *, least(20, 2600 - coalesce(length(b1), 0) - coalesce(length(b2), 0)) - 17 r3 from (
 select *, case when length(risk) > 0 and r2 > 0 then '=== RISK FACTORS ===' || chr(10) || substr(risk, 1, r2) end b2 from (
 select *, least(600, 2600 - coalesce(length(b1), 0)) - 21 r2 from (
 select *, case when length(discussion) > 0 then '=== MD&A ===' || chr(10) || substr(discussion, 1, 2500 - 13) end b1 from secs)))))""",
    "secs",
)


@query("q5_build_payload", sql("select doc_id, length(payload) n_chars, md5(payload) digest, truncated from pay", "pay"))
def q5(s, d):
    return payloads(s, d).select("doc_id", F.length("payload").cast("long").alias("n_chars"), F.md5(F.col("payload").cast("binary")).alias("digest"), "truncated")


def demo_scorer(payload: str, form: str, as_of: str) -> str | None:
    """Deterministic stand-in for a caller's scorer: shapes of real replies by text length."""
    n = len(payload)
    if n % 11 == 0:
        raise ValueError("no reply")
    digit = 1 + n % 5
    shape = n % 4
    if shape == 0:
        return str(digit)
    if shape == 1:
        return f"<think>maybe 5 or 1</think>\n{digit}"
    if shape == 2:
        return f"I would say {digit} overall"
    return "7 of 10, undecided"


def replies(s, d):
    p = payloads(s, d).withColumn("as_of", F.lit("2024-01-31").cast("date"))
    return stage(s, d, "replies", lambda: sx.score_documents(p, demo_scorer, "doc_id", "payload", "form", "as_of"))


cte(
    "rep6",
    """select doc_id, form, truncated, case when n % 11 = 0 then null when n % 4 = 0 then cast(1 + n % 5 as varchar)
 when n % 4 = 1 then '<think>maybe 5 or 1</think>' || chr(10) || (1 + n % 5) when n % 4 = 2 then 'I would say ' || (1 + n % 5) || ' overall'
 else '7 of 10, undecided' end reply, case when n % 11 = 0 then 'no reply' end error, case when n % 11 <> 0 and n % 4 <> 3 then 1 + n % 5 end vote
from (select *, length(payload) n from pay)""",
    "pay",
)


@query("q6_score_documents", sql("select doc_id, coalesce(reply, '') reply, error from rep6", "rep6"))
def q6(s, d):
    p = payloads(s, d).withColumn("as_of", F.lit("2024-01-31").cast("date"))
    out = sx.score_documents(p, demo_scorer, "doc_id", "payload", "form", "as_of")
    return out.select("doc_id", F.array_join("replies", "|").alias("reply"), "error")


@query(
    "q7_parse_score",
    sql(r"""select conv_id, turn, cast(coalesce(list_filter(list_transform(string_split_regex(t, '\r?\n'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[1-5]'))[-1],
  nullif(regexp_extract(t, '(?:^|[^\pL\pN_])([1-5])(?:$|[^\pL\pN_])', 1), '')) as int) score
 from (select conv_id, turn, trim(regexp_replace(case turn % 5 when 0 then '<think>' || text || ' 3</think>' || chr(10) || chr(10) || (1 + conv_id % 5)
  when 1 then text || chr(10) || '5' || chr(10) || 'because' || chr(10) || '2' || chr(10) || 'of it' when 2 then text || ' so ' || (1 + conv_id % 5) || ' it is, not 5'
  when 3 then text || chr(10) || '7' else ' 4 ' end, '(?is)<think>.*?</think>', '', 'g')) t from conversations)"""),
)
def q7(s, d):
    c = read_table(s, d, "conversations")
    digit = (1 + F.col("conv_id") % 5).cast("string")
    kind = F.col("turn") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit("<think>"), F.col("text"), F.lit(" 3</think>\n\n"), digit))
        .when(kind == 1, F.concat("text", F.lit("\n5\nbecause\n2\nof it")))
        .when(kind == 2, F.concat("text", F.lit(" so "), digit, F.lit(" it is, not 5")))
        .when(kind == 3, F.concat("text", F.lit("\n7")))
        .otherwise(F.lit(" 4 "))
    )
    return c.select("conv_id", "turn", parse_score(raw).alias("score"))


@query(
    "q8_aggregate_votes",
    sql("""select conv_id, round(quantile_cont(v, 0.5),6) score_raw, round((quantile_cont(v, 0.5) - 1) / 4,6) score,
 case when count(v) > 0 then 'scored' when conv_id % 2 = 0 then 'missing' else 'error' end status
from (select conv_id, case when length(text) % 9 < 5 and conv_id % 7 <> 0 then 1 + length(text) % 9 end v from conversations) group by 1"""),
)
def q8(s, d):
    c = read_table(s, d, "conversations")
    n = F.length("text") % 9
    v = F.when((n < 5) & (F.col("conv_id") % 7 != 0), 1 + n)
    rows = c.select("conv_id", v.alias("vote"))
    out = sx.aggregate_vote_rows(rows, ["conv_id"], "vote", F.col("conv_id") % 2 == 0)
    return out.select("conv_id", F.round("score_raw", 6).alias("score_raw"), F.round("score", 6).alias("score"), "status")


@query("q9_todo", sql("select accession, entity, form from fil where not (accession % 3 = 0 and accession % 2 = 0)", "fil"))
def q9(s, d):
    f = fx.filings(s, d)
    scored = f.filter("accession % 3 = 0").select("accession", F.when(F.col("accession") % 2 == 0, "scored").otherwise("error").alias("status"))
    return sx.todo(f, scored).select("accession", "entity", "form")


@query(
    "q10_scoring_reports",
    sql("select entity, release_date, accession, max(period_end) period_end, max(form) form from f1l where source = 'primary' group by 1, 2, 3", "f1l"),
)
def q10(s, d):
    return sx.scoring_reports(fx.facts_long(s, d), "primary")


@query(
    "q11_resolve_ids",
    sql("""select c_custkey local_id, lpad(cast(s_suppkey as varchar), 10, '0') registry_id, f.accession from customer
 join supplier on s_name = 'Supplier#' || lpad(cast(c_custkey as varchar), cast(length(s_name) - 9 as int), '0')
 join fil f on f.entity = c_custkey and f.form = '10-K' and year(f.filed) >= 1997""", "fil"),
)
def q11(s, d):
    sup = read_table(s, d, "supplier").select(F.col("s_name").alias("listing_id"), F.col("s_suppkey").alias("registry_id"))
    width = F.lit(9)
    local = read_table(s, d, "customer").select(
        F.col("c_custkey").alias("local_id"),
        F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("c_custkey").cast("string"), width, F.lit("0"))).alias("listing_id"),
    )
    ids = sx.resolve_ids(local, sup)
    f = fx.filings(s, d).join(ids, F.col("entity") == F.col("local_id")).drop("registry_id", "local_id").withColumn("registry_id", F.lpad(F.col("entity").cast("string"), 10, "0"))
    return sx.filings_since(f, ids, "10-K", 1997).select("local_id", "registry_id", "accession")


def scored(s, d):
    r = replies(s, d)
    votes = F.transform("replies", lambda x: parse_score(x))
    out = sx.aggregate_votes(r.withColumn("votes", votes), "votes", F.size("replies") > 0)
    return out.join(payloads(s, d).select("doc_id", "form", "truncated"), "doc_id")


@query(
    "q12_score_report",
    sql("""select form, status, coalesce(cast(vote as double), -1) score_raw, count(*) n, cast(sum(truncated) as bigint) n_truncated from (
 select *, case when vote is not null then 'scored' when error is null then 'missing' else 'error' end status from rep6) group by 1, 2, 3""", "rep6"),
)
def q12(s, d):
    t = scored(s, d).withColumn("score_raw", F.coalesce("score_raw", F.lit(-1.0)))
    return sx.score_counts(t, ["form", "status", "score_raw"])
