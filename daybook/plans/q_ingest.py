"""Source and sink queries (S)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.functions.exprs import pad_id, parse_number, r6
from daybook.operators import ingest
from daybook.plans import fixtures as fx
from daybook.plans.oracle import sql
from daybook.plans.registry import query
from daybook.sources import filings as fl
from daybook.sources import market as mk
from daybook.sources.ixbrl import parse_ixbrl
from daybook.sources.tables import read_table

FKEY = ["entity", "accession", "position"]


def _filing_texts(s, d):
    f = fx.filings(s, d)
    day = F.when(F.col("accession") % 50 == 0, "n/a").otherwise(F.col("filed").cast("string"))
    return f.select("accession", "entity", "form", day.alias("filed"), F.col("report_date").cast("string").alias("report_date"))


@query(
    "s1_union_filings",
    sql("""select accession, entity, form, case when accession % 50 <> 0 then filed end filed, report_date, doc from (
  select accession, entity, form, filed, report_date, null doc, 0 src from fil where filed >= date '1999-01-01'
  union all select accession, entity, form, filed, null report_date, 'd-' || accession doc, 1 src from fil where filed < date '2000-06-01')
qualify row_number() over (partition by accession order by src) = 1""", "fil"),
)
def s1(s, d):
    t = _filing_texts(s, d)
    raw = fx.filings(s, d)
    recent = t.join(raw.filter(F.col("filed") >= F.lit("1999-01-01").cast("date")).select("accession"), "accession", "left_semi")
    older = t.join(raw.filter(F.col("filed") < F.lit("2000-06-01").cast("date")).select("accession"), "accession", "left_semi")
    older = older.drop("report_date").withColumn("doc", F.concat(F.lit("d-"), F.col("accession").cast("string")))
    return fl.union_filings([recent, older]).select("accession", "entity", "form", "filed", "report_date", "doc")


@query(
    "s2_union_entities",
    sql("""select accession, entity, form, case when accession % 50 <> 0 then filed end filed,
 case when accession % 2 = 0 or accession % 3 <> 0 then 'current' else 'legacy' end filing_id from fil""", "fil"),
)
def s2(s, d):
    t = _filing_texts(s, d)
    parts = {"current": t.filter("accession % 2 = 0 or accession % 3 <> 0"), "legacy": t.filter("accession % 3 = 0")}
    return fl.union_entities(parts).select("accession", "entity", "form", "filed", "filing_id")


def fact_documents(s, d):
    """One nested fact document per filing, with its concepts, units and facts; every 50th is cut short."""
    f = fx.candidates(s, d)
    fact = F.struct(
        F.col("value").alias("val"), F.col("start_date").cast("string").alias("start"), F.col("end_date").cast("string").alias("end"),
        F.year("end_date").alias("fy"), F.lit("Q").alias("fp"), "form", F.col("filed").cast("string").alias("filed"),
        F.col("accession").cast("string").alias("accn"),
    )
    unit = F.when(F.col("source") == "companyfacts", "USD").otherwise("EUR")
    facts = f.groupBy("accession", "position", unit.alias("unit")).agg(F.collect_list(fact).alias("facts"))
    units = facts.groupBy("accession", "position").agg(F.map_from_entries(F.collect_list(F.struct("unit", "facts"))).alias("units"))
    block = F.struct(F.concat(F.lit("Label "), F.col("position")).alias("label"), "units")
    whole = units.groupBy("accession").agg(F.map_from_entries(F.collect_list(F.struct("position", block))).alias("concepts"))
    doc = F.to_json(F.create_map(F.lit("us-gaap"), F.col("concepts")))
    return whole.select("accession", F.when(F.col("accession") % 50 == 0, F.substring(doc, 1, 40)).otherwise(doc).alias("doc"))


@query(
    "s3_flatten_facts",
    sql("""select accession, 'us-gaap' taxonomy, position as concept, 'Label ' || position as label,
 case when source = 'companyfacts' then 'USD' else 'EUR' end unit, round(value,6) val, cast(start_date as varchar) as "start",
 cast(end_date as varchar) as "end", cast(year(end_date) as int) fy, form, cast(accession as varchar) accn from f4 where accession % 50 <> 0""", "f4"),
)
def s3(s, d):
    out = fl.flatten_facts(fact_documents(s, d), "doc")
    return out.select(
        "accession", "taxonomy", "concept", "label", "unit", r6("val").alias("val"), "start", "end", "fy", "form", "accn"
    )


@query("s3_unreadable_documents", sql("select distinct accession from f4 where accession % 50 = 0", "f4"))
def s3_unreadable(s, d):
    return fl.unreadable_documents(fact_documents(s, d), "doc").select("accession")


# fixed values: two groups map N differently, and one entity has a revenue concept of its own
CONCEPTS = {0: [("revenue", "A", 1), ("revenue", "N", 2), ("net_income", "R", 1)], 1: [("revenue", "A", 1), ("net_income", "R", 1), ("net_income", "N", 2)]}
OWN_ENTITY, OWN_CONCEPTS = 7, [("revenue", "R", 1)]


def groups(s, d):
    """(entity, grp): two accounting groups."""
    return fx.filings(s, d).select("entity").distinct().withColumn("grp", (F.col("entity") % 2).cast("int"))


def scoped_rules(s, d, table, by_group, own):
    """Rules of each entity; ``table`` makes a rule table of a list."""
    parts = None
    for g, rows in by_group.items():
        one = table(s, rows).withColumn("grp", F.lit(g))
        parts = one if parts is None else parts.unionByName(one)
    return fl.scoped(parts, table(s, own).withColumn("entity", F.lit(OWN_ENTITY).cast("long")), groups(s, d))


def scoped_values(by_group, own):
    """The same as DuckDB rows (grp, entity, position, concept, priority), for a join on the group or on the entity."""
    rows = [f"({g}, null, '{p}', '{c}', {n})" for g, m in by_group.items() for p, c, n in m] + [f"(null, {OWN_ENTITY}, '{p}', '{c}', {n})" for p, c, n in own]
    mine = ", ".join(f"'{p}'" for p, _, _ in own)
    return f"(values {', '.join(rows)}) m(grp, own, position, concept, p) on m.concept = f.position and (m.own = f.entity or m.grp = f.entity % 2 and not (f.entity = {OWN_ENTITY} and m.position in ({mine})))"


@query(
    "s4_candidate_facts",
    sql(f"""select f.accession, f.line_no, m.position as position, f.position as concept, m.p concept_priority, round(f.value,6) as value
from f4 f join {scoped_values(CONCEPTS, OWN_CONCEPTS)}
where f.source = 'companyfacts' and f.accession in (select accession from fil where filed >= date '1996-01-01')""", "f4", "fil"),
)
def s4(s, d):
    facts = fx.candidates(s, d).select(
        "entity", "accession", "line_no", F.col("position").alias("concept"), "form", "value",
        F.when(F.col("source") == "companyfacts", "USD").otherwise("EUR").alias("unit"),
    )
    chosen = fx.filings(s, d).filter(F.col("filed") >= F.lit("1996-01-01").cast("date"))
    out = fl.candidate_facts(facts, scoped_rules(s, d, fl.concept_map, CONCEPTS, OWN_CONCEPTS), chosen)
    return out.select("accession", "line_no", "position", "concept", "concept_priority", r6("value").alias("value"))


@query(
    "s5_with_duration",
    sql("select l_orderkey, l_linenumber, cast(release_date - period_end as int) duration_days from f3", "f3"),
)
def s5(s, d):
    f = fx.period_releases(s, d).select(
        "l_orderkey", "l_linenumber", F.col("period_end").cast("string").alias("start_date"), F.col("release_date").cast("string").alias("end_date")
    )
    return fl.with_duration(f).select("l_orderkey", "l_linenumber", "duration_days")


def tagged_documents(s, d):
    """A small tagged document per candidate fact: number format, scale and sign vary."""
    f = fx.candidates(s, d)
    c = F.col
    amount = F.format_number("value", 2)
    shown = F.when(c("position") == "R", F.concat(F.lit("("), amount, F.lit(")"))).when(c("position") == "N", F.concat(F.lit("$ "), amount)).otherwise(amount)
    period = F.when(
        c("start_date").isNull(), F.concat(F.lit("<xbrli:instant>"), c("end_date").cast("string"), F.lit("</xbrli:instant>"))
    ).otherwise(
        F.concat(
            F.lit("<xbrli:startDate>"), c("start_date").cast("string"), F.lit("</xbrli:startDate><xbrli:endDate>"),
            c("end_date").cast("string"), F.lit("</xbrli:endDate>"),
        )
    )
    member = F.when(
        c("line_no") != 1,
        F.concat(F.lit('<xbrldi:explicitMember dimension="x:AxisA">x:'), c("position"), F.lit("</xbrldi:explicitMember>")),
    ).otherwise("")
    html = F.concat(
        F.lit('<html><body><ix:header><xbrli:context id="c1">'), member, period, F.lit("</xbrli:context></ix:header><p>text "),
        F.lit('<ix:nonFraction name="us-gaap:'), c("position"), F.lit('" contextRef="c1" unitRef="usd"'),
        F.when(c("source") == "ixbrl", ' scale="3"').otherwise(""), F.when(c("line_no") == 2, ' sign="-"').otherwise(""),
        F.lit(">"), shown, F.lit("</ix:nonFraction></p></body></html>"),
    )
    return f.select(F.concat_ws("-", "accession", "line_no").alias("doc_id"), html.alias("html"))


@query(
    "s6_parse_ixbrl",
    sql("""select accession || '-' || line_no doc_id, position as concept, 'us-gaap:' || position raw_concept,
 round(case when position = 'R' or line_no = 2 then -1 else 1 end * value * case when source = 'ixbrl' then 1000.0 else 1.0 end, 2) as value,
 start_date, end_date, cast(end_date - start_date as int) duration_days,
 case when line_no <> 1 then 'AxisA=' || position else '' end dims from f4""", "f4"),
)
def s6(s, d):
    out = parse_ixbrl(tagged_documents(s, d), "doc_id", "html")
    dims = F.array_join(F.transform(F.map_entries("dimensions"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select(
        "doc_id", "concept", "raw_concept", F.round("value", 2).alias("value"), "start_date", "end_date", "duration_days", dims.alias("dims")
    )


@query(
    "s7_parse_number",
    sql("""select l_orderkey, l_linenumber, case l_linenumber when 1 then l_quantity when 2 then -l_quantity when 3 then -l_quantity
  when 4 then -l_quantity * 1000 when 5 then null when 6 then null else l_quantity / 10 end as value from lineitem"""),
)
def s7(s, d):
    li = read_table(s, d, "lineitem")
    q, n = F.col("l_quantity").cast("decimal(10,1)").cast("string"), F.col("l_linenumber")
    text = (
        F.when(n == 1, F.concat(F.lit("$ 0,"), q, F.lit(" "))).when(n == 2, F.concat(F.lit("("), q, F.lit(")")))
        .when(n == 3, F.concat(F.lit("−"), q)).when(n == 4, q).when(n == 5, F.lit("")).when(n == 6, F.lit("n/a")).otherwise(q)
    )
    out = li.select(
        "l_orderkey", "l_linenumber", text.alias("t"),
        F.when(n == 4, "3").when(n == 7, "-1").alias("scale"), F.when(n == 4, "-").alias("sign"),
    )
    return out.select("l_orderkey", "l_linenumber", r6(parse_number("t", "scale", "sign")).alias("value"))


def dimensioned(s, d):
    f = fx.candidates(s, d)
    none = F.create_map().cast("map<string,string>")
    axis = F.when(F.col("accession") % 2 == 0, "AxisA").otherwise("AxisAlt")
    dims = F.when(F.col("line_no") == 1, none).otherwise(
        F.when(F.col("accession") % 4 < 2, F.create_map(axis, F.col("position"), F.lit("AxisB"), F.col("source")))
        .otherwise(F.create_map(F.lit("AxisB"), F.col("source"), axis, F.col("position")))
    )
    return f.select(
        "entity", "accession", "line_no", F.col("position").alias("concept"), "start_date", "end_date", "value", dims.alias("dimensions"),
        F.when(F.col("entity") % 2 == 0, F.concat(F.lit("us-gaap:"), F.col("position"))).otherwise(F.concat(F.lit("own:"), F.col("position"))).alias("raw_concept"),
    )


# fixed values
RULE = [(["AxisA", "AxisAlt"], ["A", "N"]), (["AxisB"], ["ixbrl"])]


def _needed(rule):
    return F.array(*[F.struct(F.array(*map(F.lit, a)).alias("axes"), F.array(*map(F.lit, m)).alias("members")) for a, m in rule])


@query(
    "s8_filter_dimensions",
    sql("""select accession, line_no, case when line_no = 1 then 'plain' else 'ruled' end kind from f4
 where line_no = 1 or (position in ('A','N') and source = 'ixbrl')""", "f4"),
)
def s8(s, d):
    f = dimensioned(s, d)
    ruled = fl.filter_dimensions(f, _needed(RULE)).withColumn("kind", F.lit("ruled"))
    plain = fl.filter_dimensions(f, F.lit(None)).withColumn("kind", F.lit("plain"))
    return ruled.unionByName(plain).select("accession", "line_no", "kind")


@query(
    "s9_dedupe_dimensional",
    sql("""select concept, month, quantity, dims, min(l_orderkey * 10 + l_linenumber) first_row from (
 select l_returnflag concept, cast(date_trunc('month', l_shipdate) as date) as month, l_quantity quantity, l_orderkey, l_linenumber,
  case when l_linenumber = 1 then 'none' else l_linestatus end dims from lineitem) group by 1, 2, 3, 4"""),
)
def s9(s, d):
    li = read_table(s, d, "lineitem")
    none = F.create_map().cast("map<string,string>")
    rf, ls = F.lit("AxisA"), F.lit("AxisB")
    dims = F.when(F.col("l_linenumber") == 1, none).otherwise(
        F.when(F.col("l_orderkey") % 2 == 0, F.create_map(rf, F.col("l_returnflag"), ls, F.col("l_linestatus")))
        .otherwise(F.create_map(ls, F.col("l_linestatus"), rf, F.col("l_returnflag")))
    )
    f = li.select(
        F.col("l_returnflag").alias("concept"), F.trunc("l_shipdate", "month").alias("month"), F.col("l_quantity").alias("quantity"),
        dims.alias("dimensions"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_row"), F.col("l_linestatus").alias("ls"),
    )
    out = fl.dedupe_dimensional(f, ["concept", "month", "quantity"], ["first_row"])
    kind = F.when(F.col("dimension_key") == "[]", "none").otherwise(F.col("ls"))
    return out.select("concept", "month", "quantity", kind.alias("dims"), "first_row")


_SEGMENT = [(["AxisA", "AxisAlt"], ["A"]), (["AxisB"], ["companyfacts"])]
_ANY_SOURCE = [(["AxisB"], ["ixbrl", "companyfacts"])]
INLINE_RULES = {
    0: [("revenue", "A", 1, _SEGMENT), ("revenue", "N", 2, None), ("net_income", "R", 1, _ANY_SOURCE)],
    1: [("revenue", "A", 1, _SEGMENT), ("net_income", "N", 2, None)],
}
OWN_INLINE = [("revenue", "R", 1, _ANY_SOURCE)]


@query(
    "s10_inline_candidates",
    sql(f"""select f.accession, line_no, m.position as position, m.p concept_priority, case when f.entity % 2 = 0 then 'us-gaap' else 'company_extension_ixbrl' end taxonomy,
 fil.form, fil.filed from f4 f join fil on fil.accession = f.accession
 join {scoped_values({g: [r[:3] for r in m] for g, m in INLINE_RULES.items()}, [r[:3] for r in OWN_INLINE])} where fil.filed >= date '1997-01-01' and (
  (f.position = 'A' and line_no <> 1 and source = 'companyfacts') or (f.position = 'N' and line_no = 1) or (f.position = 'R' and line_no <> 1))""", "f4", "fil"),
)
def s10(s, d):
    chosen = fx.filings(s, d).filter(F.col("filed") >= F.lit("1997-01-01").cast("date"))
    out = fl.inline_candidates(dimensioned(s, d), scoped_rules(s, d, fl.inline_rules, INLINE_RULES, OWN_INLINE), chosen)
    return out.select("accession", "line_no", "position", "concept_priority", "taxonomy", "form", "filed")


@query(
    "s11_combine_candidates",
    sql("select accession, position, line_no, source from f4 where line_no <= 5 union all select accession, position, line_no, 'inline' source from f4 where line_no >= 4", "f4"),
)
def s11(s, d):
    f = fx.candidates(s, d).select("accession", "position", "line_no", "source")
    return fl.combine_candidates(f.filter("line_no <= 5"), f.filter("line_no >= 4").withColumn("source", F.lit("inline")))


# fixed values
LABELS = {
    "revenue": ["Total Revenue", "Operating Revenue"],
    "cash_and_cash_equivalents": ["Cash And Equivalents", "Cash"],
    "total_debt": ["TotalDebt"],
}


def statement_matrix(s, d):
    """Reports as statements: one row per (entity, form, year, label), a column per quarter."""
    f = fx.facts_wide(s, d)
    lab = F.explode(
        F.array(
            F.struct(F.lit("total  REVENUE").alias("label"), F.when(F.year("period_end") % 2 == 0, F.col("revenue")).alias("v")),
            F.struct(F.lit("Operating Revenue").alias("label"), (-F.col("revenue")).alias("v")),
            F.struct(F.lit("cash").alias("label"), F.col("cash_and_cash_equivalents").alias("v")),
            F.struct(F.lit("Total Debt").alias("label"), F.col("total_debt").alias("v")),
            F.struct(F.lit("Unrelated").alias("label"), F.col("inventory").alias("v")),
        )
    )
    long = f.select("entity", "form", F.year("period_end").alias("y"), F.quarter("period_end").alias("q"), lab.alias("x")).select("entity", "form", "y", "q", "x.*")
    return long.groupBy("entity", "form", "y", "label").agg(
        *[F.max(F.when(F.col("q") == i, F.col("v"))).alias(f"q{i}") for i in (1, 2, 3, 4)],
        *[F.max(F.col("q") == i).alias(f"has{i}") for i in (1, 2, 3, 4)],
    )


@query(
    "s12_unpivot_statements",
    sql("""select entity, form, period_end, p as position, round(coalesce(v, 0),6) as value, case when v is null then 'missing' else 'selected' end selection_status from (
 select entity, form, period_end, 'revenue' p, case when year(period_end) % 2 = 0 then revenue else -revenue end v from f1
 union all select entity, form, period_end, 'cash_and_cash_equivalents', cash_and_cash_equivalents from f1
 union all select entity, form, period_end, 'total_debt', total_debt from f1)""", "f1"),
)
def s12(s, d):
    m = statement_matrix(s, d)
    cols = {f"q{i}": F.when(F.col(f"has{i}"), F.last_day(F.make_date("y", F.lit(3 * i), F.lit(1)))) for i in (1, 2, 3, 4)}
    out = mk.unpivot_statements(m, ["entity", "form"], cols, LABELS)
    return out.select("entity", "form", "period_end", "position", r6("value").alias("value"), "selection_status")


@query(
    "s13_union_period_ends",
    sql("""select entity, period_end from f1 where revenue > 1000000 union select entity, period_end from f1 where total_debt is not null
 union select entity, period_end from f1 where operating_cash_flow < 0""", "f1"),
)
def s13(s, d):
    f = fx.facts_wide(s, d)
    parts = [f.filter("revenue > 1000000"), f.filter("total_debt is not null"), f.filter("operating_cash_flow < 0")]
    return mk.union_period_ends(parts, ["entity"])


@query(
    "s14_release_dates",
    sql("select distinct user_id entity, cast(ts as date) release_date from events where cast(ts as date) <= date '2024-01-20'"),
)
def s14(s, d):
    return mk.release_dates(fx.ticks(s, d), "entity", "ts", F.lit("2024-01-20").cast("date"))


@query(
    "s15_price_rows",
    sql("""select user_id entity, cast(ts as date) d, round(arg_max(value, (ts, event_id)),6) adjusted_close from events
 where value >= 5 group by 1, 2"""),
)
def s15(s, d):
    h = fx.ticks(s, d).withColumn("close", F.when(F.col("value") >= 5, F.col("value")))
    return mk.price_rows(h, "entity", "ts", "close", ["event_id"]).withColumn("adjusted_close", r6("adjusted_close"))


@query(
    "s16_price_universe",
    sql("""select entity, max(source) source, min(coalesce(release_date, period_end)) earliest_release,
 min(cast(date_trunc('year', min(coalesce(release_date, period_end))) as date)) over () start_date from f1r group by 1""", "f1r"),
)
def s16(s, d):
    return mk.price_universe(fx.filed_reports(s, d))


@query(
    "s17_upsert",
    sql("""select entity, accession, position, round(case when sector >= 2 then value * 2 else value end,6) as value from f1l""", "f1l"),
)
def s17(s, d):
    f = fx.facts_long(s, d).select(*FKEY, "sector", "value")
    # each key is written twice; the second value is the smaller one for half of them
    first = F.when(F.col("entity") % 2 == 0, F.abs("value") * 9 + 1).otherwise(-F.abs("value") * 9 - 1)
    twice = F.array(F.struct(F.lit(1).alias("seq"), first.alias("v")), F.struct(F.lit(2).alias("seq"), (F.col("value") * 2).alias("v")))
    batch = f.filter("sector >= 2").withColumn("w", F.explode(twice)).select(*FKEY, "sector", F.col("w.v").alias("value"), F.col("w.seq").alias("seq"))
    out = ingest.upsert(f.filter("sector <= 3"), batch, FKEY, ["seq"])
    return out.select(*FKEY, F.round("value", 6).alias("value"))


@query(
    "s18_find_restatements",
    sql("""select entity, accession, position, round(value + 1,6) new_value, round(value,6) old_value from f1l where entity % 10 = 3""", "f1l"),
)
def s18(s, d):
    f = fx.facts_long(s, d).select(*FKEY, "value")
    new = f.withColumn("value", F.when(F.col("entity") % 10 == 3, F.col("value") + 1).otherwise(F.col("value")))
    out = ingest.find_restatements(new, f, FKEY)
    return out.select(*FKEY, F.round("new_value", 6).alias("new_value"), F.round("old_value", 6).alias("old_value"))


@query("s19_find_orphans", sql("select entity, accession, position from f1l where entity % 7 = 2 or position = 'inventory'", "f1l"))
def s19(s, d):
    f = fx.facts_long(s, d)
    return ingest.find_orphans(f.filter("entity % 7 <> 2 and position <> 'inventory'"), f, FKEY)


FACT_SCHEMA = T.StructType(
    [
        T.StructField("entity", T.LongType()), T.StructField("accession", T.StringType()), T.StructField("position", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("reporting_currency", T.StringType()),
        T.StructField("provider", T.StringType()),
    ]
)


@query(
    "s20_conform",
    sql("""select entity, accession, position, case when selection_status <> 'missing' then round(value,6) end as value,
 case when sector = 0 then 'USD' else 'EUR' end unit, case when sector = 0 then 'USD' else 'EUR' end reporting_currency, 'filing' provider from f1l""", "f1l"),
)
def s20(s, d):
    f = fx.facts_long(s, d).withColumn("value", F.when(F.col("selection_status") == "missing", F.lit(float("nan"))).otherwise(F.round("value", 6)))
    f = f.withColumn("unit", F.when(F.col("sector") == 0, "USD").otherwise("EUR"))
    return ingest.conform(f, FACT_SCHEMA, {"reporting_currency": F.col("unit"), "provider": F.lit("filing")})


@query(
    "s21_read_facts",
    sql("select entity, form, period_end, position, round(value,6) as value from f1l where form = 'annual' and position = 'revenue'", "f1l"),
)
def s21(s, d):
    out = ingest.read_facts(fx.facts_long(s, d), form="annual", position="revenue", entity=None)
    return out.select("entity", "form", "period_end", "position", F.round("value", 6).alias("value"))


@query(
    "s22_available_periods",
    sql("select distinct entity, form, accession, release_date, period_end from f1l where form = 'annual'", "f1l"),
)
def s22(s, d):
    return ingest.available_periods(fx.facts_long(s, d), form="annual")


@query(
    "s23_missing_summary",
    sql("select entity, position, count(*) missing_count from f1l where selection_status = 'missing' group by 1, 2", "f1l"),
)
def s23(s, d):
    return ingest.missing_summary(fx.facts_long(s, d))


_METHOD = "case when position = 'total_debt' then 'calculated' when entity % 4 = 1 then 'ixbrl_dimensional' else 'companyfacts' end"


@query(
    "s24_validation_summary",
    sql(f"""select entity, count(distinct accession) filings, count(*) n_rows, count(*) filter (where selection_status = 'missing') missing_values,
 count(*) filter (where m = 'calculated') calculated_rows, count(*) filter (where m = 'ixbrl_dimensional') ixbrl_rows
 from (select *, {_METHOD} m from f1l) group by 1""", "f1l"),
)
def s24(s, d):
    return ingest.validation_summary(fx.facts_long(s, d).withColumn("extraction_method", F.expr(_METHOD)))


@query(
    "s25_suspicious_repeats",
    sql("""select entity, position, round(value,6) as value, count(distinct accession) repeated_in_filings from f1l group by entity, position, f1l.value
 having count(distinct accession) >= 4""", "f1l"),
)
def s25(s, d):
    return ingest.suspicious_repeats(fx.facts_long(s, d)).withColumn("value", F.round("value", 6))


@query(
    "s26_select_universe",
    sql("""select distinct c_custkey entity from customer join nation on n_nationkey = c_nationkey where c_mktsegment in ('BUILDING','MACHINERY')
 and c_custkey in (select o_custkey from orders) and n_regionkey in (select n_regionkey from nation join supplier on s_nationkey = n_nationkey where n_regionkey <> 4)"""),
)
def s26(s, d):
    nat = read_table(s, d, "nation")
    members = read_table(s, d, "customer").join(nat, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("company_group"), F.col("n_regionkey").alias("sector")
    )
    active = read_table(s, d, "orders").select(F.col("o_custkey").alias("entity"))
    sectors = read_table(s, d, "supplier").join(nat, F.col("n_nationkey") == F.col("s_nationkey")).filter("n_regionkey <> 4").select(
        F.col("n_regionkey").alias("sector")
    )
    groups = ["BUILDING", "MACHINERY"]
    ingest.require_known_groups(members, groups)
    return ingest.select_universe(members, groups, active, sectors)


def _truth(s, d):
    first = read_table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("accession")).agg(F.min("l_shipdate").alias("_f"))
    f = fx.filings(s, d)
    t = f.join(first, "accession").filter("accession % 9 <> 0")
    return t.select("entity", "accession", F.when(F.col("accession") % 4 == 0, F.col("_f")).otherwise(F.col("filed")).alias("filed"))


_REC = """select fil.entity, fil.accession, case when t.d is null then 'absent' when t.d = fil.filed then 'match' else 'mismatch' end status,
 case when t.d <> fil.filed then cast(abs(t.d - fil.filed) as int) end gap_days from fil left join (
  select f.accession, case when f.accession % 4 = 0 then m else f.filed end d from fil f join (
    select l_orderkey accession, cast(min(l_shipdate) as date) m from lineitem group by 1) x on x.accession = f.accession where f.accession % 9 <> 0) t
 on t.accession = fil.accession"""


@query("s27_reconcile_dates", sql(_REC, "fil"))
def s27(s, d):
    return ingest.reconcile_dates(fx.filings(s, d), _truth(s, d), ["entity", "accession"])


@query("s27_reconcile_counts", sql(f"select status, count(*) n, max(gap_days) max_gap_days from ({_REC}) group by 1", "fil"))
def s27b(s, d):
    return ingest.reconcile_counts(ingest.reconcile_dates(fx.filings(s, d), _truth(s, d), ["entity", "accession"]))


@query(
    "s28_price_coverage",
    sql("""select u.entity, first_day, last_day, coalesce(n_rows, 0) n_rows, n_rows is null is_empty,
 coalesce(n_rows is not null and u.entity % 6 = 0, false) currency_mismatch, coalesce(first_day > u.earliest, false) starts_late
from (select c_custkey entity, date '1995-01-10' earliest from customer) u left join (
 select entity, min(d) first_day, max(d) last_day, count(*) n_rows from f2 group by 1) p on p.entity = u.entity""", "f2"),
)
def s28(s, d):
    universe = read_table(s, d, "customer").select(
        F.col("c_custkey").alias("entity"), F.lit("1995-01-10").cast("date").alias("earliest_release"),
        F.when(F.col("c_custkey") % 6 == 0, "eur").otherwise("usd").alias("reporting_currency"),
    )
    return mk.price_coverage(fx.prices(s, d).withColumn("currency", F.lit("USD")), universe)


@query(
    "s29_largest_gap",
    sql("""select entity, cast(g as int) gap_days, f gap_from, d gap_to, g > 14 flagged from (
 select entity, d, lag(d) over w f, d - lag(d) over w g from f2 window w as (partition by entity order by d)) where g is not null
 qualify row_number() over (partition by entity order by g desc, f) = 1""", "f2"),
)
def s29(s, d):
    return mk.largest_gap(fx.prices(s, d))


# fixed values
KEYWORDS = {"fixing": ["bolt", "Screw"], "sheet": ["PLATE", "panel"], "turning": ["gear", "ring"], "colour": ["red", "blue", "green"]}


@query(
    "s30_tag_keywords",
    sql("select p_name, keyword_group from (select distinct p_name from part) join (values "
        + ", ".join(f"('{g}', '{k.lower()}')" for g, ks in KEYWORDS.items() for k in ks)
        + ") v(keyword_group, kw) on contains(lower(p_name), kw) group by 1, 2"),
)
def s30(s, d):
    return ingest.tag_keywords(read_table(s, d, "part"), "p_name", KEYWORDS)


# fixed values
CALC = [("gross_profit", "revenue"), ("gross_profit", "cost_of_revenue"), ("total_debt", "long_term_debt"), ("net_debt", "cash_pool")]


@query(
    "s31_check_reference_maps",
    sql("""with act as (select distinct sector grp, position from f1l where form = 'quarterly'),
 map as (select distinct sector grp, position from f1l where form = 'annual' and selection_status <> 'missing' and position not in ('inventory','total_debt')),
 rul as (select grp, t, c from (select distinct sector grp from f1) cross join (values ('gross_profit','revenue'),('gross_profit','cost_of_revenue'),('total_debt','long_term_debt'),('net_debt','cash_pool')) v(t, c)),
 res as (select grp, position from map union select grp, t from rul),
 mem as (select distinct entity, sector grp from f1 union select entity, 99 from f1 where entity % 40 = 5 union select distinct o_custkey, 98 from orders where o_custkey % 100 = 1)
select 'position_unresolved' check_name, grp || ':' || position as key from act where (grp, position) not in (select grp, position from res)
union all select distinct 'component_unresolved', grp || ':' || c from rul where (grp, c) not in (select grp, position from res)
union all select 'entity_in_two_groups', cast(entity as varchar) from mem group by entity having count(*) > 1
union all select distinct 'unknown_entity', cast(entity as varchar) from mem where entity not in (select entity from f1)""", "f1l", "f1").replace(")\nwith act", "),\nact"),
)
def s31(s, d):
    f = fx.facts_long(s, d)
    wide = fx.facts_wide(s, d)
    act = f.filter("form = 'quarterly'").select(F.col("sector").alias("grp"), "position").distinct()
    mapped = f.filter("form = 'annual' and selection_status <> 'missing' and position not in ('inventory','total_debt')").select(
        F.col("sector").alias("grp"), "position"
    ).distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("component")) for t, c in CALC]))
    rules = wide.select(F.col("sector").alias("grp")).distinct().select("grp", pairs.alias("x")).select("grp", "x.*")
    members = (
        wide.select("entity", F.col("sector").alias("grp"))
        .unionByName(wide.filter("entity % 40 = 5").select("entity", F.lit(99).alias("grp")))
        .unionByName(read_table(s, d, "orders").filter("o_custkey % 100 = 1").select(F.col("o_custkey").alias("entity"), F.lit(98).alias("grp")))
    )
    return ingest.check_reference_maps(act, mapped, rules, wide.select("entity").distinct(), members)


@query(
    "s32_id_normalise",
    sql("""select o_orderkey, lpad(cast(o_custkey as varchar), 10, '0') id_10, o_custkey id_int, concat(o_custkey, o_orderkey) accession_plain from orders"""),
)
def s32(s, d):
    o = read_table(s, d, "orders")
    raw = F.concat(F.lit(" "), F.col("o_custkey").cast("string"))
    return o.select(
        "o_orderkey", pad_id(raw).alias("id_10"), pad_id(raw).cast("long").alias("id_int"),
        F.replace(F.concat_ws("-", "o_custkey", "o_orderkey"), F.lit("-"), F.lit("")).alias("accession_plain"),
    )
