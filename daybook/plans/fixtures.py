"""Inputs of the reference's shapes, derived by Spark from the given tables.

Facts, prices, filings, scores and predictions all grow with lineitem and orders; every
builder reduces to a calendar-unique key before any window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.exprs import r6
from daybook.session import stage
from daybook.sources.tables import read_table

# fixed values: the positions every report carries
POSITIONS = [
    "revenue", "gross_profit", "cost_of_revenue", "research_and_development",
    "operating_income", "income_tax", "income_before_tax", "net_income", "total_assets",
    "total_equity", "cash_and_cash_equivalents", "short_term_debt", "long_term_debt",
    "total_debt", "inventory", "operating_cash_flow", "capital_expenditure",
    "net_interest_income", "retained_earnings",
]


def _money(c: Column) -> Column:
    return F.sum(c.cast("decimal(18,6)"))


def facts_wide(spark: SparkSession, d: str) -> DataFrame:
    """one row per (entity, form, period_end), NULL = missing position."""
    return stage(spark, d, "facts_wide", lambda: _facts_wide(spark, d))


def _facts_wide(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    ep, dc, t, q = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity"))
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    core = ep * (1 - 5 * dc)
    parts = {
        "rev": ep * (1 - dc), "cor": ep * dc * 4, "rnd": ep * t * F.lit(0.5), "core": core,
        "tx": ep * t, "itax": ep * t * F.lit(0.2), "tx2": ep * t * 2, "tx3": ep * t * 3,
        "ep": ep, "epd": ep * dc, "qty": q,
        "eq": F.when(rf == "R", -ep).otherwise(ep),
        "cash": F.when(ls == "O", ep),
        "std": F.when((rf == "A") & (q < 10), ep),
        "ltd": F.when((rf == "A") & (q >= 45), ep),
        "td": F.when(q >= 48, ep),
        "ocf": F.when(rf == "N", ep).when(rf == "R", -ep),
        "capex": F.when(q > 40, ep),
    }
    # one quarter of an entity has few rows in a task's share of the table, so bare rows are less to move than sums of
    # many columns, and a task that holds whole quarters keeps few sums at a time
    rows = li.select(
        F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("qn"),
        "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus",
    ).repartition("entity", "y", "qn")
    quarters = rows.groupBy("entity", "y", "qn").agg(*[_money(v).alias(k) for k, v in parts.items()])
    # decimal sums are exact, so years add up from quarters without a second scan
    years = (
        quarters.groupBy("entity", "y")
        .agg(*[F.sum(k).alias(k) for k in parts])
        .withColumn("qn", F.lit(4))
    )
    both = quarters.withColumn("form", F.lit("quarterly")).unionByName(
        years.withColumn("form", F.lit("annual"))
    )
    v = {k: F.col(k).cast("double") for k in parts}
    place = read_table(spark, d, "supplier").join(
        read_table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")
    ).select(F.col("s_suppkey").alias("entity"), F.col("n_regionkey").alias("sector"))
    period_end = F.last_day(F.make_date("y", F.col("qn") * 3, F.lit(1)))
    return (
        both.select(
            "entity", "form", period_end.alias("period_end"),
            v["rev"].alias("revenue"), (v["rev"] - v["cor"]).alias("gross_profit"),
            v["cor"].alias("cost_of_revenue"), v["rnd"].alias("research_and_development"),
            (v["core"] - v["tx"]).alias("operating_income"), v["itax"].alias("income_tax"),
            (v["core"] - v["tx2"]).alias("income_before_tax"),
            (v["core"] - v["tx3"]).alias("net_income"),
            (v["ep"] * 3).alias("total_assets"), v["eq"].alias("total_equity"),
            v["cash"].alias("cash_and_cash_equivalents"), v["std"].alias("short_term_debt"),
            v["ltd"].alias("long_term_debt"), v["td"].alias("total_debt"),
            (v["qty"] * 100).alias("inventory"), v["ocf"].alias("operating_cash_flow"),
            (-v["capex"]).alias("capital_expenditure"),
            (v["tx"] - v["epd"]).alias("net_interest_income"),
            (v["rev"] * 2).alias("retained_earnings"),
        )
        .join(place, "entity")
        .withColumn("release_date", F.date_add("period_end", (20 + F.col("entity") % 40).cast("int")))
        .select("entity", "sector", "form", "period_end", "release_date", *POSITIONS)
    )


def source_of(entity: Column) -> Column:
    return F.when(entity % 3 == 0, "secondary").otherwise("primary")


def facts_long(spark: SparkSession, d: str) -> DataFrame:
    """F1 in long form with the missing contract: status decides, value is filled with 0."""
    wide = facts_wide(spark, d)
    ids = ["entity", "sector", "form", "period_end", "release_date"]
    long = wide.unpivot(ids, POSITIONS, "position", "v")
    return long.select(
        *ids,
        F.concat_ws("-", "entity", "form", "period_end").alias("accession"),
        source_of(F.col("entity")).alias("source"),
        "position",
        F.coalesce("v", F.lit(0.0)).alias("value"),
        F.when(F.col("v").isNull(), "missing").otherwise("selected").alias("selection_status"),
    )


def filed_reports(spark: SparkSession, d: str) -> DataFrame:
    """F1 with annual releases two weeks after the quarter's and some without a release."""
    f = facts_wide(spark, d)
    rel = F.when(F.col("form") == "annual", F.date_add("release_date", 15)).otherwise(F.col("release_date"))
    return f.withColumn("release_date", F.when(F.col("entity") % 25 != 7, rel)).withColumn(
        "source", source_of(F.col("entity"))
    )


def prices(spark: SparkSession, d: str) -> DataFrame:
    """one close per (entity, day)."""
    return stage(spark, d, "prices", lambda: _prices(spark, d))


def _prices(spark: SparkSession, d: str) -> DataFrame:
    # most days of an entity have one row, so sums before the shuffle would only fill memory
    return (
        read_table(spark, d, "lineitem")
        .select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("d"), "l_extendedprice", "l_quantity")
        .repartition("entity", "d")
        .groupBy("entity", "d")
        .agg((_money(F.col("l_extendedprice")).cast("double") / F.sum("l_quantity")).alias("adjusted_close"))
    )


def ship_month_reports(spark: SparkSession, d: str) -> DataFrame:
    """Report dates for the label operators: month ends on which an entity shipped."""
    return (
        read_table(spark, d, "lineitem")
        .select(F.col("l_suppkey").alias("entity"), F.last_day("l_shipdate").alias("release_date"))
        .distinct()
    )


def period_releases(spark: SparkSession, d: str) -> DataFrame:
    """order date as period end, ship date as release."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey", "l_linenumber",
        F.col("o_orderdate").alias("period_end"), F.col("l_shipdate").alias("release_date"),
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """candidate facts of filings."""
    li = read_table(spark, d, "lineitem")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("entity"),
        F.col("l_orderkey").alias("accession"),
        F.col("l_returnflag").alias("position"),
        F.col("l_linenumber").alias("line_no"),
        (1 + F.col("l_linenumber") % 3).alias("concept_priority"),
        F.when(F.col("l_linestatus") == "O", "companyfacts").otherwise("ixbrl").alias("source"),
        F.when(F.month("o_orderdate") == 12, "10-K").otherwise("10-Q").alias("form"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("o_orderdate")).alias("start_date"),
        F.col("l_shipdate").alias("end_date"),
        F.col("l_shipdate").alias("filed"),
        F.col("l_extendedprice").alias("value"),
    )


def filings(spark: SparkSession, d: str) -> DataFrame:
    """One filing per order: entity, accession, form, filing date, report date."""
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("entity"),
        F.col("o_orderkey").alias("accession"),
        F.when(F.month("o_orderdate") == 12, "10-K").otherwise("10-Q").alias("form"),
        F.col("o_orderdate").alias("filed"),
        F.last_day(F.add_months("o_orderdate", -1)).alias("report_date"),
    )


def text_scores(spark: SparkSession, d: str) -> DataFrame:
    """F5 scores: one text score per (entity, day)."""
    o = read_table(spark, d, "orders").crossJoin(F.broadcast(read_table(spark, d, "supplier").agg(F.count("*").alias("_n"))))  # one row
    return o.groupBy(
        (F.col("o_custkey") % F.col("_n")).alias("entity"), F.col("o_orderdate").alias("score_date")
    ).agg(
        F.max((F.col("o_orderkey") % 5) / F.lit(4.0)).alias("score"),
        F.max(F.when(F.col("o_orderstatus") == "F", "primary").otherwise("secondary")).alias("source"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """the newest order per (entity, quarter) as outcome with two predictors."""
    return stage(spark, d, "predictions", lambda: _predictions(spark, d))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    period = (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).cast("long")
    newest = o.groupBy(F.col("o_custkey").alias("entity"), period.alias("period")).agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("m")
    )
    key = F.col("m.o_orderkey")
    return newest.select(
        "entity", "period", F.col("m.o_orderdate").alias("rd"),
        r6(F.col("m.o_totalprice") / 10000.0 - 10).alias("y"),
        r6((key * 7919 % 1009) / 1009.0).alias("pred_a"),
        r6((key * 104729 % 997) / 997.0).alias("pred_b"),
        F.lit(0.5).alias("pred_c"),
    )


def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    """binary label with a score."""
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars")
    lab = read_table(spark, d, "labels")
    return docs.join(lab, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), r6(F.col("n_chars") / 20000.0).alias("score")
    )


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """one tick per event."""
    e = read_table(spark, d, "events")
    return e.select(F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
