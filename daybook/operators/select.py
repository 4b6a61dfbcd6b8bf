"""Fiscal calendars, best-fact selection, calculated items and discrete quarters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.exprs import fiscal_year

# fixed values
ANNUAL_BAND = (300, 450)
QUARTER_BAND = (70, 120)
ANNUAL_MIN_DAYS = 300
QUARTER_MAX_DAYS = 130
FLOW_STATEMENTS = ("income_statement", "cash_flow_statement")
ABSOLUTE_POSITIONS = ("capital_expenditure",)


def fye_month(filings: DataFrame, entity: str = "entity", date: str = "report_date", annual_forms: Sequence[str] = ("10-K",)) -> DataFrame:
    """Most frequent month of annual period ends, smallest on ties, 12 without any.

    Counts per (entity, month) first: twelve rows per entity decide the mode.
    """
    annual = F.col("form").isin(*annual_forms) & F.col(date).isNotNull()
    n = filings.groupBy(entity, F.when(annual, F.month(date)).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    top = n.groupBy(entity).agg(
        F.max(F.when(F.col("_m").isNotNull(), F.struct("_n", (-F.col("_m")).alias("neg")))).alias("_t")
    )
    return top.select(entity, F.coalesce(-F.col("_t.neg"), F.lit(12)).alias("fye_month"))


def with_fiscal_year(df: DataFrame, fye: DataFrame, entity: str = "entity", date: str = "report_date") -> DataFrame:
    return df.join(fye, entity).withColumn("fiscal_year", fiscal_year(date, "fye_month"))


def last_n_years(df: DataFrame, n: int = 6, entity: str = "entity", year: str = "fiscal_year") -> DataFrame:
    """Rows of the newest ``n`` distinct fiscal years an entity has."""
    years = df.select(entity, year).distinct()
    w = Window.partitionBy(entity).orderBy(F.col(year).desc())
    kept = years.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    return df.join(kept, [entity, year], "left_semi")


def latest_per_period(filings: DataFrame, keys: Sequence[str] = ("entity", "form", "report_date"), order: Sequence[str] = ("filed", "accession")) -> DataFrame:
    """Newest filing per key as one aggregate."""
    rest = [c for c in filings.columns if c not in keys and c not in order]
    top = filings.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return top.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in (*order, *rest)])


def select_best_fact(candidates: DataFrame, group: Sequence[str] = ("accession", "position"), tie: str = "line_no") -> DataFrame:
    """One fact per (accession, position), chosen by statement, form and report date.

    Each candidate gets a tier (lower is better) and tier-specific sort keys; a single
    ``min`` over the packed keys picks the winner, so a hot filing combines on the map side.
    Candidates equal in all keys are told apart by their dates and value.
    Needs columns statement, form, report_date, start_date, end_date, filed, source,
    concept_priority and value.
    """
    c = F.col
    days = F.datediff("end_date", "start_date")
    balance = c("statement") == "balance_sheet"
    exact = F.coalesce(c("end_date") == c("report_date"), F.lit(False))
    instant = c("start_date").isNull() | (F.coalesce(days, F.lit(0)) == 0)
    valid = F.coalesce(days > 0, F.lit(False))
    annual, quarter = c("form") == "10-K", c("form") == "10-Q"
    in_band = (annual & days.between(*ANNUAL_BAND)) | (quarter & days.between(*QUARTER_BAND)) | (~annual & ~quarter)
    tier = (
        F.when(balance, F.when(exact, 1).when(instant, 2).otherwise(3))
        .when(~valid, 9)
        .when(exact, F.when(in_band, 4).otherwise(5))
        .otherwise(F.when(in_band, 6).otherwise(7))
    )
    # outside the band annual reports want the longest span, quarterly ones the shortest
    span = F.when(tier.isin(5, 7), F.when(annual, -days).otherwise(days)).otherwise(0)
    source = F.when(c("source") == "companyfacts", 1).when(c("source") == "ixbrl", 2).otherwise(9)
    newest_end = F.when(tier == 2, -F.unix_date("end_date")).otherwise(0)
    picked = candidates.groupBy(*group).agg(
        F.min(
            F.struct(
                tier.alias("tier"), span.alias("span"), c("concept_priority"), source.alias("sp"),
                newest_end.alias("ne"), (-F.unix_date("filed")).alias("nf"), c(tie),
                days.alias("days"), c("start_date"), c("end_date"), c("filed"), c("source"), c("form"), c("statement"), c("value"),
            )
        ).alias("m")
    )
    t, d, form = c("m.tier"), c("m.days"), c("m.form")
    too_short = t.isin(5, 7) & (form == "10-K") & (d < ANNUAL_MIN_DAYS)
    status = (
        F.when(too_short, "missing")
        .when(t == 1, F.when(c("m.source") == "ixbrl", "selected_ixbrl_balance_sheet_exact_report_date").otherwise("selected_companyfacts_balance_sheet_exact_report_date"))
        .when(t == 2, "selected_balance_sheet_fallback_latest_instant_check")
        .when(t == 3, "selected_balance_sheet_fallback_check")
        .when(t == 9, "selected_no_duration_available_check")
        .when(t == 4, F.when(form == "10-K", "selected_annual_duration_exact_end_date").when(form == "10-Q", "selected_quarter_duration_exact_end_date").otherwise("selected_default_exact_end_date"))
        .when(t == 5, F.when(form == "10-K", "selected_annual_exact_end_date_duration_fallback_check").otherwise("selected_quarter_exact_end_date_duration_fallback_check"))
        .when(t == 6, F.when(form == "10-K", "selected_annual_duration_without_exact_end_date_check").when(form == "10-Q", "selected_quarter_duration_without_exact_end_date_check").otherwise("selected_default_duration_without_exact_end_date_check"))
        .otherwise(F.when(form == "10-K", "selected_longest_duration_annual_without_exact_end_date_check").otherwise("selected_shortest_duration_quarter_without_exact_end_date_check"))
    )
    def keep(x: Column) -> Column:
        return F.when(~too_short, x)
    return picked.select(
        *group, keep(c("m.value")).alias("value"), keep(c("m.start_date")).alias("start_date"),
        keep(c("m.end_date")).alias("end_date"), keep(d).alias("duration_days"),
        keep(c("m.source")).alias("source"), keep(c(f"m.{tie}")).alias(tie), status.alias("selection_status"),
    )


def filing_grid(filings: DataFrame, positions: Sequence[str] | DataFrame, facts: DataFrame, key: str = "accession", entity: str = "entity") -> DataFrame:
    """Every filing with every needed position; positions without a fact are ``missing``.

    ``positions``: a list for all, or (``entity``, position) rows with those each entity needs.
    """
    if isinstance(positions, DataFrame):
        grid = filings.join(positions.select(entity, "position").distinct(), entity)
    else:
        grid = filings.select("*", F.explode(F.array(*[F.lit(p) for p in positions])).alias("position"))
    add = [c for c in facts.columns if c not in filings.columns or c == key]
    out = grid.join(facts.select(*add), [key, "position"], "left")
    return out.withColumn("selection_status", F.coalesce("selection_status", F.lit("missing")))


def sign_rules(rows: DataFrame, positions: Sequence[str] = ABSOLUTE_POSITIONS, value: str = "value") -> DataFrame:
    v = F.when(F.col("position").isin(*positions), F.abs(value)).otherwise(F.col(value))
    return rows.withColumn(value, v)


@dataclass(frozen=True)
class CalcRule:
    """A rule holds for all, or for one ``group``, or for one ``entity``; for a target the narrowest scope counts."""

    target: str
    components: tuple[tuple[str, float], ...]
    overwrite_existing: bool = False
    missing_components_as_zero: bool = False
    require_at_least_one_component: bool = False
    group: object = None
    entity: object = None


def _in_scope(r: CalcRule, rules: Sequence[CalcRule], group: str, entity: str) -> Column:
    """Rows that the rule is for: not those with a rule of narrower scope for the same target."""
    if r.entity is not None:
        return F.col(entity).eqNullSafe(F.lit(r.entity))
    same = [x for x in rules if x.target == r.target]
    own = [x.entity for x in same if x.entity is not None]
    out = ~F.coalesce(F.col(entity).isin(own), F.lit(False)) if own else F.lit(True)
    if r.group is not None:
        return out & F.col(group).eqNullSafe(F.lit(r.group))
    groups = [x.group for x in same if x.group is not None]
    return out & ~F.coalesce(F.col(group).isin(groups), F.lit(False)) if groups else out


def _apply_rule(df: DataFrame, r: CalcRule, scope: Column) -> DataFrame:
    total: Column = F.lit(0.0)
    found: Column = F.lit(False)
    ready: Column = F.lit(True)
    for name, w in r.components:
        v = F.col(name)
        total = total + F.coalesce(v * F.lit(float(w)), F.lit(0.0))
        found = found | v.isNotNull()
        if not r.missing_components_as_zero:
            ready = ready & v.isNotNull()
    if r.require_at_least_one_component:
        ready = ready & found
    go = ready if r.overwrite_existing else ready & F.col(r.target).isNull()
    go = go & F.col(f"_row_{r.target}") & scope
    return df.withColumn("_go", go).withColumns(
        {
            r.target: F.when(F.col("_go"), total).otherwise(F.col(r.target)),
            f"_calc_{r.target}": F.col(f"_calc_{r.target}") | F.col("_go"),
        }
    ).drop("_go")


def apply_calculations(rows: DataFrame, rules: Sequence[CalcRule], keys: Sequence[str], positions: Sequence[str], max_passes: int = 5, group: str = "grp", entity: str = "entity") -> DataFrame:
    """Fill target positions from weighted components, rule by rule.

    Positions become columns, so a rule is one projection. A later pass repeats only rules
    whose components may have moved since they ran. Long rows in, long rows out. Columns that scopes
    refer to must be among the keys.
    """
    # components may be rows the caller does not list as positions, or not exist at all
    names = list(dict.fromkeys([*positions, *[n for r in rules for n in (r.target, *[c for c, _ in r.components])]]))
    present = rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("position") == p, F.col("value"))).alias(p) for p in names],
        *[F.max(F.col("position") == p).alias(f"_row_{p}") for p in names],
    )
    targets = [r.target for r in rules]
    wide = present.withColumns({f"_calc_{t}": F.lit(False) for t in dict.fromkeys(targets)})
    todo = list(rules)
    for _ in range(max_passes):
        if not todo:
            break
        for r in todo:
            wide = _apply_rule(wide, r, _in_scope(r, rules, group, entity))
        moved = {r.target for r in todo}
        again: list[CalcRule] = []
        for i, r in enumerate(rules):
            # fed by a target computed at or after it last time, or by a rule that runs again
            fed = {n for n, _ in r.components}
            later = {n for n in targets[i:] if n in moved}
            if fed & (later | {a.target for a in again}):
                again.append(r)
        todo = again
    entries = [
        F.struct(
            F.lit(p).alias("position"), F.col(p).alias("value"), F.col(f"_row_{p}").alias("has"),
            (F.col(f"_calc_{p}") if p in targets else F.lit(False)).alias("calculated"),
        )
        for p in positions
    ]
    long = wide.select(*keys, F.explode(F.array(*entries)).alias("x")).filter("x.has")
    status = F.when(F.col("x.calculated"), "calculated_from_components").when(F.col("x.value").isNull(), "missing").otherwise("selected")
    return long.select(*keys, "x.position", "x.value", status.alias("selection_status"))


def zero_fill(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.withColumn(value, F.coalesce(value, F.lit(0.0)))


def decumulate_ytd(rows: DataFrame, fye: DataFrame, entity: str = "entity", limit: int = QUARTER_MAX_DAYS) -> DataFrame:
    """Year-to-date quarterly flows to discrete quarters.

    The row before is looked up among the original rows, so one pass is exact. It is the
    previous filing of the same day or the last one of the previous day: days are reduced by
    an aggregate first, so an entity with very many filings is never sorted in one task.
    Other rows pass through unchanged.
    """
    c = F.col
    flow = (
        (c("form") == "10-Q") & c("statement").isin(*FLOW_STATEMENTS) & (c("selection_status") != "missing")
        & c("duration_days").isNotNull() & c("end_date").isNotNull()
    )
    work = rows.join(fye, entity, "left").withColumn("_flow", F.coalesce(flow, F.lit(False))).withColumn(
        "_fy", fiscal_year("end_date", F.coalesce("fye_month", F.lit(12)))
    )
    group = [entity, "position", "_fy"]
    own = work.filter("_flow")
    # last original row of every day; a fiscal year has at most 366 of them
    days = own.groupBy(*group, "end_date").agg(F.max_by(F.struct("value"), "accession").alias("_v"))
    w_day = Window.partitionBy(*group).orderBy("end_date")
    before = days.select(
        *group, "end_date", F.lag("_v").over(w_day).alias("_dv"), F.lag("end_date").over(w_day).alias("_de")
    )
    w_in = Window.partitionBy(*group, "end_date").orderBy("accession")
    first = F.row_number().over(w_in) == 1
    same = own.withColumn("_first", first).withColumn("_sv", F.lag("value").over(w_in))
    seen = same.join(before, [*group, "end_date"]).withColumns(
        {
            "_pv": F.when(c("_first"), c("_dv.value")).otherwise(c("_sv")),
            "_pe": F.when(c("_first"), c("_de")).otherwise(c("end_date")),
        }
    ).select(*rows.columns, "_flow", "_pv", "_pe")
    rest = work.filter("not _flow").select(
        *rows.columns, "_flow", F.lit(None).cast("double").alias("_pv"), F.lit(None).cast("date").alias("_pe")
    )
    seen = seen.unionByName(rest)
    cum = c("_flow") & (c("duration_days") > limit)
    gap = F.datediff("end_date", "_pe")
    usable = c("_pe").isNotNull() & c("_pv").isNotNull() & c("value").isNotNull() & (gap <= limit)
    usable = F.coalesce(usable, F.lit(False))
    marked = F.when(c("selection_status").endswith("+decumulated"), c("selection_status")).otherwise(
        F.concat("selection_status", F.lit("+decumulated"))
    )
    def pick(fixed: Column, dropped: Column, same: Column) -> Column:
        return F.when(~cum, same).when(usable, fixed).otherwise(dropped)
    out = seen.select(
        *[x for x in rows.columns if x not in ("value", "start_date", "duration_days", "selection_status")],
        pick(c("value") - c("_pv"), F.lit(None).cast("double"), c("value")).alias("value"),
        pick(c("_pe"), c("start_date"), c("start_date")).alias("start_date"),
        pick(gap, c("duration_days"), c("duration_days")).alias("duration_days"),
        pick(marked, F.lit("missing"), c("selection_status")).alias("selection_status"),
    )
    return out.select(*rows.columns)
