"""Modelling-table queries (M) and their shared oracle CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions.exprs import r6
from daybook.operators import peers, table
from daybook.plans import fixtures as fx
from daybook.plans import q_kpi as _kpi_ctes  # noqa: F401  (its CTEs are used here)
from daybook.plans import stages as st
from daybook.plans.oracle import cte, sql
from daybook.plans.q_label import report_labels
from daybook.plans.registry import query

KEYS = table.KEYS
_KP = ", ".join(f'k."{c}"' for c in table.KPI_FEATURES)
_SC = ", ".join(f"s.{c}" for c in table.SCORE_FEATURES)
cte(
    "tx",
    """select s.entity, s.report_date,
  coalesce(e.score, a.score) text_score, case when e.score is not null then 'exact' when a.score is not null then 'asof' end text_match,
  coalesce(e.score_date, a.score_date) text_asof_date
from sc s left join f5s e on e.entity = s.entity and e.score_date = s.report_date
left join (select s.entity, s.report_date, max(score_date) ad from sc s join f5s t on t.entity = s.entity
   and t.score_date <= s.report_date and t.source = 'secondary' group by 1, 2) m on m.entity = s.entity and m.report_date = s.report_date
left join f5s a on a.entity = m.entity and a.score_date = m.ad""",
    "sc", "f5s",
)
cte(
    "asm",
    f"""select s.entity, s.report_date, s.sector, s.source, s.form, s.frequency, s.period, s.period_end, s.release_date, s.peer_group_size,
  {_SC}, {_KP}, l.ret, l.vol, l.sharpe, t.text_score, t.text_match, t.text_asof_date,
  case when t.text_score is not null and s.financial_score is not null then s.financial_score * cast(0.5 as double) + t.text_score * cast(0.5 as double)
    else s.financial_score end blended_score,
  case when l.sharpe is null then 1 else 0 end target_missing, case when t.text_score is null then 1 else 0 end text_missing,
  case when s.release_date is null then 1 else 0 end no_release_date
from sc s left join k on k.entity = s.entity and k.report_date = s.report_date
left join labr l on l.entity = s.entity and l.release_date = s.report_date
left join tx t on t.entity = s.entity and t.report_date = s.report_date""",
    "sc", "k", "labr", "tx",
)
cte(
    "wb",
    "select " + ", ".join(f'quantile_cont("{c}", 0.01) "lo_{c}", quantile_cont("{c}", 0.99) "hi_{c}"' for c in table.CLIP_COLS) + " from asm",
    "asm",
)
cte(
    "win",
    "select asm.* replace ("
    + ", ".join(f'case when "{c}" is not null then least(greatest("{c}", "lo_{c}"), "hi_{c}") end as "{c}"' for c in table.CLIP_COLS)
    + "), "
    + ", ".join(f'"{c}" as "{c}_raw"' for c in table.CLIP_COLS)
    + " from asm cross join wb",
    "asm", "wb",
)
cte(
    "chg",
    "select *, lag(report_date) over w prior_release_date, case when lag(report_date) over w is null then 1 else 0 end first_obs, "
    + ", ".join(f'"{c}" - lag("{c}") over w "{c}_change"' for c in table.CHANGE_COLS)
    + " from win window w as (partition by entity, frequency order by report_date)",
    "win",
)
cte(
    "md",
    """select *, case when target_missing = 0 and first_obs = 0 and
  count(*) filter (where target_missing = 0 and first_obs = 0) over (partition by entity) >= 6 then 1 else 0 end train_eligible from chg""",
    "chg",
)
cte("el", "select * from md where train_eligible = 1", "md")


def rcols(cols):
    return ", ".join(f'round("{c}",6) as "{c}"' for c in cols)


def scols(cols):
    return [r6(c).alias(c) for c in cols]


@query("m1_pivot_kpis", sql(f"select entity, report_date, {rcols(table.KPI_FEATURES)} from k", "k"))
def m1(s, d):
    return table.pivot_kpis(st.kpis_long(s, d)).select(*KEYS, *scols(table.KPI_FEATURES))


@query("m2_asof_score", sql("select entity, report_date, text_score, text_match, text_asof_date from tx", "tx"))
def m2(s, d):
    spine = st.scores(s, d).select(*KEYS)
    return table.asof_score(spine, fx.text_scores(s, d), "secondary")


_ASM = [*table.SCORE_FEATURES, "blended_score", "ret", "vol", "sharpe", "net_margin", "ROIC"]

_ASM_SQL = ", ".join(f'round("{c}",{9 if c.endswith("score") else 6}) as "{c}"' for c in _ASM)


@query(
    "m3_assemble",
    sql(f"select entity, report_date, sector, source, form, frequency, period, period_end, peer_group_size, text_score, {_ASM_SQL} from asm", "asm"),
)
def m3(s, d):
    out = table.assemble(st.scores(s, d), st.kpis(s, d), report_labels(s, d), fx.text_scores(s, d), "secondary")
    return out.select(
        *KEYS, "sector", "source", "form", "frequency", "period", "period_end", "peer_group_size", "text_score",
        *[F.round(c, 9).alias(c) for c in _ASM if c.endswith("score")], *scols([c for c in _ASM if not c.endswith("score")]),
    )


@query("m4_flags", sql("select entity, report_date, target_missing, text_missing, no_release_date from asm", "asm"))
def m4(s, d):
    return st.assembled(s, d).select(*KEYS, "target_missing", "text_missing", "no_release_date")


_WIN = [*table.CLIP_COLS, *[f"{c}_raw" for c in table.CLIP_COLS]]


@query("m5_winsorize", sql(f"select entity, report_date, {rcols(_WIN)} from win", "win"))
def m5(s, d):
    return table.winsorize(st.assembled(s, d)).select(*KEYS, *scols(_WIN))


@query(
    "m5_winsor_report",
    sql(" union all ".join(
        f"""select '{c}' feature, count("{c}") n, round(max("lo_{c}"),6) lo, round(max("hi_{c}"),6) hi,
 cast(count(*) filter (where "{c}" < "lo_{c}") as bigint) capped_lo, cast(count(*) filter (where "{c}" > "hi_{c}") as bigint) capped_hi from asm cross join wb"""
        for c in table.CLIP_COLS), "asm", "wb"),
)
def m5b(s, d):
    out = table.winsor_report(st.assembled(s, d))
    return out.withColumn("lo", r6("lo")).withColumn("hi", r6("hi"))


_CHG = [f"{c}_change" for c in table.CHANGE_COLS]


@query("m6_change_features", sql("select entity, report_date, " + ", ".join(f'round("{c}",9) + 0e0 as "{c}"' for c in _CHG) + " from chg", "chg"))
def m6(s, d):
    out = table.change_features(table.winsorize(st.assembled(s, d)))
    return out.select(*KEYS, *[F.round(c, 9).alias(c) for c in _CHG])


@query("m7_first_obs", sql("select entity, report_date, frequency, first_obs, prior_release_date from chg", "chg"))
def m7(s, d):
    return table.change_features(st.assembled(s, d), []).select(*KEYS, "frequency", "first_obs", "prior_release_date")


@query("m8_train_eligible", sql("select entity, report_date, train_eligible from md", "md"))
def m8(s, d):
    return table.train_eligible(table.change_features(st.assembled(s, d), [])).select(*KEYS, "train_eligible")


cte(
    "oc",
    """select entity, count(*) total, cast(sum(1 - target_missing) as bigint) with_target, cast(sum(1 - first_obs) as bigint) with_change,
 count(*) filter (where target_missing = 0 and first_obs = 0) usable from md group by 1""",
    "md",
)


@query("m9_observation_counts", sql("select * from oc", "oc"))
def m9(s, d):
    return table.observation_counts(st.modelling(s, d))


@query("m9_observation_histogram", sql("select usable, count(*) companies from oc group by 1", "oc"))
def m9b(s, d):
    return table.observation_histogram(st.modelling(s, d))


@query(
    "m10_floor_sensitivity",
    sql("""select floor, count(*) companies, cast(sum(usable) as bigint) usable_rows from oc
 join (select unnest([1,2,3,4,5,6,8,10]) floor) f on usable >= floor group by 1""", "oc"),
)
def m10(s, d):
    return table.floor_sensitivity(st.modelling(s, d))


@query(
    "m11_coverage_by_match",
    sql("""select coalesce(text_match, 'missing') as match, count(*) n, cast(count(*) filter (where text_asof_date > report_date) as bigint) after_report,
 count(distinct entity) entities from md group by 1""", "md"),
)
def m11(s, d):
    return table.coverage_by_match(st.modelling(s, d))


@query("m11_missing_by_source", sql("select source, cast(sum(text_missing) as bigint) n_missing from md group by 1", "md"))
def m11b(s, d):
    return table.missing_by_source(st.modelling(s, d))


_NAN = [*table.SCORE_FEATURES, *table.TEXT_FEATURES, *table.KPI_FEATURES, *_CHG, *table.LABEL_COLS]


@query(
    "m12_nan_scan",
    sql("select count(*) \"rows\", cast(" + " + ".join(f'count(*) filter (where isnan("{c}"))' for c in _NAN) + " as bigint) nan_cells from md", "md"),
)
def m12(s, d):
    return table.nan_scan(st.modelling(s, d), _NAN)


@query(
    "c8_blend",
    sql("select entity, report_date, round(blended_score,9) blended_score from asm", "asm"),
)
def c8(s, d):
    a = st.assembled(s, d)
    return a.select(*KEYS, F.round(peers.blend(F.col("financial_score"), F.col("text_score")), 9).alias("blended_score"))
