"""Keyed storage rules and fact-table summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.functions.exprs import flag, nan_to_null


def upsert(target: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins per key, nothing is deleted. One aggregate over both tables.

    ``order``: columns of the batch that say which of several rows of a key was written last; rows that
    tie in them are decided by their values, so that runs agree. ``target`` has one row per key.
    """
    cols = target.columns
    rest = [c for c in cols if c not in key]
    old = target.select(*cols, F.lit(0).alias("_b"), *[F.lit(None).cast(batch.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)])
    new = batch.select(*cols, F.lit(1).alias("_b"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    at = F.struct("_b", *[f"_o{i}" for i in range(len(order))], *rest)
    top = old.unionByName(new).groupBy(*key).agg(F.max(at).alias("_m"))
    return top.select(*key, *[F.col(f"_m.{c}").alias(c) for c in rest]).select(*cols)


def find_restatements(new: DataFrame, existing: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    n = new.select(*key, F.col(value).alias("new_value"))
    o = existing.select(*key, F.col(value).alias("old_value"))
    return n.join(o, list(key)).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def find_orphans(new: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    return existing.select(*key).join(new.select(*key), list(key), "left_anti")


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, Column]) -> DataFrame:
    """Project to a fixed schema: missing columns added, defaults filled, NaN to NULL."""
    out = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            c = nan_to_null(c)
        if f.name in defaults:
            c = F.coalesce(c, defaults[f.name].cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def read_facts(facts: DataFrame, **equal: object) -> DataFrame:
    """Optional equality predicates (pushed to the scan), newest report first per entity."""
    for c, v in equal.items():
        if v is not None:
            facts = facts.filter(F.col(c) == F.lit(v))
    return facts.orderBy("entity", F.col("period_end").desc(), "form", "position")


def available_periods(facts: DataFrame, **equal: object) -> DataFrame:
    for c, v in equal.items():
        facts = facts.filter(F.col(c) == F.lit(v))
    cols = ["entity", "form", "accession", "release_date", "period_end"]
    return facts.select(*cols).distinct().orderBy(F.col("period_end").desc(), "entity", "form")


def _missing() -> Column:
    return F.col("selection_status") == "missing"


def missing_summary(facts: DataFrame) -> DataFrame:
    return facts.filter(_missing()).groupBy("entity", "position").agg(F.count(F.lit(1)).alias("missing_count"))


def validation_summary(facts: DataFrame) -> DataFrame:
    """Per entity: filings, rows, missing, calculated and tagged rows.

    Filings are counted after a first aggregation per filing, so no distinct set is built.
    """
    per_filing = facts.groupBy("entity", "accession").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(_missing())).alias("m"),
        F.sum(flag(F.col("extraction_method") == "calculated")).alias("c"),
        F.sum(flag(F.col("extraction_method") == "ixbrl_dimensional")).alias("x"),
    )
    return per_filing.groupBy("entity").agg(
        F.count(F.lit(1)).alias("filings"), F.sum("n").alias("n_rows"), F.sum("m").alias("missing_values"),
        F.sum("c").alias("calculated_rows"), F.sum("x").alias("ixbrl_rows"),
    )


def suspicious_repeats(facts: DataFrame, minimum: int = 4) -> DataFrame:
    """The same (entity, position, value) in at least ``minimum`` filings."""
    once = facts.filter(F.col("value").isNotNull()).select("entity", "position", "value", "accession").distinct()
    n = once.groupBy("entity", "position", "value").agg(F.count(F.lit(1)).alias("repeated_in_filings"))
    return n.filter(F.col("repeated_in_filings") >= minimum)


def select_universe(members: DataFrame, groups: Sequence[str], active: DataFrame, active_sectors: DataFrame) -> DataFrame:
    """Distinct active entities of the targeted groups in active sectors."""
    own = members.filter(F.col("company_group").isin(*groups))
    return (
        own.join(active, "entity", "left_semi").join(active_sectors, "sector", "left_semi").select("entity").distinct()
    )


def unknown_groups(members: DataFrame, groups: Sequence[str]) -> DataFrame:
    want = members.sparkSession.createDataFrame([(g,) for g in groups], "company_group string")
    return want.join(members.select("company_group").distinct(), "company_group", "left_anti")


def require_known_groups(members: DataFrame, groups: Sequence[str]) -> None:
    bad = [r[0] for r in unknown_groups(members, groups).collect()]  # at most the listed groups
    if bad:
        raise ValueError(f"unknown groups: {sorted(bad)}")


def reconcile_dates(stored: DataFrame, truth: DataFrame, key: Sequence[str], date: str = "filed") -> DataFrame:
    """match / mismatch / absent per stored row with the gap in days of mismatches."""
    t = truth.select(*key, F.col(date).alias("_true"))
    out = stored.join(t, list(key), "left")
    status = F.when(F.col("_true").isNull(), "absent").when(F.col("_true").eqNullSafe(F.col(date)), "match").otherwise("mismatch")
    return out.select(*key, status.alias("status"), F.when(status == "mismatch", F.abs(F.datediff("_true", date))).alias("gap_days"))


def reconcile_counts(rec: DataFrame) -> DataFrame:
    return rec.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("gap_days").alias("max_gap_days"))


def tag_keywords(labels: DataFrame, label: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(label, group) for every keyword group with a case-insensitive hit."""
    low = F.lower(F.col(label))
    hits = [
        F.when(low.rlike("|".join(f"\\Q{k.lower()}\\E" for k in ks)), F.lit(g)) for g, ks in groups.items()
    ]
    return labels.select(label).distinct().select(label, F.explode(F.array_compact(F.array(*hits))).alias("keyword_group"))


def check_reference_maps(active: DataFrame, mapped: DataFrame, rules: DataFrame, known: DataFrame, member_of: DataFrame) -> DataFrame:
    """Problems of the mapping tables as rows (check_name, key); none means sound.

    ``active`` (grp, position), ``mapped`` (grp, position), ``rules`` (grp, target, component),
    ``known`` entities, ``member_of`` (entity, grp).
    """
    targets = rules.select("grp", F.col("target").alias("position"))
    resolvable = mapped.select("grp", "position").unionByName(targets).distinct()
    open_pos = active.join(resolvable, ["grp", "position"], "left_anti").select(
        F.lit("position_unresolved").alias("check_name"), F.concat_ws(":", "grp", "position").alias("key")
    )
    parts = rules.select("grp", F.col("component").alias("position")).distinct()
    open_part = parts.join(resolvable, ["grp", "position"], "left_anti").select(
        F.lit("component_unresolved").alias("check_name"), F.concat_ws(":", "grp", "position").alias("key")
    )
    twice = member_of.distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("entity_in_two_groups").alias("check_name"), F.col("entity").cast("string").alias("key")
    )
    strange = member_of.select("entity").distinct().join(known, "entity", "left_anti").select(
        F.lit("unknown_entity").alias("check_name"), F.col("entity").cast("string").alias("key")
    )
    return open_pos.unionByName(open_part).unionByName(twice).unionByName(strange)
