"""Filing lists, nested fact documents and candidate facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
TARGET_FORMS = ("10-K", "10-Q")
TARGET_UNIT = "USD"

_FACT = T.StructType(
    [
        T.StructField("val", T.DoubleType()), T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()), T.StructField("fy", T.IntegerType()),
        T.StructField("fp", T.StringType()), T.StructField("form", T.StringType()),
        T.StructField("filed", T.StringType()), T.StructField("frame", T.StringType()),
        T.StructField("accn", T.StringType()),
    ]
)
FACTS_JSON = T.MapType(
    T.StringType(),
    T.MapType(
        T.StringType(),
        T.StructType(
            [
                T.StructField("label", T.StringType()),
                T.StructField("units", T.MapType(T.StringType(), T.ArrayType(_FACT))),
            ]
        ),
    ),
)


def _first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key as an aggregate: a hot key is reduced on the map side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_m"))
    return top.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in (*order, *rest)])


def union_filings(parts: Sequence[DataFrame], key: str = "accession", dates: Sequence[str] = ("filed", "report_date")) -> DataFrame:
    """Union by name, first source wins per accession, unreadable dates become NULL."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_src", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    first = _first_per_key(out, [key], ["_src"]).drop("_src")
    return first.withColumns({c: F.try_to_date(F.col(c)) for c in dates if c in first.columns})


def union_entities(parts: dict[str, DataFrame], key: str = "accession") -> DataFrame:
    """Filings of one entity under several ids, tagged with the id they came from."""
    return union_filings([df.withColumn("filing_id", F.lit(i)) for i, df in parts.items()], key)


def flatten_facts(docs: DataFrame, json: str) -> DataFrame:
    """Nested fact document to rows: taxonomy, concept, unit, label and the fact fields.

    Documents that cannot be read have no rows here; ``unreadable_documents`` has them.
    """
    keep = [c for c in docs.columns if c != json]
    tax = docs.select(*keep, F.explode(F.from_json(json, FACTS_JSON)).alias("taxonomy", "_c"))
    con = tax.select(*keep, "taxonomy", F.explode("_c").alias("concept", "_b"))
    unit = con.select(*keep, "taxonomy", "concept", F.col("_b.label").alias("label"), F.explode("_b.units").alias("unit", "_f"))
    fact = unit.select(*keep, "taxonomy", "concept", "label", "unit", F.explode("_f").alias("_x"))
    return fact.select(*keep, "taxonomy", "concept", "label", "unit", "_x.*")


def unreadable_documents(docs: DataFrame, json: str) -> DataFrame:
    """Documents that are missing or do not parse, as they are."""
    return docs.filter(F.from_json(json, FACTS_JSON).isNull())


def concept_map(spark, rows: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(position, concept, concept_priority), as small as its literal."""
    return spark.createDataFrame(list(rows), "position string, concept string, concept_priority int")


def scoped(by_group: DataFrame, by_entity: DataFrame, members: DataFrame, item: str = "position", group: str = "grp", entity: str = "entity") -> DataFrame:
    """Rules of each entity: those of its group, but for an item that has rules of the entity's own, only these.

    ``by_group`` has ``group`` and ``by_entity`` has ``entity`` beside the rule columns; ``members`` has one
    (``entity``, ``group``) row per entity.
    """
    inherited = by_group.join(members.select(entity, group), group).drop(group)
    own = by_entity.select(entity, item).distinct()
    return inherited.join(own, [entity, item], "left_anti").unionByName(by_entity)


def _on(rules: DataFrame, *cols: str) -> list[str]:
    """Rules with an entity column hold for that entity only."""
    return [*cols, *[c for c in ("entity",) if c in rules.columns]]


def candidate_facts(facts: DataFrame, mapping: DataFrame, filings: DataFrame, key: str = "accession") -> DataFrame:
    """Facts of mapped concepts in the selected filings, target forms and unit only. ``mapping``: one for all, or one
    per entity as ``scoped`` gives it."""
    wanted = facts.filter(F.col("form").isin(*TARGET_FORMS) & (F.col("unit") == TARGET_UNIT))
    mapped = wanted.join(mapping, _on(mapping, "concept"))
    return mapped.join(filings.select(key), key, "left_semi").withColumn("source", F.lit("companyfacts"))


def with_duration(df: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    d = {c: F.try_to_date(F.col(c)) if t == "string" else F.col(c) for c, t in df.dtypes if c in (start, end)}
    out = df.withColumns(d)
    return out.withColumn("duration_days", F.datediff(end, start))


def dimensions_match(dims: Column, needed: Column) -> Column:
    """``needed``: array of (axes, members). Every entry must find one of its axes with an
    allowed member; without entries only facts free of dimensions pass."""
    def met(r: Column) -> Column:
        axis = F.try_element_at(F.filter(r["axes"], lambda a: F.map_contains_key(dims, a)), F.lit(1))
        member = F.try_element_at(dims, axis)
        return F.coalesce(F.array_contains(r["members"], member), F.lit(False))

    none = needed.isNull() | (F.size(needed) == 0)
    return F.when(none, F.size(dims) == 0).otherwise(F.forall(needed, met))


_NEED = "array<struct<axes:array<string>,members:array<string>>>"


def inline_rules(spark, rows: Sequence[tuple]) -> DataFrame:
    """(position, concept, concept_priority, needed), as small as its literal."""
    return spark.createDataFrame(list(rows), f"position string, concept string, concept_priority int, needed {_NEED}")


def filter_dimensions(facts: DataFrame, needed: Column, dims: str = "dimensions") -> DataFrame:
    return facts.filter(dimensions_match(F.col(dims), needed.cast(_NEED)))


def dedupe_dimensional(facts: DataFrame, keys: Sequence[str], order: Sequence[str], dims: str = "dimensions") -> DataFrame:
    """Drop repeats of the same fact; dimension entries compare regardless of their order."""
    sig = F.to_json(F.array_sort(F.map_entries(F.col(dims))))
    return _first_per_key(facts.withColumn("_sig", sig).drop(dims), [*keys, "_sig"], order).withColumnRenamed("_sig", "dimension_key")


def inline_candidates(facts: DataFrame, rules: DataFrame, filings: DataFrame, key: str = "accession", dims: str = "dimensions") -> DataFrame:
    """Tagged facts that satisfy a rule, as candidate rows of their filing. ``rules``: one list for all, or one per
    entity as ``scoped`` gives it."""
    hit = facts.join(rules, _on(rules, "concept")).filter(dimensions_match(F.col(dims), F.col("needed")))
    tax = F.when(F.lower("raw_concept").startswith("us-gaap:"), "us-gaap").otherwise("company_extension_ixbrl")
    own = filings.select(key, "form", "filed")
    return hit.drop("needed").join(own, key).withColumns({"taxonomy": tax, "unit": F.lit(TARGET_UNIT), "source": F.lit("ixbrl")})


def combine_candidates(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
