"""Exact ranks, quantiles and order positions without an unbounded sort group.

A plain ``Window.partitionBy(group).orderBy(value)`` puts a whole group into one task. Here a
group is first reduced to its distinct values (map-side combine, so a hot value is one row).
Those are cut into runs at the distinct values whose hash falls on a fixed residue: about one in
``RUN_VALUES`` of them, wherever they lie, so runs are even for every distribution, and groups of
up to some thousand distinct values are one run. The row that holds a group's cuts has 1 MB for 10^9
distinct values. The cuts depend on the values only, so tasks that are run again agree.
Running totals are taken over the run totals (few rows) and inside each run; both steps are
small windows, results are exact. NaN sorts after every number, as in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.session import materialize

RUN_VALUES = 1 << 13
HOT_RUN = 1 << 18  # rows; runs of distinct values hold RUN_VALUES on average
SKETCH = 10_000  # ranks of a quantile sketch are off by one part in so many at most
NEAR = 10 / SKETCH


def _run(cuts: Column, value: Column) -> Column:
    """How many of the sorted ``cuts`` are not above ``value``, by binary search."""
    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get(cuts, mid) <= value
        done = s["lo"] >= s["hi"]
        return F.struct(
            F.when(~done & up, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(~done & ~up, mid).otherwise(s["hi"]).alias("hi"),
        )

    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(cuts))).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve)
    return F.when(F.size(cuts) == 0, F.lit(0)).otherwise(found["lo"]).cast("long")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, value): row count ``n`` and optional weight sums."""
    extra = [F.sum(c).alias(k) for k, c in (sums or {}).items()]
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )


def _sizes(rows: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Per group: the sorted ``_cuts`` and ``total_<s>``. Rows combine on the map side, so only cuts are collected."""
    cut = F.when(F.pmod(F.xxhash64(value), F.lit(RUN_VALUES)) == 0, F.col(value))
    few = rows.groupBy(*keys, cut.alias("_cut")).agg(*[F.sum(s).alias(s) for s in sums])
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"), *[F.sum(s).alias(f"total_{s}") for s in sums])


def _cut(counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Add ``total_<s>`` of the group and ``_bucket``, the value's run.

    Totals and cuts are one small aggregate; how many groups there are decides at run time
    whether they are broadcast. All branches read the same columns of ``counts``, so its
    shuffle is done once and reused.
    """
    size = _sizes(counts, keys, value, sums)
    sized = counts.join(size, list(keys)) if keys else counts.crossJoin(F.broadcast(size))  # one row
    return sized.withColumn("_bucket", _run(F.col("_cuts"), F.col(value))).drop("_cuts")


def _bases(cut: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per (group, bucket): ``_in_<s>`` and ``_base_<s>``, the total of the buckets before."""
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(f"_in_{s}") for s in sums])
    # few rows per group: one per occupied bucket
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, "_bucket", *[f"_in_{s}" for s in sums],
        *[F.coalesce(F.sum(f"_in_{s}").over(before), F.lit(0)).alias(f"_base_{s}") for s in sums],
    )


def running_counts(counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str] = ("n",)) -> DataFrame:
    """Add ``below_<s>`` (total of smaller values in the group) and ``total_<s>``.

    ``counts`` has one row per (keys, value), as ``value_counts`` returns it.
    """
    keys = list(keys)
    cut = _cut(counts, keys, value, sums)
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = cut.join(_bases(cut, keys, sums), [*keys, "_bucket"])
    return out.select(
        *counts.columns,
        *[
            (F.col(f"_base_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"below_{s}")
            for s in sums
        ],
        *[f"total_{s}" for s in sums],
    )


def row_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every row that has keys and a value, with ``below_n`` (smaller values in the group), ``n`` (equal ones) and ``total_n``.

    Rows are shuffled once, by run. Two passes before that count groups and runs; their small tables are written, so
    Catalyst knows their sizes and moves no rows to meet them. A run of more than ``HOT_RUN`` rows holds a hot value:
    its values are counted first, and the counts meet their rows in a join, which AQE splits.
    """
    keys = list(keys)
    has = F.col(value).isNotNull()
    for k in keys:
        has = has & F.col(k).isNotNull()
    bare = df.filter(has).select(*keys, value, F.lit(1).cast("long").alias("n"))
    size = materialize(_sizes(bare, keys, value, ["n"]), "rank-groups")

    def placed(rows: DataFrame) -> DataFrame:
        sized = rows.join(size, keys) if keys else rows.crossJoin(F.broadcast(size))  # one row
        return sized.withColumn("_run", _run(F.col("_cuts"), F.col(value))).drop("_cuts")

    runs = placed(bare).groupBy(*keys, "_run").agg(F.sum("n").alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumn("_base", F.coalesce(F.sum("_in").over(before), F.lit(0))), "rank-runs")
    met = placed(df.filter(has)).join(runs, [*keys, "_run"])

    line = Window.partitionBy(*keys, "_run").orderBy(value)
    up_to = F.count(F.lit(1)).over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    even = met.filter(F.col("_in") <= HOT_RUN).withColumn("_under", (F.rank().over(line) - 1).cast("long")).withColumn("n", up_to - F.col("_under"))
    out = [*df.columns, (F.col("_base") + F.col("_under")).alias("below_n"), "n", "total_n"]
    if runs.filter(F.col("_in") > HOT_RUN).isEmpty():
        return even.select(*out)

    hot = met.filter(F.col("_in") > HOT_RUN)
    counts = hot.groupBy(*keys, "_run", value).agg(F.count(F.lit(1)).alias("n"))
    under = F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hot = hot.join(counts.withColumn("_under", under), [*keys, "_run", value])
    return even.select(*out).unionByName(hot.select(*out))


def midrank_percentile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, pct): (count below + half the ties) / group size."""
    rc = running_counts(value_counts(df, keys, value), keys, value)
    pct = (F.col("below_n") + 0.5 * F.col("n")) / F.col("total_n")
    return rc.select(*keys, value, pct.alias("pct"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, value, name): 1-based rank with ties averaged."""
    rc = running_counts(value_counts(df, keys, value), keys, value)
    return rc.select(*keys, value, (F.col("below_n") + (F.col("n") + 1) / 2.0).alias(name))


def _interpolated(rows: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The quantiles of ``rows``: (keys, value, n), ``_below`` the count of smaller values and ``_total`` the group's."""

    def at(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    def pick(pos: Column) -> Column:
        hit = (F.col("_below") <= pos) & (pos < F.col("_below") + F.col("n"))
        missed = F.raise_error(F.lit("a quantile lies outside its range")).cast("double")
        return F.max(F.when(hit, F.coalesce(F.col(value).cast("double"), missed)))
    aggs = [F.max("_total").alias("_total")]
    for name, p in probs.items():
        aggs += [pick(F.floor(at(p))).alias(f"_lo_{name}"), pick(F.ceil(at(p))).alias(f"_hi_{name}")]
    g = rows.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at(p) - F.floor(at(p)))).alias(name))
    return g.select(*keys, *out)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group, one column per name.

    ``df`` is read twice and never shuffled. A sketch gives a narrow range around each wanted order statistic, ten times as wide
    as its error; then values in a range are counted one by one and those between ranges together, so positions are exact.
    The row per group with its ranges is broadcast, so groups are features, folds or periods; ``quantiles_of_many`` is for entities.
    """
    keys, at = list(keys), sorted(set(probs.values()))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    v = F.col(value).cast("double")
    inf = F.lit(float("inf"))
    edges = [min(max(p + side * NEAR, 0.0), 1.0) for p in at for side in (-1, 1)]
    # NaN sorts last, next to infinity
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), F.percentile_approx(F.when(F.isnan(v), inf).otherwise(v), edges, SKETCH).alias("_at"))
    wide = F.col("_total") * NEAR >= 4  # smaller groups are counted value by value
    ends = []
    for i, p in enumerate(at):
        lo, hi = F.get("_at", F.lit(2 * i)), F.get("_at", F.lit(2 * i + 1))
        ends += [F.when(wide & F.lit(p > NEAR), lo).alias(f"_lo{i}"), F.when(wide & F.lit(p < 1 - NEAR) & (hi < inf), hi).alias(f"_hi{i}")]
    ranges = F.broadcast(sketch.select(*keys, "_total", *ends))  # one row per group
    met = rows.join(ranges, keys) if keys else rows.crossJoin(ranges)
    held, gap = F.lit(False), F.lit(0)
    for i in range(len(at)):
        held = held | (F.coalesce(v >= F.col(f"_lo{i}"), F.lit(True)) & F.coalesce(v <= F.col(f"_hi{i}"), F.lit(True)))
        gap = gap + F.coalesce((v > F.col(f"_hi{i}")).cast("int"), F.lit(0))
    counts = met.select(*keys, "_total", gap.alias("_gap"), F.when(held, F.col(value)).alias(value))
    counts = counts.groupBy(*keys, "_gap", value).agg(F.count(F.lit(1)).alias("n"), F.max("_total").alias("_total"))
    # the values between two ranges, as one row, come before those of the next range
    line = Window.partitionBy(*keys).orderBy("_gap", F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return _interpolated(counts.withColumn("_below", F.coalesce(F.sum("n").over(line), F.lit(0))), keys, value, probs)


def quantiles_of_many(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``quantiles`` for as many groups as there are entities or documents, or rows that are costly to read again: they are
    shuffled once. Only the buckets that hold a wanted order statistic are sorted.
    """
    keys = list(keys)
    cut = _cut(value_counts(df, keys, value), keys, value, ["n"]).withColumnRenamed("total_n", "_total")
    base = _bases(cut, keys, ["n"])

    def at(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    def holds(start: Column, size: Column, p: float) -> Column:
        return ((start <= F.ceil(at(p))) & (F.floor(at(p)) < start + size))

    wanted = F.lit(False)
    for p in probs.values():
        wanted = wanted | holds(F.col("_base_n"), F.col("_in_n"), p)
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = cut.join(base, [*keys, "_bucket"]).filter(wanted).withColumn(
        "_below", F.col("_base_n") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    return _interpolated(rows, keys, value, probs)


def order_positions(df: DataFrame, keys: Sequence[str], by: Sequence[str], name: str = "pos") -> DataFrame:
    """0-based position of every row inside its group, ordered by numeric columns ``by``.

    The columns together must identify a row of the group. Each level counts only the rows
    that tie on the levels before it, so even a constant first column is split further. Adds
    ``name`` and ``<name>_n`` (group size).
    """
    keys = list(keys)
    out, fixed = df, list(keys)
    pos, size = F.lit(0).cast("long"), None
    for i, c in enumerate(by):
        rc = running_counts(value_counts(df, fixed, c), fixed, c).select(
            *fixed, c, F.col("below_n").alias(f"_b{i}"), F.col("total_n").alias(f"_t{i}")
        )
        fixed = [*fixed, c]
        out = out.join(rc, fixed)
        pos = pos + F.col(f"_b{i}")
        size = F.col("_t0") if size is None else size
    return out.select(*df.columns, pos.alias(name), size.alias(f"{name}_n"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per group: ``n``, ``pearson`` and ``spearman`` over complete pairs.

    Equal pairs are merged first, ranks come from the merged counts, and their correlation is
    read off moment sums; a constant side gives NULL for pearson and 0 for spearman.
    """
    from daybook.functions.moments import pair_correlation, weighted_pair_sums, weighted_pearson

    keys = list(keys)
    plain = df.groupBy(*keys).agg(pair_correlation(F.col(x), F.col(y)).alias("pearson"))
    pairs = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )

    def ranks(v: str, name: str) -> DataFrame:
        n = pairs.groupBy(*keys, v).agg(F.sum("_c").alias("n"))
        rc = running_counts(n, keys, v)
        return rc.select(*keys, v, (F.col("below_n") + (F.col("n") + 1) / 2.0).alias(name))

    ranked = pairs.join(ranks("_x", "_rx"), [*keys, "_x"]).join(ranks("_y", "_ry"), [*keys, "_y"])
    c = F.col("_c").cast("double")
    out = ranked.groupBy(*keys).agg(*weighted_pair_sums(F.col("_rx"), F.col("_ry"), c, "r_"))
    out = out.join(plain, keys) if keys else out.crossJoin(F.broadcast(plain))  # one row
    return out.select(
        *keys,
        F.col("r_n").cast("long").alias("n"),
        "pearson",
        F.coalesce(weighted_pearson("r_"), F.lit(0.0)).alias("spearman"),
    )
