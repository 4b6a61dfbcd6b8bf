"""Mix sources to target weights with a low-discrepancy schedule.

Points of the golden-ratio sequence are mapped through the cumulative slot counts of the sources, so any
stretch of the schedule holds each source close to its share. Slots are ranked per source, and the k-th
slot of a source takes the k-th block of its shuffled word stream; blocks hold equally many words.

Defined cases: a NULL text has size 0; a NULL source is a source of its own, after all others; documents of
size 0 are taken 0 times; rows that repeat are separate rows; an empty table gives an empty result; columns
of the input beside ``text`` and ``source`` pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import running_start
from daybook.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 1024
# Weyl sequence of the golden ratio in integers: odd number next to 2^31 / phi
MODULUS, STEP = 2**31, 1327217885
CHUNK = 65_536


def source_key(source: Column) -> Column:
    """Sorts by code point with NULL last, and joins like any value."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def sized(docs: DataFrame, text: str, source: str, id_col: str) -> DataFrame:
    """One row per document: _key, _size and the place in the shuffle, without the text."""
    return docs.select(
        F.col(id_col).alias("_id"),
        source_key(F.col(source)).alias("_key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_shuffle"),
        F.xxhash64(text).alias("_hash"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: _key, source_size, target. ``sizes`` has _key, _size.

    Weights share the words of all sources; what a source may not take (beyond ``max_repeats`` times its size)
    is shared again by weight. That ends where sources capped first (least cap per weight) are taken out one
    after the other, which two running sums over one row per source give at once.
    """
    per = sizes.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy("_key")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_key")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    rest_w = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    per = per.withColumn("_share", F.col("_w") * rest.cast("double") / rest_w).withColumn("_open", F.col("_cap") >= F.col("_share"))
    # from the first source that is not capped on, all share at that source's rate
    first = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), "_key", rest.alias("r"), rest_w.alias("w")))).over(whole)
    return per.withColumn("_first", first).select(
        "_key",
        "source_size",
        F.when(F.col("_open"), F.col("_w") * F.col("_first.r").cast("double") / F.col("_first.w"))
        .otherwise(F.col("_cap").cast("double"))
        .alias("target"),
    )


def schedule(plan: DataFrame, total: int) -> DataFrame:
    """(slot, _rank, all columns of ``plan``): each source exactly _slots times in ``total`` slots.

    A slot's point falls on the source whose stretch of the cumulative slot counts covers it. Stretches are
    cut into cells, so the lookup is an equi-join. The few slots by which the sequence misses a source's
    count (they grow with the logarithm of ``total``) go to the sources that are short of them.
    """
    before = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.filter("_slots > 0").withColumn("_lo", F.coalesce(F.sum("_slots").over(before), F.lit(0)))
    width = max(1, total // 4096)
    cells = plan.withColumn("_cell", F.explode(F.expr(f"sequence(_lo div {width}, (_lo + _slots - 1) div {width})")))
    point = F.pmod(F.pmod(F.col("slot") + 1, F.lit(MODULUS)) * F.lit(STEP), F.lit(MODULUS))
    slots = plan.sparkSession.range(total).withColumnRenamed("id", "slot")
    slots = slots.withColumn("_v", F.floor(point / F.lit(float(MODULUS)) * total)).withColumn("_cell", F.expr(f"_v div {width}"))
    hit = slots.join(cells, "_cell").filter("_v >= _lo and _v < _lo + _slots").withColumn("_one", F.lit(1)).withColumn("_chunk", F.expr(f"slot div {CHUNK}"))
    ranked = materialize(running_start(hit, ["_key"], "_chunk", ["slot"], "_one", "_rank"), "mix-slots")
    spare = ranked.filter("_rank >= _slots").select("slot", F.row_number().over(Window.orderBy("slot")).alias("_i"))
    have = ranked.groupBy("_key").agg(F.count("*").alias("_have"))
    short = plan.join(have, "_key", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter("_have < _slots")
    short = short.withColumn("_rank", F.explode(F.expr("sequence(_have, _slots - 1)"))).withColumn("_i", F.row_number().over(Window.orderBy("_key", "_rank")))
    cols = ["slot", "_rank", *plan.columns]
    return ranked.filter("_rank < _slots").select(*cols).unionByName(short.join(spare, "_i").select(*cols))


def mix(
    docs: DataFrame, *, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents). ``pieces`` is the mix: slot, _id, _hash, first_word, words, one row per document in a block
    taken. ``documents`` has one row per input row: _id, _hash, _key, _size, source_size, target, taken.
    """
    sizes = materialize(sized(docs, text, source, id_col), "mix-sizes")
    goals = targets(sizes, weights, max_repeats)
    quota = F.floor(F.col("target") + 0.5)
    plan = goals.withColumn("_quota", F.least(quota, F.col("source_size") * max_repeats)).withColumn("_blocks", F.ceil(F.col("source_size") / block_words))
    plan = plan.withColumn(
        "_slots",
        F.when(F.col("source_size") > 0, F.expr("(_quota div source_size) * _blocks") + F.ceil(F.expr("_quota % nullif(source_size, 0)") / block_words)).otherwise(F.lit(0)),
    )
    plan = materialize(plan, "mix-plan")
    total = plan.agg(F.sum("_slots")).first()[0] or 0
    placed = running_start(
        sizes.filter("_size > 0").withColumn("_bucket", F.substring("_shuffle", 1, 3)), ["_key"], "_bucket", ["_shuffle", "_id", "_size", "_hash"], "_size", "_start"
    )
    placed = materialize(placed.select("_id", "_hash", "_key", "_size", "_start"), "mix-placed")
    pieces = placed.withColumn("_block", F.explode(F.expr(f"sequence(_start div {block_words}, (_start + _size - 1) div {block_words})")))
    slots = schedule(plan, total).selectExpr(
        "slot", "_key", "_rank % _blocks as _block", "if(_rank div _blocks < _quota div source_size, source_size, _quota % source_size) as _end"
    )
    lo = F.greatest(F.col("_start"), F.col("_block") * block_words)
    hi = F.least(F.col("_start") + F.col("_size"), (F.col("_block") + 1) * block_words, F.col("_end"))
    mixed = pieces.join(slots, ["_key", "_block"]).filter(hi > lo).select("slot", "_id", "_hash", "_key", "_size", "_start", (lo - F.col("_start")).alias("first_word"), (hi - lo).alias("words"))
    # a document is known by its source and place in the stream there; those of size 0 have no place and are in no block
    got = mixed.groupBy("_key", "_start").agg(F.sum("words").alias("taken"))
    rows = placed.join(got, ["_key", "_start"], "left").select("_id", "_hash", "_key", "_size", F.coalesce("taken", F.lit(0)).alias("taken"))
    rows = rows.unionByName(sizes.filter("_size = 0").select("_id", "_hash", "_key", "_size", F.lit(0).cast("long").alias("taken")))
    return mixed, rows.join(goals_of(plan), "_key")


def goals_of(plan: DataFrame) -> DataFrame:
    return plan.select("_key", "source_size", "target")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a document taken n times whole is n rows; what is taken beyond
    that is its first words in one more row (at most one document of a source). Those not taken are gone."""
    id_col, text, source = options.get("id_col", "doc_id"), options.get("text", "text"), options.get("source", "source")
    _, rows = mix(docs, **options)
    same = ["_id", "_hash", "_key"]
    rows = rows.filter("taken > 0").select(*same, "_size", "taken", F.row_number().over(Window.partitionBy(*same).orderBy("taken")).alias("_copy"))
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), source_key(F.col(source)).alias("_key"))
    keyed = keyed.withColumn("_copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
    a, b = keyed.alias("a"), rows.alias("b")
    on = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._hash") == F.col("b._hash")) & (F.col("a._key") == F.col("b._key")) & (F.col("a._copy") == F.col("b._copy"))
    hit = a.join(b, on).select("_doc", "b._size", "b.taken")
    parts = F.expr("array_repeat(cast(null as bigint), cast(taken div _size as int))")
    rest = F.expr("if(taken % _size > 0, array(taken % _size), cast(array() as array<bigint>))")
    hit = hit.withColumn("_part", F.explode(F.concat(parts, rest)))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(f"_doc.{text}"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("_part").cast("int")), "")
    whole = F.when(F.col("_part").isNull(), F.col(f"_doc.{text}")).otherwise(cut)
    return hit.select(*[(whole.alias(c) if c == text else F.col("_doc").getField(c).alias(c)) for c in docs.columns])
