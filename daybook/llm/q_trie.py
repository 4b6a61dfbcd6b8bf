"""op12: trie of rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.prefix_trie import ordered_turns, prefix_trie
from daybook.llm.registry import query
from daybook.session import materialize
from daybook.sources.tables import read_table

GROUP, MOST = 5, 9

# CRC-32 of a decimal id, bit by bit
CRC = """xor(4294967295, list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint),
  lambda a, ch: list_reduce(range(8)::bigint[], lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end), xor(a, ch)), 4294967295::bigint))"""

SQL = f"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 pos, coalesce(role, '') role, coalesce(text, '') text
  from conversations where conv_id is not null
), lens as (select conv_id, count(*) n from t group by 1),
ids as (select conv_id, conv_id - conv_id % 5 base, {CRC} % 9 h from lens),
own as (
  select i.conv_id, t.pos - i.h + least(i.h, coalesce(b.n, 0)) + 1 depth, t.role, t.text
  from ids i join t using (conv_id) left join lens b on b.conv_id = i.base where t.pos >= i.h
), r as (select i.conv_id, t.pos + 1 depth, t.role, t.text from ids i join t on t.conv_id = i.base where t.pos < i.h union all select * from own),
p as (
  select conv_id, depth, octet_length(encode(text)) bytes,
    string_agg(sha256(len(role) || ':' || role || text), '' order by depth) over (partition by conv_id order by depth) path from r
  union all select conv_id, 0, 0, '' from ids
), last as (select conv_id, max(depth) length from p group by 1),
n as (
  select path, any_value(depth)::bigint depth, min(conv_id) conv_id, count(*) n_convs, any_value(bytes) bytes,
    sha256(coalesce(string_agg(case when depth = length then conv_id::varchar end, ',' order by conv_id), '')) ends_sha256
  from p join last using (conv_id) group by path
), k as (select left(path, len(path) - 64) path, count(*) n_children from n where depth > 0 group by 1),
w as (select n.*, coalesce(n_children, 0) n_children from n left join k using (path)),
u as (
  select p.path, sum((w.n_convs - 1) * w.bytes)::bigint saved_tokens, sum((w.n_children = 0)::int)::bigint n_leaves
  from p join w on w.conv_id = p.conv_id and w.depth >= p.depth group by 1
)
select w.conv_id, w.depth, a.conv_id parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
from w join u using (path) left join n a on w.depth > 0 and a.path = left(w.path, len(w.path) - 64)
"""


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations whose first turns are those of their group's first conversation."""
    turns = materialize(ordered_turns(conversations), "rebuilt-turns")
    lens = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "rebuilt-lengths")
    head = F.crc32(F.col("conv_id").cast("string")) % MOST
    ids = lens.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), head.alias("h"))
    base = lens.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    ids = ids.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    ids = materialize(ids.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt-conversations")
    what = ["t1", "t2", "bytes"]
    own = turns.join(ids.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), *what)
    lead = turns.filter(F.col("pos") < MOST - 1).withColumnRenamed("conv_id", "base")
    first = lead.join(ids.select("conv_id", "base", "h"), "base").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), *what)
    return own.unionByName(first), ids.select("conv_id", "length")


@query("op12_conversation_trie", SQL)
def op12(spark, sf_dir):
    turns, conversations = rebuilt(read_table(spark, sf_dir, "conversations"))
    return prefix_trie(turns, conversations).drop("digest")
