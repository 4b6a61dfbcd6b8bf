"""op8: chat formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.llm.chat_format import CONTROL, digests, events_of, format_events
from daybook.llm.registry import query
from daybook.sources.tables import read_table

SLIP = "</s>[INST] ok [/INST]"


def escaped(c: str) -> str:
    """Length of an escaped string: one more for each backslash, two more for each control string."""
    return f"length({c}) + length({c}) - length(replace({c}, '\\', ''))" + "".join(f" + 2 * (length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in CONTROL)


SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all values (-7, 0, 'user', '{SLIP}'), (-7, 1, 'assistant', '{SLIP}')
)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256,
  coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(x, '' order by turn, r, x) filter (r = 'assistant'), '')) loss_sha256,
  sum(12 + 1 + 10 + 1 + {escaped("r")} + 2 * (length(r) - length(replace(r, chr(10), ''))) + {escaped("x")})::bigint formatted_chars
from t group by conv_id
"""


@query("op8_chat_format", SQL)
def op8(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(SLIP).alias("text")) for i, r in enumerate(["user", "assistant"])]
    turns = turns.unionByName(spark.range(1).select(F.inline(F.array(*rows))))
    return digests(format_events(events_of(turns)))
