"""op3: web archives."""

from __future__ import annotations

from daybook.llm.registry import query
from daybook.llm.warc import archive_digests
from daybook.sources.tables import read_table

SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) digest from pages
), f as (
  select digest, min(page_id) first from p where n >= 100 group by digest
)
select page_id, n::bigint payload_bytes, digest payload_digest, case when first <> page_id then 'revisit' else 'response' end record_type,
  case when first <> page_id then first end refers_to
from p left join f using (digest)
"""


@query("op3_warc_reassembly", SQL)
def op3(spark, sf_dir):
    return archive_digests(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
