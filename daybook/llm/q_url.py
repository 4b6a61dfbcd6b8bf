"""op7: url filter."""

from __future__ import annotations

from daybook.llm.registry import query
from daybook.llm.url_graph import judge
from daybook.sources.tables import read_table

# Fixed values
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query("op7_url_filter")
def op7(spark, sf_dir):
    return judge(read_table(spark, sf_dir, "pages"), RULES)
