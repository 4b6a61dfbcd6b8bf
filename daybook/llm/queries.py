"""All registered queries of the corpus operators."""

from daybook.llm import q_ann, q_chat, q_hamming, q_lexical, q_license, q_mix, q_pack, q_simhash, q_substring, q_toxicity, q_trie, q_url, q_warc
from daybook.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
