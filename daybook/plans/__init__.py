"""Composed queries over the given tables."""

from daybook.plans import q_backtest, q_ingest, q_kpi, q_label, q_learn, q_model_checks, q_models, q_quality, q_select, q_serve, q_stats, q_stream, q_table, q_text
from daybook.plans.q_label import flagship
from daybook.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]
