"""Queries: ordered operators with limits so low that statements are laid out in blocks.

Limits change the layout, never the result, so each is checked against the SQL of its plain form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerproof.operators import detect, explore, forensic, ledger, reports
from ledgerproof.operators.sequence import BLOCK_ROWS, Sizing
from ledgerproof.plans import q_explore, q_forensic, q_ledger, q_reports  # noqa: F401  (their SQL is looked up)
from ledgerproof.plans.registry import ORACLES, query
from ledgerproof.plans.tables import Tables

# About half of the first provider's statements are longer. Small inputs are laid out in a few blocks; larger ones
# in more of them, as no block exceeds the size that ordinary limits allow.
HOT_ROWS = 50
BLOCKS = 8


def small(t: Tables) -> Sizing:
    return Sizing(hot_rows=HOT_ROWS, block_rows=max(HOT_ROWS, min(BLOCK_ROWS, t.rows // BLOCKS)))


def _replay(t: Tables) -> DataFrame:
    return ledger.verify(t.txn, small(t), keep=())


FORMS: dict[str, Callable[[Tables], DataFrame]] = {
    "b2_tie_order_format1": lambda t: ledger.verify(t.uatl.filter("format = 'format_1'"), small(t), keep=()).select("run_id", "seq", "pos"),
    "b3_tie_order_sheets": lambda t: ledger.verify(t.umtn, small(t), keep=()).select("run_id", "seq", "pos"),
    "b7_running_balance": lambda t: _replay(t).select("run_id", "seq", "pos", "calculated_running_balance"),
    "b14_statement_summary": lambda t: ledger.summarise(_replay(t)),
    "d1_duplicates": lambda t: detect.flag_duplicates(ledger.normalise_signs(t.txn, small(t)), small(t)).select("run_id", "seq", "txn_id", "is_duplicate"),
    "d6_sequence_in_date": lambda t: detect.number_within_date(
        detect.format2_rules(t.uatl.filter("format = 'format_2'")), Sizing(hot_rows=2, block_rows=small(t).block_rows)
    ).select("run_id", "seq", "sequence"),
    "d8_cashback_vote": lambda t: detect.fee_votes(t.uatl, small(t)).select("run_id", "cashback_for", "cashback_against", "uses_implicit_cashback"),
    "f4_balance_jumps": lambda t: forensic.balance_jumps(t.txn, sizing=small(t)),
    "w3_mismatch_context": lambda t: explore.mismatch_context(t.replay, sizing=small(t)).select("run_id", "pos", "before_mismatch", "seq", "balance_diff"),
    "a14_strategy_winner": lambda t: reports.strategy_scores(ledger.run_strategies(t.uatl, small(t))),
}

for _name, _build in FORMS.items():
    query(f"{_name}_blocked")(_build)
    ORACLES[f"{_name}_blocked"] = ORACLES[_name]
