"""All registered queries."""

from ledgerproof.plans import q_blocked, q_explore, q_forensic, q_ledger, q_reports, q_sources  # noqa: F401
from ledgerproof.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
