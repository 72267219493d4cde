"""Queries whose plan depends on a measured size, by the plan of large tables."""

from twinproof.catalog import fairness_queries, prepare_queries, privacy_queries, record_queries, score_queries, utility_queries  # noqa: F401 (the queries taken up here)
from twinproof.catalog.registry import large
from twinproof.operators import consensus, correlation, distance, encoding, running

_BUCKETED = (running, {"SMALL_ROWS": 0})

for _name in ("wasserstein", "ks", "lorenz", "prep_impute", "dcr_full_applicants", "stat_similarity"):
    large(_name, _BUCKETED)
large("label_encode", _BUCKETED, (encoding, {"SMALL_DICTIONARY": 0}))
large("corr_matrix", _BUCKETED, (encoding, {"SMALL_DICTIONARY": 0}), (correlation, {"FUSED_PAIRS": 0}))
large("consensus_contract", (running, {"GROUP_ROWS": 0}))
large("agreement_rate", (running, {"GROUP_ROWS": 0}))
large("consensus_median", (consensus, {"PIVOT_QUORUM": 0}))
# blocks, parts and chunks of a few rows, and small rounds
large("dcr_evaluator_full", (distance, {"BLOCK_ROWS": 64, "PART_ROWS": 40, "CHUNK_ROWS": 100, "BUCKET_ROWS": 256, "WINDOWS": (1, 3), "WINDOW": 8}))
