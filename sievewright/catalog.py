"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from .plans import given, more, oracles, queries, stores  # noqa: F401  (given and stores register with more)

_PLAIN = (
    "fanin_groups fanin_stats finding_normalize malformed_reasons contradictions assertion_sides trust_scan trust_summary command_risks token_estimate_by_lang query_terms dedup_blocks "
    "candidate_pairs_jaccard candidate_pairs_full verify_pairs guarded_components embedding_candidates synthesis_order synthesis_packet source_refs audit_findings graph_degree graph_khop "
    "graph_bfs import_resolution rank_files recall_scores recall_prune grep_hits grep_counts claim_observations claim_status knowledge_topk budget_prefix budget_skip batch_next_fit "
    "budget_trim largest_remainder round_robin_merge ledger_compare ledger_upsert stale_invalidation reconcile lifecycle_tiers lifecycle_evict telemetry_summary provider_health "
    "trace_replay recall_benchmark topological_waves complexity_risk route reduction_modes simulate workflow_dimensions problem_list set_ops_sync contract_errors stream_fanin"
).split()
QUERIES = {name: getattr(queries, name) for name in _PLAIN} | more.QUERIES
ORACLES = oracles.ORACLES | more.ORACLES
FLAGSHIP = queries.fanin_groups
