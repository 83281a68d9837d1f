"""A part of the catalogue against its SQL, and the driver's contract."""

from types import SimpleNamespace

import pytest

import __spark_entry__
from cairn.plans import catalogue
from tests.compare import assert_same

NAMES = [
    "hotspots_file", "unused_exports", "clone_members", "references_of", "enclosing_interval", "cochange_pairs", "bus_factor_module", "trend_direction", "blast_counts", "shortest_path_counts", "dead_code",
    "round_robin_limit", "change_risk", "context_rank", "boundaries_check", "fts_search", "rrf_hybrid", "rule_scan", "resolve_references", "cascading_delete", "sequential_ids", "incremental_merge",
    "clone_groups", "pagerank_k", "unused_page", "hotspots_symbol", "health_report", "dashboard_clones", "clone_traits", "hotspots_by_axis", "health_summary", "trend_by_change", "cochange_mined", "churn_without_merges", "path_to_targets", "call_levels", "rule_kinds",
    "dead_symbols", "name_search", "name_search_kind", "changed_in_range", "findings_annotated", "resolve_imports",
    "parsed_symbols", "parsed_call_sites", "parsed_relations", "hierarchy_of_relations", "god_functions_by_arms", "lexed_documents", "long_parameters", "token_budget_prefix", "rule_contexts", "wiki_labels", "boundaries_by_directory", "envy_without_dispatch", "clone_groups_by_tokens", "phrase_counts", "index_terms",
    "blast_of_cycles", "module_mentions", "gaps_by_mentions", "coverage_both_ways", "suggest_with_untested", "guard_by_blast",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_unused_page_leaves_out_imported_files(spark):
    files = spark.createDataFrame([(1, "a.rs", "rust", 0.5, 0), (2, "b.rs", "rust", 0.5, 0)], "id long, path string, language string, pagerank double, change_count long")
    symbols = spark.createDataFrame([(100 * f + i, f, i, True, False) for f in (1, 2) for i in range(80)], "id long, file_id long, line_start int, is_exported boolean, unused_excluded boolean")
    edges = spark.createDataFrame([(2, 1)], "from_file long, to_file long")
    refs = spark.createDataFrame([(100, 200)], "from_symbol_id long, to_symbol_id long")
    got = catalogue.unused_page(SimpleNamespace(symbols=symbols, files=files, edges=edges, refs=refs)).collect()
    assert [r.id for r in got] == list(range(205, 235))
