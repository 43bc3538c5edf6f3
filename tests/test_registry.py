"""The registry keeps every implemented query (guards against accidental removal)."""

import __spark_entry__ as E

EXPECTED = [
    'class_orders', 'class_members', 'class_docs', 'method_references', 'method_definitions', 'method_help',
    'scope_undefined', 'scope_unused', 'scope_goto', 'scope_rows', 'layout_diff', 'broken_errors', 'broken_functions',
    'stub_modules', 'lookup_errors', 'indexed_search', 'indexed_search_regex', 'inventory_digest', 'inventory_ranges',
    'inventory_changes', 'install_answers', 'wide_imports', 'expected_packages', 'install_locations', 'saved_runs',
    'loaded_runs', 'json_lines',
    'layout_cycles', 'layout_definitions', 'layout_edges', 'layout_hover', 'layout_lint', 'layout_references',
    'layout_rename', 'layout_signature_help', 'layout_undefined',
    'decode_files',
    'main_exports',
    'doc_text_tokens',
    'project_text_tokens',
    'lint_same_pass',
    'decorators', 'analyze_project_summary',
    'rename_symbols',
    'related_names', 'module_exports', 'doc_examples', 'doc_raises',
    'agent_averages', 'api_docs', 'apply_rewrite', 'attributes', 'cache_stats', 'classes',
    'codegen_context', 'compat_report', 'completions', 'config_category_counts', 'config_refs', 'cost',
    'cross_refs', 'cycles', 'cycles_distributed', 'definitions_follow_imports', 'dep_classes', 'dep_classes_local', 'dependencies',
    'diag_file_summary', 'diag_ingest', 'diag_project', 'diag_summary', 'doc_budget_short', 'doc_freshness',
    'doc_goal_debugging', 'doc_lookup', 'file_representations', 'file_summary', 'free_text_sessions', 'from_imports',
    'functions', 'generic_sessions', 'goto_definitions', 'hover', 'import_adjacency', 'import_audit',
    'import_edges', 'import_names', 'import_to_package', 'imports', 'inventory', 'inventory_fingerprint',
    'lfu_victims', 'lint_findings', 'lint_rule_counts', 'lint_severity', 'lint_summary', 'metadata_packages',
    'methods', 'mypy_ingest', 'package_details', 'package_list', 'params', 'parse_errors',
    'pattern_first_results', 'pattern_search', 'pattern_summary', 'pkg_manager', 'project_rollup', 'pyright_ingest',
    'refresh_counts', 'run_pairs', 'run_pairs_rounded', 'search_by_type', 'search_context', 'search_event_ingest',
    'search_first_results', 'search_ignore_case', 'search_limit_per_file', 'search_pages', 'search_summary', 'search_text',
    'session_log_ingest', 'session_metrics', 'signature_help', 'speedups', 'stale_inventories', 'submatch_counts',
    'submatch_offsets', 'symbol_references', 'symbol_search', 'symbols', 'task_labels', 'threshold_guard',
    'timing_summary', 'token_savings', 'token_total_rollup', 'tokens_approx', 'tokens_word', 'transform_diff',
    'transform_preview', 'type_check_fallback', 'undefined_names', 'unused_imports', 'variables', 'version_check',
]


def test_registry_complete():
    from codestrata.plans import registry

    registry._load_all()
    qs, os_ = registry.QUERIES, registry.ORACLES
    assert set(qs) <= set(E.queries()) and set(os_) <= set(E.oracle_sql())
    assert sorted(qs) == sorted(EXPECTED)
    assert sorted(set(qs) - set(os_)) == ["file_representations"]
    assert set(os_) <= set(qs)
