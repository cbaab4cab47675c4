"""What is registered stays registered."""

import __spark_entry__ as entry

# Names of queries of former rounds that must be there, whatever is added.
KEPT = """
aggregate_bounds anchor_chain best_block binding_primary_level bucket_cases bucket_keys bucket_lookup_cascade bucket_stats cache_share case_features class_weight
clip_count clip_monotone cn_decimal cn_numeral conditional_mean confusion_binary constraint_training corpus_selection coverage_ratio dataset_summary direction_counts
direction_split explode_counts f1_threshold factor_labels filled_cells first_match_rules fold_metrics group_mae holding_override holdout_tail_shift interp_percentiles
jaccard_sets keyword_filter label_cells label_prefill labelled_rows last_by_key median_baseline nearest_rank_quartiles numeric_exact outlier_texts override_update
phrases_near pinball_coverage pooled_thresholds positional_shards pr_auc primary_definitions random_holdout reductions_compound registry_projection registry_refresh
resume_anti section_extract sentence_months serving_constraint serving_defaults shard_union single_defendant snippet span_merge split_defendants suspicious_reductions
time_decay token_cost top_contributions topk_outliers topk_per_group training_row_onehot triage value_counts violation_rate walk_forward_folds waterfall year_counts
""".split()


def test_no_query_is_lost():
    assert set(KEPT) <= set(entry.queries()) and set(KEPT) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
