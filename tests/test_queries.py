"""A cross-section of the registered queries against their SQL, on the smallest tables."""
import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

CHOSEN = """flagship_scale_separation agg05_exact_auc agg06_threshold_at_fpr_budget agg24_localisation_summary
agg29_detection_aucs agg32_fpr_at_matched_recall agg34_robustness_by_condition agg42_prediction_diagnostics
src02_labelled_roots src09_relabel_layout src12_feature_cache_read src16_manifest_accumulation prj01_dataset_quality_gate
prj03_canonical_crop prj08_random_augmentation_plan win08_group_split win07_balanced_windows win13_collapse_streak
set02_stack_feature_caches join12_leave_one_family_out prj17_window_plan agg14_hann_blend agg16_combine_scales
grid03_gaussian_blur grid04_guided_filter grid06_morphology grid09_connected_components grid21_block_dct_profile
agg19_region_descriptors prj24_router evd04_compositing agg39_region_fusion prj28_verdict prj21_calibrator_apply
agg10_calibration_error prj22_resolve_positive_class agg08_scaler_fit str02_running_evaluation str03_collapse_alarm
agg12_isotonic_fit agg13_fits_per_scale agg31_paired_bootstrap agg37_decision_sweep grid09_components_over_tiles grid20_error_level_frames
grid26_degraded_tiles grid26_degraded_conditions src01_image_listing src03_unlabelled_folder src04_decode_and_count_errors src08_archive_scan
src13_predictions src15_provenance_manifest src18_epoch_log srt02_top_features srt06_stop_at_target win04_round_robin win10_region_rank
prj37_random_subset ml02_boosted_trees ml04_block_ablation ml06_batch_scoring""".split()


@pytest.fixture(scope="module")
def oracle(sf):
    return connect(sf)


def test_every_oracle_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CHOSEN) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, sf, oracle, name):
    assert compare(entry.queries()[name](spark, sf), oracle, entry.oracle_sql()[name]) is None
