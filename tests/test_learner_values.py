"""The learners' queries give their values, not only facts about them."""

import pytest

from tests.conftest import SMOKE


@pytest.mark.parametrize("name, values", [("q_m2_forest_importances", ["importance"]), ("q_m15_forest_features_curve", ["cv_f1", "holdout_f1"]),
                                          ("q_m5_logistic", ["predict_proba"]), ("q_m20_batch_scoring", ["predict_proba"])])
def test_values_are_given(spark, name, values):
    import __spark_entry__ as ent
    rows = ent.queries()[name](spark, SMOKE).select(values).collect()
    assert rows and all(0 <= v <= 1 for row in rows for v in row)
    assert len(set(rows)) > 1 or name.startswith("q_m15")
