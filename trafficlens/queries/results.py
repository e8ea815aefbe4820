"""Results of one fit that several queries read.

The query that gives a learner's values fits it every time; the queries that
check them, or show them another way, read what it wrote if it ran in this
application, and fit only if it did not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trafficlens.session import path_exists, scratch_path

from . import register

_WRITTEN: dict[tuple, str] = {}
_MADE: dict[tuple, object] = {}
#: Queries of a learner's values -> the query that makes the same fit, if need be, and checks it.
CHECKED_BY = {
    "q_m2_forest_importances": "q_m2_forest_sum", "q_m7_batch_curve": "q_m7_batches_keys", "q_m9_grid": "q_m9_grid_maps", "q_m9_grid_report": "q_m9_grid_maps",
    "q_m12_grid_search": "q_m12_maps", "q_m12_holdout_report": "q_m12_maps", "q_m13_random_search": "q_m13_maps", "q_m14_cv_score": "q_m14_folds",
    "q_m15_forest_features_curve": "q_m15_forest_features_range", "q_m15_c_curve": "q_m15_c_values", "q_m15_alpha_curve": "q_m15_alpha_values",
    "q_m15_iteration_curve": "q_m15_iteration_values", "q_m16_split_size_curve": "q_m16_sizes",
}


def write_result(spark: SparkSession, sf_dir: str, name: str, result: DataFrame) -> DataFrame:
    """``result``, written into the shared folder under ``name``."""
    path = scratch_path(spark, name)
    result.write.parquet(path)
    _WRITTEN[spark.sparkContext.applicationId, sf_dir, name] = path
    return spark.read.schema(result.schema).parquet(path)


def written_by(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What was last written as ``name`` in this application; where that is gone or never was, ``make`` is run and written."""
    path = _WRITTEN.get((spark.sparkContext.applicationId, sf_dir, name))
    if path and path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    return write_result(spark, sf_dir, name, make(spark, sf_dir))


def scored_rows(name: str, check: str, check_sql: str, keys: list[str], flag: str = "scored"):
    """Registers a learner's query under ``name`` (its rows without ``flag``), and under ``check``, with the twin
    ``check_sql``, the keys and the flag of the rows that it wrote."""
    CHECKED_BY[name] = check

    def deco(make):
        @register(name)
        def values(spark, sf_dir):
            return write_result(spark, sf_dir, name, make(spark, sf_dir)).drop(flag)

        @register(check, check_sql)
        def checked(spark, sf_dir):
            return written_by(spark, sf_dir, name, make).select(*keys, flag)
        return values
    return deco


def made(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object], fresh: bool) -> object:
    """A fitted thing (models, small score tables), made anew if ``fresh``, else as it was last made in this application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if fresh or key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]
