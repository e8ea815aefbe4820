"""The training-data pipeline: documents in, token shards out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written
as Parquet and read again as the next stage's documents; all but the last keep
the columns of ``documents``.

1. quality classifier: documents that score under 0.5 go;
2. SimHash near-dedup: of each group of near copies the smallest doc_id stays;
3. benchmark decontamination: documents with any benchmark window go;
4. mixing: documents are repeated, cut or left out to meet their source's
   target, in the order of training time;
5. token shards: all that is left, one row a sequence slot.

``run`` works on any input that the stages take: an empty table gives no slot.
SQL can't express the classifier, the hashes or the shards (``ORACLE_SQL`` is
None); tests/llm/test_pipeline.py holds the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trafficlens.llm import decontaminate, mixing, quality, simhash, token_shards
from trafficlens.llm.common import discard, stored
from trafficlens.sources.tables import read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on ``labels``, scores at least 0.5."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash prints linked at two bits or fewer, over 3-word shingles."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ``benchmark``: a coverage limit of zero."""
    return decontaminate.remove_leaks(docs, read(spark, sf_dir, "benchmark"), max_coverage=0.0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that meet each source's target, in training order."""
    return mixing.training_order(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all documents; the manifest, one row a slot."""
    return token_shards.report(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mix", mix),
    ("token_shards", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one is whole."""
    docs, before = read(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
