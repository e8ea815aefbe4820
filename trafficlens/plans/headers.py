"""The request-scoring model: 22 agent fields + operation -> hash buckets ->
one-hot -> logistic regression, as one saveable PipelineModel.

The hash step is a ``SQLTransformer`` (the portable MD5 bucket of F1), so the
served chain is only Spark stages and reloads anywhere; a request field that
is missing arrives as '' (T2).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.useragent import FIELDS_22, parse_agents
from trafficlens.plans.models import fit_materialised

# Request fields of the scoring model (the agent fields, then operation)
# and the bucket count per field.
HEADER_FIELDS = FIELDS_22 + ["operation"]
HEADER_BUCKETS = 10000


def hash_sql(fields: list[str], n: int) -> str:
    cols = ", ".join(f"CAST(conv(substring(md5(CAST(`{c}` AS STRING)), 1, 8), 16, 10) AS BIGINT) % {n} AS `{c}_h`"
                     for c in fields)
    return f"SELECT *, {cols} FROM __THIS__"


def header_stages(fields: list[str] = HEADER_FIELDS, n: int = HEADER_BUCKETS, reg: float = 0.0,
                  max_iter: int = 50) -> list:
    """Hash -> index the buckets seen in training -> one-hot (unseen = zeros) -> LR.

    Indexing first keeps one slot per observed bucket, as the reference's
    encoder does; one-hot straight on bucket numbers would size every field
    at n slots.
    """
    hashed = [f"{c}_h" for c in fields]
    idx = [f"{c}_i" for c in fields]
    vecs = [f"{c}_v" for c in fields]
    return [SQLTransformer(statement=hash_sql(fields, n)),
            StringIndexer(inputCols=hashed, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=idx, outputCols=vecs, handleInvalid="error", dropLast=True),
            VectorAssembler(inputCols=vecs, outputCol="features"),
            LogisticRegression(labelCol="label", featuresCol="features", regParam=reg, maxIter=max_iter)]


def training_rows(http: DataFrame) -> DataFrame:
    """Agent fields of every request, operation, label, key; a missing field is ''.

    The agents are parsed once a distinct text and joined back; a request
    without an agent keeps its row.
    """
    rows = http.select("ROW_ID", "operation", "userAgent", "isBot")
    agents = parse_agents(rows, "userAgent", 22)
    e = rows.join(agents, "userAgent", "left")
    return e.select("ROW_ID", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in HEADER_FIELDS],
                    F.col("isBot").cast("double").alias("label"))


def fit_headers_model(http: DataFrame, **kw) -> PipelineModel:
    return fit_materialised(header_stages(**kw), training_rows(http))
