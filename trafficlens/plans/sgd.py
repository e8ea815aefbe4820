"""M7, T5: linear learners that go on learning, batch by batch, from the weights that the last batch left.

A row is sparse: ``slots`` (array of int, below ``size``), ``values`` (array of
double) and ``label`` (0 or 1).  A batch makes ``steps`` gradient steps over its rows; a
step is one pass in which every task sums its rows' gradients by slot, and one
combining aggregate over them.  The weights are the model: ``size`` numbers, on
the driver and with the tasks.

The state (weights, bias, steps done) is written under the batch's number, and
batch b starts from the state of the batch before it.  A batch that is tried
again starts from that same state, so it ends in the same weights, whatever the
failed try left; a run that is started again goes on behind the last batch that
is whole.

Unlike a first ``fit`` that refuses it, a batch of one class is a batch like
any other; an empty batch leaves the weights as they are.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.scalars import hash_bucket
from trafficlens.session import path_exists

HINGE, LOG = "hinge", "log"


class Learner(NamedTuple):
    """What is learned and how: the step size falls with the root of the steps done."""
    size: int
    loss: str = HINGE
    alpha: float = 1e-4
    eta: float = 1.0
    steps: int = 2


class State(NamedTuple):
    weights: list[float]
    bias: float
    done: int


def start(learner: Learner) -> State:
    return State([0.0] * learner.size, 0.0, 0)


def one_hot_slots(columns: list[str], buckets: int) -> tuple[Column, Column]:
    """(slots, values): each column's text in one of its ``buckets`` slots."""
    slots = F.array(*[(hash_bucket(F.coalesce(F.col(c).cast("string"), F.lit("")), buckets) + i * buckets).cast("int") for i, c in enumerate(columns)])
    return slots, F.array(*[F.lit(1.0)] * len(columns))


def count_slots(columns: list[str]) -> tuple[Column, Column]:
    """(slots, values): one slot a numeric column."""
    return F.array(*map(F.lit, range(len(columns)))), F.array(*[F.col(c).cast("double") for c in columns])


def _margins():
    """The function that scores an Arrow batch, rows x models (a row of ``weights`` is a model); made here so that it
    travels to the tasks with their own function."""
    def margins(batch, weights, biases):
        import numpy as np
        row = np.repeat(np.arange(batch.num_rows), batch.column("slots").value_lengths().to_numpy(zero_copy_only=False))
        slots, values = batch.column("slots").flatten().to_numpy(), batch.column("values").flatten().to_numpy()
        out = np.tile(np.asarray(biases, float), (batch.num_rows, 1))
        for m, w in enumerate(np.atleast_2d(weights)):
            out[:, m] += np.bincount(row, values * w[slots], batch.num_rows)
        return out, row, slots, values
    return margins


def gradient(rows: DataFrame, learner: Learner, state: State) -> DataFrame:
    """(slot, g, n): the loss's gradient over ``rows`` by slot, summed, with the number of rows behind it; the bias is
    the slot after the last, and every row counts there."""
    import numpy as np
    weights, bias, size, hinge, margins_of = np.array(state.weights), state.bias, learner.size, learner.loss == HINGE, _margins()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            margins, row, slots, values = margins_of(batch, weights, [bias])
            sign = 2.0 * batch.column("label").to_numpy(zero_copy_only=False) - 1.0
            margin = sign * margins[:, 0]
            pull = np.where(margin < 1.0, -sign, 0.0) if hinge else -sign / (1.0 + np.exp(np.minimum(margin, 700.0)))
            g = np.append(np.bincount(slots, pull[row] * values, size), pull.sum())
            seen = np.union1d(np.flatnonzero(g), [size])
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(g[seen]), pa.array(np.where(seen == size, batch.num_rows, 0), pa.int64())],
                                             names=["slot", "g", "n"])
    parts = rows.select("slots", "values", F.col("label").cast("double").alias("label")).mapInArrow(run, "slot int, g double, n long")
    return parts.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def stepped(learner: Learner, state: State, sums: list) -> State:
    """The state after a step along the summed gradient: rows (slot, g, n)."""
    n = sum(r["n"] for r in sums)
    if not n:
        return state
    eta = learner.eta / (1 + state.done) ** 0.5
    weights = [w * (1 - eta * learner.alpha) for w in state.weights]
    bias = state.bias
    for r in sums:
        if r["slot"] == learner.size:
            bias -= eta * r["g"] / n
        else:
            weights[r["slot"]] -= eta * r["g"] / n
    return State(weights, bias, state.done + 1)


def learn(rows: DataFrame, learner: Learner, state: State) -> State:
    """The state after a batch, whose rows are held (in memory, else on disk) while the steps go over them."""
    held = rows.select("slots", "values", "label").persist()
    try:
        for _ in range(learner.steps):
            state = stepped(learner, state, sorted(gradient(held, learner, state).collect()))  # a sum a slot: bounded by the model
    finally:
        held.unpersist()
    return state


# --- states under their batches -------------------------------------------------------

def _path(folder: str, batch: int) -> str:
    return f"{folder}/state/_batch={batch}"


def write_state(spark: SparkSession, folder: str, batch: int, state: State) -> None:
    spark.createDataFrame([tuple(state)], "weights array<double>, bias double, done long").coalesce(1).write.mode("overwrite").parquet(_path(folder, batch))


def read_state(spark: SparkSession, folder: str, batch: int) -> State:
    return State(*spark.read.parquet(_path(folder, batch)).first())


def learn_batch(rows: DataFrame, batch: int, learner: Learner, folder: str) -> State:
    """One batch: from the state of the batch before to its own, which is written over what an earlier try left."""
    spark = rows.sparkSession
    state = learn(rows, learner, read_state(spark, folder, batch - 1) if batch else start(learner))
    write_state(spark, folder, batch, state)
    return state


def learn_batches(batches: Iterable[DataFrame], learner: Learner, folder: str, spark: SparkSession) -> int:
    """Batches in order; those whose state is there are not learned again.  The number of batches."""
    at = -1
    for at, rows in enumerate(batches):
        if not path_exists(spark, f"{_path(folder, at)}/_SUCCESS"):
            learn_batch(rows, at, learner, folder)
    return at + 1


def learn_stream(stream: DataFrame, learner: Learner, folder: str, prepare=lambda batch: batch, before: int = 0) -> None:
    """Every micro-batch, prepared as rows, is a batch; ``before`` batches were learned from other streams, one after another."""
    q = (stream.writeStream.foreachBatch(lambda batch, i: learn_batch(prepare(batch), before + i, learner, folder) and None)
         .option("checkpointLocation", f"{folder}/checkpoint{f'-{before}' if before else ''}").trigger(availableNow=True).start())
    q.awaitTermination()


def states(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, weights, bias, done) of every batch."""
    found = spark.read.option("basePath", f"{folder}/state").parquet(f"{folder}/state/_batch=*")
    return found.select(F.col("_batch").alias("batch"), "weights", "bias", "done")


# --- scores ---------------------------------------------------------------------------

def scored(rows: DataFrame, state: State) -> DataFrame:
    """``rows`` with score (the margin) and prediction."""
    import numpy as np
    from pyspark.sql.types import DoubleType, StructField, StructType
    weights, bias, margins = np.array(state.weights), state.bias, _margins()
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("prediction", DoubleType())])

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            score = margins(batch, weights, [bias])[0][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score > 0).astype(float))], names=[*batch.schema.names, "score", "prediction"])
    return rows.mapInArrow(run, schema)


def curve(rows: DataFrame, folder: str) -> DataFrame:
    """(batch, f1): the F1 of class 1 on ``rows`` after each batch, in one pass over them."""
    import numpy as np
    spark = rows.sparkSession
    found = states(spark, folder).orderBy("batch").collect()  # the models: batches x size numbers
    weights, biases, margins = np.array([r.weights for r in found]), [r.bias for r in found], _margins()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            said = margins(batch, weights, biases)[0] > 0
            actual = batch.column("label").to_numpy(zero_copy_only=False)[:, None] > 0
            yield pa.RecordBatch.from_arrays([pa.array(range(len(biases)), pa.int32()), pa.array((said & actual).sum(0)), pa.array((said != actual).sum(0))],
                                             names=["at", "hits", "wrong"])
    parts = rows.select("slots", "values", F.col("label").cast("double").alias("label")).mapInArrow(run, "at int, hits long, wrong long")
    sums = parts.groupBy("at").agg(F.sum("hits").alias("hits"), F.sum("wrong").alias("wrong"))
    named = spark.createDataFrame([(i, r.batch) for i, r in enumerate(found)], "at int, batch int")
    f1 = F.when(F.col("hits") > 0, 2.0 * F.col("hits") / (2 * F.col("hits") + F.col("wrong"))).otherwise(0.0)
    return named.join(F.broadcast(sums), "at", "left").select("batch", F.coalesce(f1, F.lit(0.0)).alias("f1"))
