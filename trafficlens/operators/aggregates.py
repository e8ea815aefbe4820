"""Aggregates.  All combine map-side (partial aggregation) so a
hot key never gathers raw rows in one task; global scalars are scalar
subqueries, not driver round trips or cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.timebuckets import bucket_columns


def activity_counts(df: DataFrame, bounds, key: str = "IP", ts: str = "TIMESTAMP",
                    label: str = "BOT_OR_HUMAN") -> DataFrame:
    """A1: per key, all rows with a ts, rows per half-day bucket, and the label of the first row."""
    b = bucket_columns(ts, bounds)
    names = [f"ACT_{i}" for i in range(1, len(bounds) + 1)]
    return df.select(key, ts, label, *b).groupBy(key).agg(
        F.count(ts).alias("COUNT_ACT_WEEK"),
        *[F.count(n).alias(f"COUNT_{n}") for n in names],
        F.min_by(F.col(label), F.col(ts)).alias("label"))


def var_samp_exact(c: str, origin: int = 0) -> Column:
    """Sample variance of an integral column from exact integer moments.

    (n*sum(x^2) - sum(x)^2) / (n*(n-1)) with x = c - origin summed as
    decimal(38,0): no cancellation error, and every engine rounds the one final
    division the same way.  ``origin`` near the data keeps the sums small.
    """
    x = (F.col(c) - F.lit(origin)).cast("decimal(38,0)")
    n = F.count(c).cast("decimal(38,0)")
    num = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    return F.when(F.count(c) > 1, num.cast("double") / (n * (n - 1)).cast("double"))


def simple_stats(df: DataFrame, key: str, ts: str = "TIMESTAMP", origin: int | None = None) -> DataFrame:
    """A2: mean truncated to LONG, sample variance, max, min per key.

    With ``origin`` (integral ts) the variance is exact (``var_samp_exact``);
    otherwise Spark's streaming ``var_samp``.
    """
    var = var_samp_exact(ts, origin) if origin is not None else F.var_samp(ts)
    return df.groupBy(key).agg(
        F.avg(ts).cast("long").alias("MEAN"),
        var.alias("variance"),
        F.max(ts).alias("MAX"),
        F.min(ts).alias("MIN"))


def span_days(df: DataFrame, ts: str = "TIMESTAMP", unit_per_day: int = 86400) -> DataFrame:
    """A3: (max - min) / units per day, as a 1-row DataFrame (86400 for s, 86400000 for ms)."""
    return df.agg(((F.max(ts) - F.min(ts)) / F.lit(float(unit_per_day))).alias("span_days"))


def credential_profile(df: DataFrame, user: str = "USER_ID", label: str = "isBot",
                       type_col: str = "LOGIN_CREDENTIAL_TYPE") -> DataFrame:
    """A4: mean per-user count of each type, over all users / bots / users.

    Mean over the users of a class that have at least one row; a type the
    class never has gives null (missing), as in the reference's side-by-side table.
    """
    clean = df.where(F.col(user).isNotNull() & F.col(type_col).isNotNull())
    per = clean.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(F.col(label) == 1).alias("_bots"),
        F.count_if(F.col(label) == 0).alias("_users"))
    # One pass over the distinct (user, label) pairs gives all three user counts,
    # as one scalar subquery returning a struct.
    nu = clean.select(user, label).distinct().agg(F.struct(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col(label) == 1).alias("n_bots"),
        F.count_if(F.col(label) == 0).alias("n_users"))).scalar()
    n_all, n_bots, n_users = nu["n_all"], nu["n_bots"], nu["n_users"]
    return per.select(
        type_col,
        (F.col("_all") / n_all).alias("mean_all"),
        F.when(F.col("_bots") > 0, F.col("_bots") / n_bots).alias("mean_bots"),
        F.when(F.col("_users") > 0, F.col("_users") / n_users).alias("mean_users"))


def bucket_counts(df: DataFrame, user: str, group: str, drop_first: bool = True,
                  count_col: str = "n") -> DataFrame:
    """User x bucket count matrix in long form; ``drop_first`` drops bucket 0
    as the reference's ``[:, 1:]`` slice does."""
    src = df.where(F.col(group) != 0) if drop_first else df
    return src.groupBy(user, group).agg(F.count(F.lit(1)).alias(count_col))


def row_normalise(df: DataFrame, user: str, count_col: str = "n", out: str = "share") -> DataFrame:
    """Each count over the user's total (rows per user are bounded by the
    bucket count, a parameter, so the per-user window stays small)."""
    tot = F.sum(count_col).over(Window.partitionBy(user))
    return df.withColumn(out, F.when(tot != 0, F.col(count_col) / tot).otherwise(F.lit(0.0)))


def first_label(df: DataFrame, user: str, label: str, order: str) -> DataFrame:
    """A10: the label of each user's first row."""
    return df.groupBy(user).agg(F.min_by(F.col(label), F.col(order)).alias(label))


def count_frequency_quantile(df: DataFrame, group: str, user: str, q: float,
                             out: str = "size") -> DataFrame:
    """Rows per (group, user) -> users per count -> q-quantile of those
    frequencies per group (linear interpolation, exact)."""
    per_user = df.groupBy(group, user).agg(F.count(F.lit(1)).alias("_n"))
    freq = per_user.groupBy(group, "_n").agg(F.count(F.lit(1)).alias("_freq"))
    return freq.groupBy(group).agg(F.percentile(F.col("_freq"), F.lit(float(q))).alias(out))


def signed_vote(df: DataFrame, user: str, n: str, q_users: str, q_bots: str,
                out: str = "predicted") -> DataFrame:
    """Sum of sign(|n - q_users| - |n - q_bots|) per user; > 0 means bot.

    Distances that agree to nine digits are equal, so that a tie does not hang on
    how a quantile was interpolated.
    """
    s = F.signum(F.round(F.abs(F.col(n) - F.col(q_users)) - F.abs(F.col(n) - F.col(q_bots)), 9))
    return df.groupBy(user).agg(F.sum(s).alias("vote")).withColumn(out, (F.col("vote") > 0).cast("int"))


def value_counts(df: DataFrame, col: str, top: int | None = None, count_col: str = "count") -> DataFrame:
    """Non-null values by count, descending (ties by value)."""
    out = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(count_col)) \
        .orderBy(F.desc(count_col), col)
    return out.limit(top) if top else out


def normalised_crosstab(df: DataFrame, a: str, b: str, out: str = "share") -> DataFrame:
    """count(a, b) / grand total."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.groupBy(a, b).agg((F.count(F.lit(1)) / total).alias(out))


def counts_by_class(df: DataFrame, value: str, target: str, count_col: str = "count") -> DataFrame:
    """Rows per (value, class)."""
    return df.groupBy(value, target).agg(F.count(F.lit(1)).alias(count_col))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """The distinct values (null included, like pandas unique)."""
    return df.select(col).distinct()


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Number of distinct values, null counted as one value."""
    nd = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg((nd + F.max(F.col(col).isNull().cast("int"))).alias("n_unique"))


def non_null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Non-null count per column, one row."""
    return df.agg(*[F.count(c).alias(c) for c in (cols or df.columns)])


def text_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, unique, top, freq per text column (ties for top by value).

    All columns go through one long-form aggregate: (column, value) counts are
    combined map-side, then reduced per column.  A column of nulls has count 0
    and unique 0, and no top.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                         for c in cols])).alias("kv")).select("kv.*")
    vc = long.groupBy("column", "value").agg(F.count("value").alias("_c"))
    known = F.col("value").isNotNull()
    return vc.groupBy("column").agg(
        F.sum("_c").alias("count"),
        F.count("value").alias("unique"),
        F.min_by(F.col("value"), F.when(known, F.struct(-F.col("_c"), F.col("value")))).alias("top"),
        F.max(F.when(known, F.col("_c"))).alias("freq"))


def user_rollup(df: DataFrame, user: str, p: str, y: str, bound: float = 0.9) -> DataFrame:
    """Max score and max label per user, then > bound."""
    return df.groupBy(user).agg(F.max(p).alias("max_p"), F.max(y).alias("y")) \
        .withColumn("pred", (F.col("max_p") > F.lit(bound)).cast("int"))


def score_range(df: DataFrame, p: str) -> DataFrame:
    """A20."""
    return df.agg(F.min(p).alias("min_p"), F.max(p).alias("max_p"), F.avg(p).alias("mean_p"))


def majority_baseline(df: DataFrame, y: str) -> DataFrame:
    """1 - mean(y)."""
    return df.agg((F.lit(1.0) - F.avg(y)).alias("baseline"))


def non_null_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """count(c) / count(*) per column."""
    n = F.count(F.lit(1))
    return df.agg(*[(F.count(c) / n).alias(c) for c in cols])


def predicted_positive(df: DataFrame, p1: Column | str, p0: Column | str | None = None) -> DataFrame:
    """Rows with p0 < p1 (p0 = 1 - p1 when not given)."""
    c1 = F.col(p1) if isinstance(p1, str) else p1
    c0 = (F.lit(1.0) - c1) if p0 is None else (F.col(p0) if isinstance(p0, str) else p0)
    return df.agg(F.count_if(c0 < c1).alias("n_pred_bots"))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a 1-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
