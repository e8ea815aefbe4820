"""M9's grid in one fit: every map's logistic model on shared login counts, one gradient pass for all.

A map is a pair of period numbers and a list of credential types.  Logins are
counted once by (user, time, type), dealt once by user and packed: a chunk holds
the logins of some thousand users as arrays.  Only chunks are kept; a pass puts
their logins into the buckets of a pair at a time, so spread counts are neither
shuffled nor written.  Of a user with more logins than a chunk, those that no pair
parts are one, so that a user's logins are bounded by the grid.

The maps' weights lie behind each other in one vector, bounded by the grid.  A step
sends it to the tasks, which sum loss and gradient of their chunks for the maps that
are still moving, each task once; the sums are added up by pieces of the vector.
L-BFGS with a step length a map, on the driver, moves all maps at once: a step is
one pass over the chunks, or three if a map's length is halved, the second for the
losses at all shorter lengths and the third for the gradient at the chosen ones,
both for such maps only.

The objective is the single classifier's (``BucketLogit``): mean log loss of the
users that have a counted row, plus 1 / (2 C n) of the squared weights without the
intercept.  Users have one label, that of their first row.
"""

from __future__ import annotations

import json
from itertools import product
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.timebuckets import ts_buckets
from trafficlens.operators.aggregates import first_label
from trafficlens.plans.bucket_logit import BucketLogit
from trafficlens.plans.many import minimise
from trafficlens.session import cut_lineage, session

# The parameter grid.
GRID_PARTS = [1, 2, 3, 4, 5, 6, 7, 8]
GRID_SHORT_PARTS = [1, 10, 20, 30, 40, 50, 100, 150, 200, 700, 1500]

#: Up to TASKS tasks a core, of LEAST_USERS or more; more tasks where these would have over MOST_USERS.  A chunk's logins, about.
LEAST_USERS, TASKS, MOST_USERS, CHUNK_LOGINS = 256, 2, 32_768, 65_536
#: Numbers of the summed vector that are added up together.
PIECE = 65_536


class Grid(NamedTuple):
    """All pairs with all type lists (an empty list: every row counts)."""
    parts: list[int]
    short_parts: list[int]
    types: list[list[str]]

    def pairs(self) -> list[tuple[int, int]]:
        return list(product(self.parts, self.short_parts))

    def maps(self) -> list[dict]:
        return [{"parts": p, "shortParts": s, "credentialTypes": t} for p, s in self.pairs() for t in self.types]

    def kinds(self) -> list[str]:
        return sorted({t for listed in self.types for t in listed})

    def starts(self) -> list[int]:
        """Where each map's weights begin; its bucket g is g places on, bucket 0, which is left out, is the intercept."""
        sizes, out = [p * s + 1 for p, s in self.pairs() for _ in self.types], [0]
        for n in sizes:
            out.append(out[-1] + n)
        return out


def shared_counts(df: DataFrame, grid: Grid, lo: float, hi: float, user: str = "USER_ID", ts: str = "TIMESTAMP",
                  kind: str = "LOGIN_CREDENTIAL_TYPE", label: str = "isBot", order: str = "ROW_ID", slices: int = 1) -> DataFrame:
    """(span, labels, entries, at, kinds, counts): chunks of whole users' counted logins, made in ``slices`` tasks: the users'
    labels and numbers of entries, and of the entries the time since ``lo``, the type and the count (none if all are 1)."""
    code = F.lit(0)
    for i, t in enumerate(grid.kinds(), 1):
        code = F.when(F.col(kind) == t, i).otherwise(code)
    counted = df.where(F.col(ts).isNotNull()).groupBy(user, ts, code.alias("kind")).agg(F.count(F.lit(1)).alias("c")).join(first_label(df, user, label, order), user)
    dealt = counted.repartition(slices, user).sortWithinPartitions(user, ts).select(
        F.col(user).alias("user"), F.col(label).cast("double").alias("label"), (F.col(ts) - F.lit(lo)).cast("double").alias("at"), "kind", F.col("c").cast("double").alias("c"))
    return dealt.mapInArrow(_packer(grid, hi - lo), "span double, labels binary, entries binary, at binary, kinds binary, counts binary")


def _packer(grid: Grid, span: float):
    """Logins in order of user and time -> chunks.  The last user of some thousand logins may have more to come: its logins go
    into the next chunk."""
    pairs, width, kind_type, buckets = grid.pairs(), len(grid.kinds()) + 1, _kind_type(grid), ts_buckets()

    def thinned(logins):
        """A user's logins; those of a type that lie in one bucket of every pair are one."""
        import numpy as np
        import pyarrow as pa
        at, kind, n = (logins.column(c).to_numpy() for c in ("at", "kind", "c"))
        parted = np.zeros(len(at), bool)
        for _, bucket in buckets(at, span, pairs):
            parted |= np.diff(bucket, prepend=bucket[0]) != 0
        _, first, cell = np.unique(np.cumsum(parted) * width + kind, return_index=True, return_inverse=True)
        kept, c = logins.take(pa.array(first)), pa.array(np.bincount(cell, n))
        return pa.Table.from_arrays([c if name == "c" else kept.column(name) for name in logins.column_names], schema=logins.schema)

    def chunk(logins, heads):
        import numpy as np
        import pyarrow as pa
        labels, at, kind, n = (logins.column(c).to_numpy() for c in ("label", "at", "kind", "c"))
        whole = (n == np.floor(n)).all() and n.max() < 1 << 16
        n = n[:0] if (n == 1).all() else n.astype("uint8" if n.max() < 256 else "uint16") if whole else n
        packed = labels[heads], np.diff(heads, append=len(at)).astype(np.int32), at, kind.astype(kind_type), n
        return pa.RecordBatch.from_arrays([pa.array([span]), *(pa.array([v.tobytes()], pa.binary()) for v in packed)], names=["span", "labels", "entries", "at", "kinds", "counts"])

    def cut(logins, last):
        """The chunk of all users but the last, if there is one (of all, if no more logins come), and the logins left."""
        import numpy as np
        import pyarrow.compute as pc
        users = logins.column("user").combine_chunks()
        heads = np.flatnonzero(np.append(True, pc.not_equal(users.slice(1), users.slice(0, len(users) - 1)).to_numpy(zero_copy_only=False)))
        end = len(users) if last else int(heads[-1])
        return [chunk(logins.slice(0, end), heads[heads < end])] if end else [], logins.slice(end)

    def run(batches):
        import pyarrow as pa
        held, new = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            new += batch.num_rows
            if new >= CHUNK_LOGINS:
                made, left = cut(pa.concat_tables(held), False)
                yield from made
                held, new = [left if len(left) < CHUNK_LOGINS else thinned(left)], 0
        if held and (logins := pa.concat_tables(held)).num_rows:
            yield from cut(logins, True)[0]
    return run


def _kind_type(grid: Grid) -> str:
    return "uint8" if len(grid.kinds()) < 256 else "int32"


def _scorer(grid: Grid, asked):
    """The function that scores an Arrow batch for the asked maps; made here so that it travels with the tasks' own.  The batch
    has chunks, or rows (label, pair, buckets, kinds, counts) of a user's counts under a pair."""
    starts, kinds, pairs, lists, kind_type = grid.starts(), grid.kinds(), grid.pairs(), len(grid.types), _kind_type(grid)
    counts_for = [[not t, *[k in t or not t for k in kinds]] for t in grid.types]
    buckets, wanted = ts_buckets(), [i for i in range(len(pairs)) if asked[i * lists:(i + 1) * lists].any()]

    def parts(batch):
        """(labels, entries a row, kinds, counts or None, the entries' buckets by pair) of what lies under the same pairs."""
        import numpy as np
        if "at" not in batch.schema.names:
            pair, labels = batch.column("pair").to_numpy(), batch.column("label").to_numpy()
            entries = batch.column("buckets").value_lengths().to_numpy(zero_copy_only=False)
            bucket, kind, n = (batch.column(c).flatten().to_numpy() for c in ("buckets", "kinds", "counts"))
            for i in wanted:
                mine = np.repeat(pair == i, entries)
                yield labels[pair == i], entries[pair == i], kind[mine], n[mine], [(i, bucket[mine])]
            return
        for i, span in enumerate(batch.column("span").to_pylist()):
            numbers = lambda name, form: np.frombuffer(batch.column(name)[i].as_buffer(), form)  # noqa: B023, E731  used within the turn
            at, width = numbers("at", "float64"), len(batch.column("counts")[i].as_buffer())
            n = numbers("counts", {1: "uint8", 2: "uint16", 8: "float64"}[width // len(at)]) if width else None
            placed = ((wanted[k], b) for k, b in buckets(at, span, [pairs[k] for k in wanted]))
            yield numbers("labels", "float64"), numbers("entries", "int32"), numbers("kinds", kind_type), n, placed

    def scores(batch, *weights):
        """(map, labels, which rows the map counts, margins under each of ``weights``, entries a row, places, counts or None);
        place 0 has the entries that have no bucket, which weigh nothing."""
        import numpy as np
        for labels, entries, kind, n, placed in parts(batch):
            row, mine = np.repeat(np.arange(len(labels)), entries), []
            for chosen in counts_for:
                used = np.flatnonzero(np.array(chosen)[kind])
                first = np.flatnonzero(np.diff(row[used], prepend=-1))
                mine.append((slice(None) if len(used) == len(kind) else used, labels[row[used][first]], first, np.diff(first, append=len(used)), None if n is None else n[used]))
            for pair, bucket in placed:
                size, bucket = pairs[pair][0] * pairs[pair][1] + 1, bucket.astype(np.intp)
                if bucket.min(initial=0) < 0 or bucket.max(initial=0) >= size:
                    bucket = np.where((bucket > 0) & (bucket < size), bucket, 0)
                for i, (used, actual, first, of, c) in enumerate(mine):
                    m = pair * lists + i
                    if not asked[m] or not len(first):
                        continue
                    place, margins = bucket[used], []
                    for w in weights:
                        own = w[starts[m]:starts[m + 1]].copy()
                        base, own[0] = own[0], 0.0
                        v = own.take(place)
                        margins.append(np.add.reduceat(v if c is None else v * c, first) + base)
                    yield m, actual, np.add.reduceat(place, first) > 0, margins, of, place, c
    return scores


def _totals(rows: DataFrame, size: int, add):
    """``add(batch, out)`` adds a batch's numbers to ``out``, of ``size``; a task gives its sums once, and these are summed."""
    import numpy as np

    def sent(sums):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["piece", "v"])

    def run(batches):
        import numpy as np
        out = np.zeros(size)
        for batch in batches:
            add(batch, out)
        yield sent({k: v for k in range(-(-size // PIECE)) if (v := out[k * PIECE:(k + 1) * PIECE]).any()})

    def merged(batches):
        import numpy as np
        sums = {}
        for batch in batches:
            for i, k in enumerate(batch.column("piece").to_pylist()):
                v = np.frombuffer(batch.column("v")[i].as_buffer())
                sums[k] = sums[k] + v if k in sums else v.copy()
        yield sent(sums)
    form = "piece int, v binary"
    found = rows.mapInArrow(run, form).repartition("piece").mapInArrow(merged, form).toArrow()  # bounded by the grid
    out = np.zeros(size)
    for k, v in zip(found["piece"].to_pylist(), found["v"].to_pylist(), strict=True):
        out[k * PIECE:(k + 1) * PIECE] = np.frombuffer(v)
    return out


def _sums(counts: DataFrame, grid: Grid, weights, asked):
    """Summed loss and users a map, and the summed gradient, of the asked maps at ``weights``."""
    scores, starts, total, maps = _scorer(grid, asked), grid.starts(), grid.starts()[-1], len(grid.maps())

    def add(batch, out):
        import numpy as np
        for m, labels, there, (margin,), entries, place, n in scores(batch, weights):
            sign = 2 * labels - 1
            z = sign * margin
            pull = np.where(there, -sign / (1 + np.exp(np.clip(z, -700, 700))), 0.0)
            spread, a, b = np.repeat(pull, entries), starts[m], starts[m + 1]
            g = np.bincount(place, spread if n is None else spread * n, b - a)
            g[0] = pull.sum()
            out[a:b] += g
            out[total + m] += np.logaddexp(0, -z[there]).sum()
            out[total + maps + m] += there.sum()
    out = _totals(counts, total + 2 * maps, add)
    return out[total:total + maps], out[total + maps:], out[:total]


def _losses_along(counts: DataFrame, grid: Grid, weights, direction, lengths, asked):
    """Summed loss of the asked maps at weights - length * direction: lengths x maps."""
    scores, maps = _scorer(grid, asked), len(grid.maps())

    def add(batch, out):
        import numpy as np
        for m, labels, there, (margin, slope), *_ in scores(batch, weights, direction):
            sign, margin, slope = 2 * labels[there] - 1, margin[there], slope[there]
            for i, length in enumerate(lengths):
                out[i * maps + m] += np.logaddexp(0, -sign * (margin - length * slope)).sum()
    return _totals(counts, len(lengths) * maps, add).reshape(len(lengths), maps)


def fit_all(counts: DataFrame, grid: Grid, C: float = 1.0, iterations: int = 40, tolerance: float = 1e-4):
    """The weights of all maps (see ``Grid.starts``), by L-BFGS over all of them at once."""
    import numpy as np
    starts = np.array(grid.starts())
    free = np.zeros(starts[-1], bool)
    free[starts[:-1]] = True  # intercepts
    users = np.ones(len(starts) - 1)  # a map's, once it has been asked

    def penalty(x):
        kept = np.where(free, 0.0, x)
        return np.add.reduceat(kept * kept, starts[:-1]) / (2 * C * users)

    def at(x, asked):
        loss, n, g = _sums(counts, grid, x, asked)
        users[asked] = np.maximum(n, 1)[asked]
        pull = np.where(free, 0.0, x / np.repeat(C * users, np.diff(starts)))
        return loss / users + penalty(x), g / np.repeat(users, np.diff(starts)) + pull

    def along(x, q, lengths, asked):
        losses = _losses_along(counts, grid, x, q, lengths, asked)
        return np.stack([loss / users + penalty(x - length * q) for length, loss in zip(lengths, losses, strict=True)])
    return minimise(at, starts, iterations, tolerance, along=along)[0]


def map_scores(counts: DataFrame, grid: Grid, weights) -> DataFrame:
    """(params, f1) of every map on ``counts``: F1 of class 1 over the users that it counts."""
    import numpy as np
    scores, maps = _scorer(grid, np.ones(len(grid.maps()), bool)), len(grid.maps())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        hits, wrong = np.zeros(maps), np.zeros(maps)
        for batch in batches:
            for m, labels, there, (margin,), *_ in scores(batch, weights):
                said, actual = margin[there] > 0, labels[there] > 0
                hits[m] += (said & actual).sum()
                wrong[m] += (said != actual).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(maps)), pa.array(hits), pa.array(wrong)], names=["map", "hits", "wrong"])
    sums = counts.mapInArrow(run, "map long, hits double, wrong double").groupBy("map").agg(F.sum("hits").alias("hits"), F.sum("wrong").alias("wrong"))
    named = session().createDataFrame([(i, json.dumps(m)) for i, m in enumerate(grid.maps())], "map long, params string")
    f1 = F.when(F.col("hits") > 0, 2 * F.col("hits") / (2 * F.col("hits") + F.col("wrong"))).otherwise(0.0)
    return named.join(F.broadcast(sums), "map", "left").select("map", "params", F.coalesce(f1, F.lit(0.0)).alias("f1"))


def search(train: DataFrame, valid: DataFrame, grid: Grid, C: float = 1.0, ts: str = "TIMESTAMP", **columns) -> tuple[DataFrame, dict]:
    """The maps' scores on ``valid`` (params, f1, best), fitted on ``train``, and the best map with the time range (ties: the first)."""
    lo, hi, users = train.agg(F.min(ts), F.max(ts), F.approx_count_distinct(columns.get("user", "USER_ID"))).first()
    lo, hi = float(lo), float(hi)
    slices = 1 + max(min(TASKS * session().sparkContext.defaultParallelism - 1, users // LEAST_USERS), users // MOST_USERS)
    placed = {"ts": ts, "slices": slices, **columns}
    counts = cut_lineage(shared_counts(train, grid, lo, hi, **placed))
    weights = fit_all(counts, grid, C)
    rows = sorted(map_scores(shared_counts(valid, grid, lo, hi, **placed), grid, weights).collect())
    best = max(range(len(rows)), key=lambda i: (rows[i].f1, -i))
    table = session().createDataFrame([(r.params, r.f1, i == best) for i, r in enumerate(rows)], "params string, f1 double, best boolean")
    return table, grid.maps()[best]


def refitted(best: dict, train: DataFrame, **fixed):
    """The best map's classifier, fitted by itself on ``train``."""
    return BucketLogit(**best, **fixed).fit(train)
