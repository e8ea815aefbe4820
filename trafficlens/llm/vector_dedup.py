"""Embedding near-duplicates by product quantisation over coarse inverted lists.

Equal vectors are one node first.  A coarse k-means, fitted on a bounded
sample, deals every node to the list of its nearest centroid; its residual is
stored as one code a subspace.  Every node visits, beside its own list, each
list whose boundary with its own is at most half the reach away (two vectors of
cosine 0.95 are at most 0.316 apart, the reach; if their lists differ, the way
from one to the other crosses the boundary, so one of the two is within half of
it): of every pair, one visits the other's list, and no pair is lost to the
lists.  In a list, distances come from the visitor's tables
of subspace distances; as each node knows how far its code is off, a node
is passed on whenever it could be near enough, and the exact cosine in double
precision decides.

Scale: lists grow with the square root of the nodes; a list is compared
in blocks of about ``RESIDENTS`` by ``VISITORS`` nodes, so that a list with a third
of the nodes is many groups.  A pair counts once: from its smaller node's
visit, or from the larger's where the smaller does not visit.  A block returns a link count and a root a node, never pairs.

Defined results: a vector that is null, zero, or that holds a null or a
non-finite component links with nothing and is its own component.  Vectors of
different lengths never link; each length has its own index.  Equal vectors link with each other.  component_id ignores null
ids; kept is vec_id = component_id, null-safe.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, arrow_schema, ship_package, stored
from .components import connected

COSINE = 0.95
SUBSPACES, CODEWORDS = 8, 256
MAX_LISTS = 8192
LEAST_SAMPLE, SAMPLE_PER_LIST = 8192, 32
RESIDENTS, VISITORS = 1024, 2048
ROUNDS = 10
FOUND = "node long, links long, root long"


class Index(NamedTuple):
    coarse: object  # lists x dimensions
    books: list  # (first dimension, last, codewords x dimensions) of each subspace


# --- fitting ---------------------------------------------------------------

def _nearest(x, centres):
    import numpy as np
    norms = (centres * centres).sum(1)
    return np.concatenate([np.argmin(norms - 2 * (x[i:i + 1024] @ centres.T), axis=1) for i in range(0, max(1, len(x)), 1024)])


def _kmeans(x, k: int):
    import numpy as np
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(sample, lists: int) -> Index:
    """Centroids and residual codebooks from ``sample`` (unit vectors, rows)."""
    coarse = _kmeans(sample, min(lists, len(sample)))
    rest = sample - coarse[_nearest(sample, coarse)]
    cuts = [round(i * sample.shape[1] / min(SUBSPACES, sample.shape[1])) for i in range(min(SUBSPACES, sample.shape[1]) + 1)]
    words = max(1, min(CODEWORDS, len(sample) // 4))
    return Index(coarse, [(a, b, _kmeans(rest[:, a:b].copy(), words)) for a, b in zip(cuts, cuts[1:], strict=False)])


# --- nodes and lists -------------------------------------------------------

def _unit(vectors):
    """Unit rows in double precision; components are scaled first, so that no square runs over."""
    import numpy as np
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _encode(index: Index, own, unit):
    """Codes of the residuals, and how far each vector is from what its code spells."""
    import numpy as np
    rest = unit - index.coarse[own]
    codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in index.books], axis=1).astype(np.uint8)
    spelled = np.concatenate([book[codes[:, m]] for m, (_, _, book) in enumerate(index.books)], axis=1)
    return codes, np.sqrt(((rest - spelled) ** 2).sum(1))


def _reach(cosine: float) -> float:
    """How far apart unit vectors of this cosine are."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def _visits(index: Index, own, unit, margin: float) -> list[list[int]]:
    """Lists whose boundary with the vector's own list is at most ``margin`` away; its own is one.

    The slack is above what rounding does to the distances of vectors and centroids."""
    import numpy as np
    c, norms, out = index.coarse, (index.coarse ** 2).sum(1), []
    for i in range(0, len(unit), 256):
        u, mine = unit[i:i + 256], c[own[i:i + 256]]
        far = norms - 2 * (u @ c.T)  # squared distances, but for the vector's own square
        far -= far[np.arange(len(u)), own[i:i + 256]][:, None]
        apart = np.sqrt(np.maximum((mine ** 2).sum(1)[:, None] + norms - 2 * (mine @ c.T), 1e-24))
        out += [np.flatnonzero(row).tolist() for row in far <= 2 * margin * apart + 1e-7]
    return out


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, x (the vector, -0.0 as 0.0) and node (null where the vector can't link)."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    x = F.transform("embedding", lambda v: (v.cast("double") + F.lit(0.0)).cast("float" if single else "double"))
    rows = vectors.select("vec_id", x.alias("x"))
    fine = F.coalesce(F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(math.inf), F.lit(False))) & F.exists("x", lambda v: v != 0), F.lit(False))
    return rows.select("vec_id", "x", F.when(fine, F.xxhash64("x")).alias("node"))


def _assign(nodes: DataFrame, index, margin: float) -> DataFrame:
    def run(xs):
        unit = _unit(xs) if xs else None
        if not xs:
            return []
        model = index.value
        own = _nearest(unit, model.coarse)
        codes, off = _encode(model, own, unit)
        return [(int(o), v, c.tobytes(), float(e)) for o, v, c, e in zip(own, _visits(model, own, unit, margin), codes, off, strict=True)]
    return append_columns(nodes, "list int, visits array<int>, codes binary, off double", run, "x")


# --- comparing -------------------------------------------------------------

def _roots(n: int, a, b):
    """Smallest index reachable over the pairs (a[i], b[i]), for 0..n-1."""
    import numpy as np
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(index, cosine: float):
    schema = arrow_schema(FOUND)
    reach = _reach(cosine)

    def run(key, table):
        import numpy as np
        import pyarrow as pa
        model = index.value
        here, rows = int(key[0].as_py()), table.to_pydict()
        visits = np.array(rows["visits"], dtype=bool)
        unit = _unit(np.array(rows["x"])) if len(visits) else np.zeros((0, 1))
        node, copies = np.array(rows["node"], dtype=np.int64), np.array(rows["copies"], dtype=np.int64)
        home = np.array([here if h is None else h for h in rows["home"]], dtype=np.int64)
        # By node: a visitor of its own list looks at the residents after it only.
        order = np.argsort(node, kind="stable")
        v, r = order[visits[order]], order[~visits[order]]
        lists = len(model.coarse)
        goes = np.sort(np.array([i * lists + to for i in r.tolist() for to in rows["goes"][i]], dtype=np.int64))  # (resident, list it visits)
        links = np.zeros(len(node), dtype=np.int64)
        a_all, b_all = [], []
        if len(v) and len(r):
            codes = np.frombuffer(b"".join(rows["codes"][i] for i in r), dtype=np.uint8).reshape(len(r), -1).T.astype(np.intp)
            # Tables are in single precision; what that can add is far below the slack.
            limit = ((reach + np.array(rows["off"])[r] + 1e-3) ** 2).astype(np.float32)
            for some in [w[at:at + 256] for w in (v[home[v] == here], v[home[v] != here]) for at in range(0, len(w), 256)]:
                later = np.searchsorted(node[r], node[some[0]], side="right") if home[some[0]] == here else 0
                if later == len(r):
                    continue
                rest = unit[some] - model.coarse[here]
                far, part = np.zeros((len(some), len(r) - later), np.float32), np.empty((len(some), len(r) - later), np.float32)
                for m, (lo, hi, book) in enumerate(model.books):
                    q = rest[:, lo:hi]
                    table = ((q * q).sum(1)[:, None] + (book * book).sum(1) - 2 * (q @ book.T)).astype(np.float32)
                    far += np.take(table, codes[m, later:], axis=1, out=part, mode="clip")
                i, j = np.nonzero(far <= limit[later:])
                i, j = some[i], r[later + j]
                # The smaller node's visit counts, or the larger's where the smaller does not visit its list.
                back = j * lists + home[i]
                both = goes[np.minimum(np.searchsorted(goes, back), len(goes) - 1)] == back
                once = (node[i] < node[j]) | ((node[i] > node[j]) & ~both)
                i, j = i[once], j[once]
                for s in range(0, len(i), 1 << 15):
                    x, y = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
                    near = (unit[x] * unit[y]).sum(1) >= cosine
                    a_all.append(x[near])
                    b_all.append(y[near])
        a, b = (np.concatenate(a_all), np.concatenate(b_all)) if a_all else (np.zeros(0, int), np.zeros(0, int))
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        # A node is here as visitor and as resident: its smallest index stands for both.
        _, first, same = np.unique(node, return_index=True, return_inverse=True)
        root = node[first][_roots(len(first), same[a], same[b])] if len(first) else node[:0]
        total = np.bincount(same, weights=links, minlength=len(first)).astype(np.int64)
        hit = total > 0
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((node[first][hit], total[hit], root[hit]), schema, strict=True)], schema=schema)
    return run


def linked(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """node, links (copies of other nodes linked) and root rows of blocks, from nodes (node, x, copies) of one length."""
    import numpy as np
    sc, n = nodes.sparkSession.sparkContext, nodes.count()
    lists = min(MAX_LISTS, 1 << max(0, round(math.log2(max(1.0, math.sqrt(n) / 2)))))
    wanted = max(LEAST_SAMPLE, SAMPLE_PER_LIST * lists)
    share = min(1.0, wanted / max(1, n))
    # The hash is uniform: about ``wanted`` nodes, whatever the input.
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).orderBy("node").select("x").collect()
    if not sample:
        return nodes.sparkSession.createDataFrame([], FOUND)
    index = sc.broadcast(fit(_unit(np.array([r.x for r in sample])), lists))
    dealt = stored(_assign(nodes, index, _reach(cosine) / 2), "dealt")
    residents = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    visitors = dealt.select(F.explode("visits").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("v"))
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    # One row a list, at most MAX_LISTS.
    blocks = F.broadcast(residents.join(visitors, "list").select("list", parts("n", RESIDENTS).alias("rs"), parts("v", VISITORS).alias("vs")))
    part = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    stay = dealt.join(blocks, "list").withColumn("r", part("rs")).withColumn("v", every("vs")) \
        .select("list", "r", "v", F.lit(False).alias("visits"), "node", "x", "copies", "codes", "off", F.lit(None).cast("int").alias("home"),
                F.col("visits").alias("goes"))
    go = dealt.select("node", "x", "copies", F.col("list").alias("home"), F.explode("visits").alias("list")).join(blocks, "list").withColumn("v", part("vs")) \
        .withColumn("r", every("rs")).select("list", "r", "v", F.lit(True).alias("visits"), "node", "x", "copies",
                                             F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("off"), "home",
                                             F.lit(None).cast("array<int>").alias("goes"))
    ship_package(nodes.sparkSession)
    return stay.union(go).groupBy("list", "r", "v").applyInArrow(_compare(index, cosine), FOUND)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row a row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows = valid(vectors)
    nodes = stored(rows.where("node is not null").groupBy("node", "x").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "nodes")
    # A single node of its length has nothing to be compared with.
    sizes = [r.n for r in nodes.groupBy(F.size("x").alias("n")).count().where("count > 1").orderBy("n").collect()]
    of_size = [linked(nodes.where(F.size("x") == n).select("node", "x", "copies"), cosine) for n in sizes]
    found = stored(reduce(DataFrame.union, of_size) if of_size else nodes.sparkSession.createDataFrame([], FOUND), "vector-links")
    roots = connected(found.select("node", "root"), "node", "root").select("node", F.col("root").alias("top"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies", "least").join(links, "node", "left").join(roots, "node", "left")
    known = known.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", F.coalesce("top", "node").alias("top"))
    known = stored(known, "vector-nodes")
    first = known.groupBy("top").agg(F.min("least").alias("component"))
    named = known.join(first, "top").select(F.col("node").alias("of"), F.col("n_links").alias("n"), "component")
    component: Column = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = rows.select("vec_id", "node").join(named, F.col("node") == F.col("of"), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id")) \
        .select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
