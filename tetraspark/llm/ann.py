"""Approximate nearest neighbours along shifted Hilbert curves.

Every distinct vector is projected to a few dimensions, shifted and placed on a Hilbert curve; each
of several curves uses a projection and shift of its own. Spark range-partitions the vectors along
each curve and so gives every point a place on it. A query's windows of places on all curves, merged,
are its candidates, and these are reranked by their exact inner product. Curve neighbours are only
as near as the data's structure allows, so the window is calibrated: it is the least one that holds
RECALL of the true neighbours of a bounded set of probes, which are answered exactly. Clustered
vectors need short windows; vectors without any structure need windows that are a large part of the
table, which only a scan can better.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, ship
from .hilbert import hilbert_index
from .sharding import global_rank

ship(__name__)

#: Keys of 60 bits, so that a tight cluster is spread over many cells.
CURVES, DIMS, BITS = 6, 6, 10
#: Calibration: so many queries at most, and the recall that they must reach.
PROBES, RECALL = 64, 0.95
SEED = 20
#: Places in a block, and queries that are scored with a block at a time.
BLOCK, QUERIES = 1 << 15, 1 << 15


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part.

    Null vectors, vectors with a null, NaN or infinite component, zero and empty vectors, and rows
    with a null id do not.
    """
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))  # as wide as they come
    return out.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole & F.exists("v", lambda x: x != 0))


def _curves(d: int, spread: np.ndarray, mean: np.ndarray):
    """For each curve: a projection matrix, the range of a projected vector, and a shift."""
    rng = np.random.default_rng(SEED)
    for _ in range(CURVES):
        m = rng.standard_normal((d, DIMS)) / np.sqrt(d)
        s = np.sqrt(((m * spread[:, None]) ** 2).sum(axis=0)) * 2.5 + 1e-12
        yield m, mean @ m, s, rng.random(DIMS)


def keys(x: np.ndarray, curves: list) -> np.ndarray:
    """Hilbert keys (n x curves) of the rows of ``x``."""
    out = np.empty((len(x), len(curves)), np.int64)
    for c, (m, mid, span, shift) in enumerate(curves):
        u = ((x @ m - mid) / span + 1) / 4 + shift / 2  # half of the grid is room for the shift
        out[:, c] = hilbert_index((u * (1 << BITS)).clip(0, (1 << BITS) - 1).astype(np.int64), BITS)
    return out


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score downwards, then by id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _dots(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with ``q``; each row is summed alone, in one order."""
    return np.einsum("ij,j->i", a, q, optimize=False)


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by largest inner product.

    Queries are the rows whose id is divisible by ``every``; a query is no candidate of its own, and
    ties go to the smaller id. Equal vectors are searched as one that carries its k + 1 smallest ids,
    which are all that any answer can hold, so a vector shared by a third of all rows is one point on
    each curve, and one search answers all the queries that share it. Rows that take no part (see
    ``usable``) are no queries either; nor are vectors of another length than the commonest one (of
    lengths equally common the greatest counts). Of rows with one id the least vector counts. With
    fewer than k candidates all are returned; an empty table has an empty result; other columns are
    not read.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    points, rows, d, n = _points(vectors, every, k, id_col, vec_col)
    if not n:
        return spark.createDataFrame([], schema)
    curves = _fitted_curves(points, d)
    placed = _placed(points, curves)
    window = _calibrate(points, placed, n, k)
    return _answers(rows, _windows(points, placed, window, n, k), every, k)


def _points(vectors: DataFrame, every: int, k: int, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(pid, ids, v, asks) of the distinct vectors, (vec_id, v) of the rows, the vectors' length, and the points' number."""
    rows = usable(vectors, id_col, vec_col)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not common:
        return rows, rows, 0, 0
    d = common[0]["d"]
    rows = rows.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = durable(rows.withColumn("h", F.xxhash64("v")))  # a vector's name; equal names are told apart by the vectors
    # the k + 1 least ids of each vector: those of a task first, so that copies are few rows when they move
    order = Window.partitionBy("h", "v").orderBy("vec_id")
    held = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    asking = rows.where(F.col("vec_id") % every == 0).select("h", "v").distinct().withColumn("asks", F.lit(True))
    points = held.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).join(asking, ["h", "v"], "left")
    points = durable(points.select(F.element_at("ids", 1).alias("pid"), "ids", "v", F.coalesce("asks", F.lit(False)).alias("asks")))
    return points, rows, d, points.count()


def _fitted_curves(points: DataFrame, d: int) -> list:
    """Curves that spread the points: projections are scaled by each component's mean and deviation."""
    stats = points.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()  # d rows
    mean, spread = np.zeros(d), np.zeros(d)
    for r in stats:
        mean[r["i"]], spread[r["i"]] = r["m"], r["s"]
    return list(_curves(d, spread, mean))


def _placed(points: DataFrame, curves: list) -> DataFrame:
    """(pid, r0, r1, ...): each point's place, from 0, in the order of (key, pid) along each curve."""
    of_point = F.pandas_udf(lambda v: pd.Series(list(keys(np.stack(v.to_numpy()).astype(float), curves))), "array<long>")
    keyed = points.select("pid", F.posexplode(of_point("v")).alias("c", "key"))
    ranked, total = global_rank(keyed, "c", "key", "pid")
    n = total // len(curves)  # each curve holds all points
    at = [F.max(F.when(F.col("c") == c, F.col("rank") % n)).alias(f"r{c}") for c in range(len(curves))]
    return durable(ranked.groupBy("pid").agg(*at))


def _calibrate(points: DataFrame, placed: DataFrame, n: int, k: int) -> int:
    """The number of places on either side at which RECALL of the probes' true neighbours lie, on one curve at least."""
    probes = points.where("asks").select("pid", "v").orderBy(F.xxhash64("pid"), "pid").limit(PROBES).collect()
    if not probes or n <= 4 * k:
        return n
    q = np.array([r["v"] for r in probes], float)
    own = [r["pid"] for r in probes]

    def best(batches):
        """Of one task, for each probe: its best points."""
        held_ids, held_s = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for pdf in batches:
            s = np.concatenate([held_s, q @ np.stack(pdf["v"].to_numpy()).astype(float).T], axis=1)
            ids = np.concatenate([held_ids, np.broadcast_to(pdf["pid"].to_numpy(), (len(q), len(pdf)))], axis=1)
            near = np.stack([_top(ids[j], s[j], min(k + 1, s.shape[1])) for j in range(len(q))])
            held_ids, held_s = np.take_along_axis(ids, near, 1), np.take_along_axis(s, near, 1)
        m = held_ids.shape[1]
        yield pd.DataFrame({"j": np.repeat(np.arange(len(q)), m), "pid": held_ids.ravel(), "s": held_s.ravel()})

    order = Window.partitionBy("j").orderBy(F.desc("s"), "pid")
    near = points.select("pid", "v").mapInPandas(best, "j int, pid long, s double").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    near = near.select("j", "pid").collect()  # at most PROBES * (k + 1)
    wanted = sorted({r["pid"] for r in near} | set(own))
    asked = points.sparkSession.createDataFrame([(x,) for x in wanted], "pid long")
    at = {r[0]: np.array(r[1:], np.int64) for r in placed.join(F.broadcast(asked), "pid").collect()}
    gaps = sorted(int(np.abs(at[own[r["j"]]] - at[r["pid"]]).min()) for r in near if r["pid"] != own[r["j"]])
    return min(n, gaps[min(len(gaps) - 1, int(RECALL * len(gaps)))] * 11 // 10 + 2 * k) if gaps else n


def _windows(points: DataFrame, placed: DataFrame, window: int, n: int, k: int) -> DataFrame:
    """(qid, vec_id, score): for each asking point, the best of its ``window`` places on either side, on every curve.

    Each curve's order is cut into blocks of BLOCK places; a query goes to the blocks that its window
    touches, and is scored there with the window's points alone. A point that stands in windows of
    several curves is scored on the first of them, so that no pair is scored twice.
    """
    reach, last = min(window, n), (n - 1) // BLOCK
    # at most 2 * reach + BLOCK queries touch a block; they are dealt out in groups of QUERIES
    groups = -(-(2 * reach + BLOCK) // QUERIES)
    ranks = [f"r{c}" for c in range(CURVES)]
    all_ = durable(points.join(placed, "pid").withColumn("r", F.array(*ranks)).drop(*ranks))
    own = all_.select("pid", "ids", "v", "r", F.posexplode("r").alias("c", "at")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    own = own.select("pid", "ids", "v", "r", "c", F.floor(F.col("at") / BLOCK).cast("long").alias("b"), "g")
    asks = all_.where("asks").select(F.col("pid").alias("qid"), F.col("v").alias("qv"), F.col("r").alias("qr"), F.posexplode("r").alias("qc", "at"),
                                     F.pmod(F.xxhash64("pid"), F.lit(groups)).cast("int").alias("qg"))
    first, until = F.floor(F.greatest(F.col("at") - reach, F.lit(0)) / BLOCK), F.least(F.floor((F.col("at") + reach) / BLOCK), F.lit(last))
    asks = asks.select("qid", "qv", "qr", "qc", "qg", F.explode(F.sequence(first.cast("long"), until.cast("long"))).alias("qb"))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": [], "vec_id": [], "score": []})
        if not len(left) or not len(right):
            return none
        c = int(left["c"].iat[0])
        left = left.iloc[np.argsort(np.array([r[c] for r in left["r"]]))]
        x, places = np.stack(left["v"].to_numpy()).astype(float), np.stack(left["r"].to_numpy())
        heads, members = left["pid"].to_numpy(), left["ids"].to_numpy()
        found = []
        for qid, qv, qr in zip(right["qid"].to_numpy(), right["qv"], right["qr"]):
            lo, hi = np.searchsorted(places[:, c], (qr[c] - reach, qr[c] + reach + 1))
            at = np.arange(lo, hi)
            for e in range(c):  # what an earlier curve's window holds was scored there
                at = at[np.abs(places[at, e] - qr[e]) > reach]
            if not len(at):
                continue
            s = _dots(x[at], np.asarray(qv, float))
            near = _top(heads[at], s, k + 1)
            ids = np.concatenate([np.asarray(members[at[j]], np.int64) for j in near])
            scores = np.repeat(s[near], [len(members[at[j]]) for j in near])
            best = _top(ids, scores, k + 1)
            found.append(pd.DataFrame({"qid": qid, "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(found) if found else none

    pair = ["c", "b", "g"], ["qc", "qb", "qg"]
    return own.groupBy(*pair[0]).cogroup(asks.groupBy(*pair[1])).applyInPandas(answer, "qid long, vec_id long, score double")


def _answers(rows: DataFrame, found: DataFrame, every: int, k: int) -> DataFrame:
    """The k best of each query's own, from the k + 1 best of its vector: a query is no candidate of its own."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    least = rows.groupBy("h", "v").agg(F.min("vec_id").alias("qid"))
    asked = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    alone = asked.join(least, ["h", "v"]).select("query_id", "qid")
    out = alone.join(found, "qid").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("n")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
