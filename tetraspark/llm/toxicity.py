"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all other training texts count as unlabelled. A linear
logistic model is trained in numpy on the class-prior-corrected risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

whose second term estimates the risk on clean texts; where it would fall below zero the step goes
against it instead, which keeps a flexible model from fitting the unlabelled texts as negatives.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean, ship

ship(__name__)

#: At most so many texts of either kind are used for fitting, taken by the hash of their ids. This is the bounded sample
#: that the classifier is fitted on; README has what other bounds give.
POSITIVES, UNLABELLED = 3000, 9000
#: The highest score of texts where nothing could be learned.
NEUTRAL = 0.49
#: Features are hashed to so many values; the model keeps those that set positives apart.
SPACE, FEATURES, LEAST = 1 << 22, 1024, 10
FOLDS = 5

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)
DENSE = 0.01
#: How many times as often a feature must occur in positives; features of any topic are near 1.
LIFT = 4


def marks(text: str | None) -> set[str]:
    """A whole text's distinct words, and the word beginnings that recur in it.

    A beginning that occurs once may be chance; one that occurs twice, and one that makes up the
    share DENSE of the words as well, are marks of their own, so long texts aren't judged by length.
    """
    words = Counter(WORD.findall((text or "").lower()))
    total = sum(words.values())
    out = set(words)
    for n in STEMS:
        stems: Counter = Counter()
        for w, k in words.items():
            if len(w) > n:
                stems[w[:n]] += k
        for stem, k in stems.items():
            if k >= 2:
                out.add(stem + "*")
                if k >= DENSE * total:
                    out.add(stem + "**")
    return out


def features(text: str | None) -> np.ndarray:
    """Hashed marks of a whole text."""
    both = marks(text)
    digest = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((digest(w.encode("utf-8", "surrogatepass")) % SPACE for w in both), np.int64, len(both)))


def _fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list, list, float]:
    """Feature arrays of positives and of unlabelled texts, and the share of positives among labelled rows.

    Only rows outside the held-out fold are read. Both samples are bounded by POSITIVES and
    UNLABELLED; the order of the ids' hashes decides, whatever the size of the tables.
    """

    @lean
    def of(batches):
        for b in batches:
            f = [features(t).astype(np.int32).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], ["doc_id", "y", "f"])

    seen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (_fold("doc_id") != 0))
    seen = seen.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, toxic = seen.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(0.9, max(0.01, (toxic or 0) / n)) if n else 0.1
    own = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (_fold("doc_id") != 0))
    own = own.withColumn("o", F.xxhash64("doc_id"))
    confirmed = seen.where("toxic = 1").select("doc_id")
    # ids first, so that no text is sorted or sent that is not used
    few = own.select("doc_id", "o")
    p = few.join(confirmed, "doc_id", "left_semi").distinct().orderBy("o", "doc_id").limit(POSITIVES)
    u = few.join(confirmed, "doc_id", "left_anti").distinct().orderBy("o", "doc_id").limit(UNLABELLED)
    chosen = p.select("doc_id", F.lit(1).alias("y")).unionByName(u.select("doc_id", F.lit(0).alias("y")))
    # of an id's several texts the one of the least hash; at most POSITIVES + UNLABELLED ids are broadcast
    got = own.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # packed, as a list of Python numbers takes some ten times the memory on the driver
    rows = got.select("doc_id", "y", "text").mapInArrow(of, f"doc_id {kind}, y int, f binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    pos, unl = ([np.frombuffer(r["f"], np.int32) for r in rows if r["y"] == y] for y in (1, 0))
    return pos, unl, prior


def without_copies(rows: list) -> list:
    """``rows`` with near copies thinned out, so that the words of one much-copied text aren't taken for signs.

    A row goes where three minimum hashes of its features equal those of an earlier row, in one of
    eight bands.
    """
    odd = np.random.default_rng(4).integers(1, 1 << 62, 24, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    seen: list[set] = [set() for _ in range(8)]
    out = []
    for f in rows:
        x = np.asarray(f, np.uint64)
        if not len(x):
            continue
        least = ((x[:, None] * odd[None, :]) >> np.uint64(24)).min(axis=0).tolist()
        bands = [tuple(least[3 * i : 3 * i + 3]) for i in range(8)]
        if not any(b in s for b, s in zip(bands, seen)):
            out.append(f)
        for b, s in zip(bands, seen):
            s.add(b)
    return out


def choose_features(pos: list, unl: list) -> np.ndarray:
    """Features in at least LEAST positives, those first that are most in excess there."""
    if not pos or not unl:
        return np.zeros(0, np.int64)
    ids, n_p = np.unique(np.concatenate([np.asarray(x, np.int64) for x in pos]), return_counts=True)
    ids, n_p = ids[n_p >= LEAST], n_p[n_p >= LEAST]
    u_ids, u_n = np.unique(np.concatenate([np.asarray(x, np.int64) for x in unl]), return_counts=True)
    if not len(ids):
        return ids
    at = np.searchsorted(u_ids, ids).clip(0, max(0, len(u_ids) - 1))
    n_u = np.where(len(u_ids) and u_ids[at] == ids, u_n[at], 0)
    rate_p, rate_u = (n_p + 0.5) / (len(pos) + 1), (n_u + 0.5) / (len(unl) + 1)
    worth = rate_p * np.log(rate_p / rate_u)
    order = np.lexsort((ids, -worth))
    order = order[(rate_p >= LIFT * rate_u)[order]][:FEATURES]
    return np.sort(ids[order])


def dense(rows: list, chosen: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(chosen)), np.float32)
    for x, f in zip(out, rows):
        f = np.asarray(f, np.int64)
        at = np.searchsorted(chosen, f).clip(0, max(0, len(chosen) - 1))
        x[at[chosen[at] == f] if len(chosen) else []] = 1
    return out


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam."""
    d = pos.shape[1]
    w = np.zeros(d + 1)
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    if not len(pos) or not len(unl):
        return w[:d], float(w[d])
    for t in range(1, steps + 1):
        fp, fu = pos @ w[:d].astype(np.float32) + w[d], unl @ w[:d].astype(np.float32) + w[d]
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        # derivatives by f: of l(f) it is s - 1, of l(-f) it is s
        clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = prior * (sp - 1) / len(pos), np.zeros_like(su)
        if clean >= 0:
            gp, gu = gp - prior * sp / len(pos), su / len(unl)
        else:
            gp, gu = prior * sp / len(pos), -su / len(unl)
        g = np.concatenate((gp.astype(np.float32) @ pos + gu.astype(np.float32) @ unl + decay * w[:d], [gp.sum() + gu.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:d], float(w[d])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(chosen features, weights, bias), from the rows outside the held-out fold.

    Rows with a null doc_id or a null label teach nothing, an id with several labels is toxic if one
    of them says so, and other columns than doc_id, text and toxic are not read. Without positives,
    unlabelled texts or any feature that sets them apart, as in empty tables, nothing is known of any
    text: all get one score, below 0.5.
    """
    pos, unl, prior = training_sample(docs, labels)
    pos, unl = without_copies(pos), without_copies(unl)
    chosen = choose_features(pos, unl)
    if not len(chosen):
        return chosen, np.zeros(0), float(np.log(min(prior, NEUTRAL) / (1 - min(prior, NEUTRAL))))
    w, b = fit(dense(pos, chosen), dense(unl, chosen), prior)
    del pos, unl
    give_back()
    return chosen, w, b


def scorer(model: tuple[np.ndarray, np.ndarray, float]):
    """A function of whole texts: their scores, 0 to 1."""
    weights = {int(k): float(v) for k, v in zip(model[0], model[1])}
    bias = model[2]
    known: dict[str, float] = {}

    def weight(w: str) -> float:
        got = known.get(w)
        if got is None:
            if len(known) > 200_000:
                known.clear()
            got = known[w] = weights.get(xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % SPACE, 0.0)
        return got

    def of(texts: list) -> np.ndarray:
        out = np.array([bias + sum(sorted(filter(None, map(weight, marks(t))))) for t in texts], float)
        return 1 / (1 + np.exp(-out.clip(-60, 60)))

    return of


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, over whole texts.

    Null and empty texts have no feature and get the bias's score; a null doc_id is not held out;
    rows that repeat are scored each; an empty table gives an empty result. Labels, language, source
    and all columns but doc_id and text have no part in a score.
    """
    held = F.coalesce(_fold("doc_id") == 0, F.lit(False))
    of = scorer(model)

    @lean
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose texts are predicted toxic; all columns and repeats are kept.

    Null and empty texts get the bias's score like any other text without features; null ids are
    judged by their text. If nothing could be learned (see ``train``) all rows stay.
    """
    of, at = scorer(train(docs, labels)), docs.columns.index("text")

    @lean
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(of(b.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
