"""Removal of repeated byte strings with a distributed difference-cover suffix array.

Two suffixes can only share a prefix of LENGTH bytes if the smallest hash among that prefix's
K-grams is the same, so suffixes are dealt out by it: each task then holds every suffix of the whole
corpus that could share such a prefix with another one of its own, and sorts them with the
difference cover {1, 2} modulo 3. Triples at sampled positions are sorted and named, the names are
tripled again until they tell LENGTH bytes apart, the remaining suffixes are merged between the
sampled ones, and the prefixes of neighbours are compared byte for byte.

What needs no sorting is settled first, without loss: suffixes whose smallest K-gram occurs once in
the corpus repeat nothing, and runs of suffixes (same smallest K-gram, same bytes to the end of the
last prefix) that occur more than once repeat whole; one of them stands for all in the sort.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, give_back, keep, lean, ship

ship(__name__)

LENGTH, K = 200, 32
#: Bytes of context that a sorting task gets on average.
TASK_BYTES = 1_500_000
#: Classes up to which they are broadcast once their number is known; beyond, the join shuffles.
SMALL = 500_000

BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses


class Hasher:
    """Hashes of all K-grams of a byte string, from running sums of powers; they only deal out suffixes."""

    def __init__(self):
        self.size = 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = 1 << (n - 1).bit_length()
        inverse = pow(BASE, -1, 1 << 64)
        up, down = np.full(self.size, BASE, np.uint64), np.full(self.size, inverse, np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """A hash for each K bytes."""
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.up[:n] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        return mix((sums[K:] - sums[:-K]) * self.down[: n - K + 1])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(data: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(v, c, start, count, twice) of the runs of suffixes that share their smallest K-gram hash v.

    c is the XXH3 of the run's bytes, up to the end of its last prefix; ``twice`` tells that v occurs more
    than once in them, so that suffixes of one run may repeat each other.
    """
    n = len(data)
    hasher.grow(n + 1)
    h = hasher.grams(data)
    width = LENGTH - K + 1
    least, span = h, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := width - span:
        least = np.minimum(least[:-rest], least[rest:])
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    start = np.concatenate((np.zeros(1, np.int64), cut))
    end = np.concatenate((cut, [len(least)]))  # of the suffixes' starts
    v = least[start]
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    c = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), (end + (LENGTH - 1)).tolist())), np.uint64, len(start))
    twice = np.fromiter((np.count_nonzero(h[s : e + width - 1] == x) > 1 for s, e, x in zip(start.tolist(), end.tolist(), v)), bool, len(v))
    return v, c, start, end - start, twice


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _run_rows(docs: DataFrame, combine: bool) -> DataFrame:
    """The runs of all texts; with ``combine``, equal runs of a batch are one row with their number."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            parts = []
            for rid, text in zip(pdf["rid"], pdf["text"]):
                data = np.frombuffer(_bytes(text), np.uint8)
                if len(data) >= LENGTH:
                    v, c, s, k, t = runs(data, hasher)
                    parts.append((v, c, np.full(len(v), rid, np.int64), s, k, t))
            if not parts:
                continue
            v, c, r, s, k, t = (np.concatenate(x) for x in zip(*parts))
            n = np.ones(len(v), np.int64)
            if combine:
                order = np.lexsort((c, v))
                first = np.ones(len(v), bool)
                first[1:] = (v[order][1:] != v[order][:-1]) | (c[order][1:] != c[order][:-1])
                at = np.flatnonzero(first)
                n = np.diff(np.append(at, len(v)))
                v, c, r, s, k, t = (x[order][at] for x in (v, c, r, s, k, t))
            out = pd.DataFrame({"v": v.view(np.int64), "c": c.view(np.int64), "rid": r, "s": s.astype(np.int32), "k": k.astype(np.int32)})
            if combine:
                out["n"], out["twice"] = n, t
            yield out

    return docs.select("rid", "text").mapInPandas(run, "v long, c long, rid long, s int, k int" + (", n long, twice boolean" if combine else ""))


def _dense(x: np.ndarray) -> np.ndarray:
    """Dense ranks of ``x`` from 0."""
    order = np.argsort(x)
    ranked = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
    return out


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Names, in order, of triples of names."""
    top = max(int(a.max(initial=0)), int(b.max(initial=0)), int(c.max(initial=0)))
    if top < 1 << 21:
        return _dense((a.astype(np.uint64) << np.uint64(42)) | (b.astype(np.uint64) << np.uint64(21)) | c.astype(np.uint64))
    order = np.lexsort((c, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (c[order][1:] != c[order][:-1])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, words): all positions of ``data`` sorted by their first 216 bytes at least, and 8-byte words.

    Words at a position, at 8 and at 16 bytes after it are the first triple. Its name covers 24
    bytes; three names 24 apart cover 72, and three of those 216. All steps are multiples of three,
    so names are only ever asked for at sampled positions.
    """
    n = len(data)
    pad = np.concatenate((data, np.zeros(240, np.uint8))).astype(np.uint64)
    word = np.zeros(n + 232, np.uint64)
    for i in range(8):
        word |= pad[i : i + len(word)] << np.uint64(56 - 8 * i)
    total = n + 3
    position = np.arange(total)
    sample = position[position % 3 != 0]
    name = np.zeros(n + 240, np.int64)
    first = _dense(word)
    name[sample] = _names(first[sample], first[sample + 8], first[sample + 16])
    for step in (24, 72):
        at = [np.minimum(sample + k * step, n + 236 + (sample + k * step) % 3) for k in range(3)]
        name[sample] = _names(*(name[x] for x in at))
    # merge: a remaining suffix is a byte and a sampled suffix, or two bytes and a sampled suffix
    rest = position[position % 3 == 0]
    rest = rest[rest < n]
    sample = sample[sample < n]
    sample = sample[np.argsort(name[sample], kind="stable")]
    byte = pad.astype(np.int64)
    one = lambda x: (byte[x] << 32) | name[x + 1]
    two = lambda x: (byte[x] << 40) | (byte[x + 1] << 32) | name[x + 2]
    rest = rest[np.argsort(one(rest), kind="stable")]
    before = np.searchsorted(np.sort(one(sample[sample % 3 == 1])), one(rest)) + np.searchsorted(np.sort(two(sample[sample % 3 == 2])), two(rest))
    order = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    at = np.arange(len(rest)) + np.maximum.accumulate(before) if len(rest) else before
    order[at], taken[at] = rest, True
    order[~taken] = sample
    return order, word


def repeated_starts(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Which of the positions marked ``valid`` share their first LENGTH bytes with another such position."""
    order, word = suffix_order(data)
    order = order[valid[order]]
    a, b = order[:-1], order[1:]
    for k in range(0, LENGTH, 8):
        same = word[a + k] == word[b + k]
        a, b = a[same], b[same]
    out = np.zeros(len(data), bool)
    out[a] = out[b] = True
    return out


def _sorted_out(contexts: DataFrame, tasks: int) -> DataFrame:
    """(rid, a, b): stretches of repeated bytes, found by sorting the suffixes of each task's contexts."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [pdf for pdf in batches if len(pdf)]
        if not got:
            return
        rows = pd.concat(got, ignore_index=True)
        parts = [np.frombuffer(x, np.uint8) for x in rows["data"]]
        size = np.array([len(x) for x in parts])
        first = np.cumsum(size) - size
        k = rows["k"].to_numpy()
        data = np.concatenate(parts)
        valid = np.zeros(len(data), bool)
        for f, x in zip(first.tolist(), k.tolist()):
            valid[f : f + x] = True
        hit = repeated_starts(data, valid)
        # flagged starts to stretches, in the document's own positions
        owner = np.repeat(np.arange(len(k)), size)
        at = np.flatnonzero(hit)
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(owner[at]) > 0)
        lo = at[new]
        hi = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        own = owner[lo]
        shift = rows["s"].to_numpy()[own] - first[own]
        yield pd.DataFrame({"rid": rows["rid"].to_numpy()[own], "a": (lo + shift).astype(np.int32), "b": (hi + shift + LENGTH).astype(np.int32)})

    return contexts.repartition(tasks, "v").mapInPandas(run, "rid long, a int, b int")


def stretches(docs: DataFrame) -> DataFrame:
    """(rid, x array<struct<a, b>>): bytes a to b of text ``rid`` that repeat; they may overlap."""
    own = _run_rows(docs, combine=True).repartition("v")
    classes = own.groupBy("v", "c").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "s", "k")).alias("x"), F.max("twice").alias("twice"))
    every = Window.partitionBy("v")
    classes = classes.withColumn("total", F.sum("n").over(every)).withColumn("kinds", F.count("*").over(every))
    classes = classes.where((F.col("total") > 1) | F.col("twice")).select("v", "c", "n", "x.*", "twice", "kinds")
    classes = keep(classes, f"suffix-{uuid.uuid4().hex}")  # compressed, which checkpoints are not
    whole = classes.where("n > 1").select("v", "c")
    n_whole = whole.count()
    again = _run_rows(docs, combine=False).join(F.broadcast(whole) if n_whole <= SMALL else whole, ["v", "c"], "left_semi")
    found = again.select("rid", F.col("s").alias("a"), (F.col("s") + F.col("k") + (LENGTH - 1)).alias("b"))
    open_ = classes.where("kinds > 1 or twice")
    size = open_.agg(F.sum(F.col("k") + (LENGTH - 1))).first()[0]
    if size:
        asked = open_.groupBy("rid").agg(F.collect_list(F.struct("v", "s", "k")).alias("q"))

        @F.pandas_udf("array<struct<v:long,s:int,k:int,data:binary>>")
        def cut(texts: pd.Series, asks: pd.Series) -> pd.Series:
            out = []
            for text, q in zip(texts, asks):
                data = _bytes(text)
                out.append([(x["v"], x["s"], x["k"], data[x["s"] : x["s"] + x["k"] + LENGTH - 1]) for x in q])
            give_back()
            return pd.Series(out)

        texts = docs.select("rid", "text").join(asked, "rid")
        contexts = texts.dropDuplicates(["rid"]).select("rid", F.inline(cut("text", "q")))
        found = found.unionByName(_sorted_out(contexts, max(1, -(-int(size) // TASK_BYTES))))
    return found.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("x"))


def covered(n: int, x) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the stretches ``x``, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in x) if x is not None else ():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, min(b, n)))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return b"".join(parts)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``rid``, by which equal rows (doc_id, text) stand for each other; they have equal results.

    Names that different rows share are found by a second hash and, rare as they are, named anew by both.
    """
    second = F.xxhash64(F.lit(1), F.col("text"), F.col("doc_id"))
    named = docs.withColumn("rid", F.xxhash64(F.col("doc_id"), F.col("text")))
    twice = named.select("rid", second.alias("h")).groupBy("rid").agg(F.min("h").alias("x"), F.max("h").alias("y"))
    twice = durable(twice.where("x <> y").select(F.col("rid").alias("__twice")))
    if not twice.count():
        return named
    named = named.join(twice, F.col("rid") == F.col("__twice"), "left")
    return named.withColumn("rid", F.when(F.col("__twice").isNotNull(), F.xxhash64(F.col("rid"), second)).otherwise(F.col("rid"))).drop("__twice")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Every byte goes that a string of LENGTH bytes covers which starts somewhere else as well, in the
    same text or another; strings are judged on the texts as given. Null texts are empty, texts
    shorter than LENGTH keep everything, repeated rows are texts of their own and so repeat each
    other; null ids are rows like any other; other columns are ignored.
    """
    keyed = _keyed(docs.select("doc_id", "text"))

    @F.pandas_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>")
    def digest(texts: pd.Series, x: pd.Series) -> pd.DataFrame:
        out = []
        for text, s in zip(texts, x):
            data = _bytes(text)
            spans = covered(len(data), s)
            out.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest()))
        give_back()
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = keyed.join(stretches(keyed), "rid", "left")
    return out.select("doc_id", digest("text", "x").alias("d")).select("doc_id", "d.*")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text`` and ``n_chars`` counted anew, where it exists.

    A cut never splits a character: one that is only partly covered stays. Rows are all kept, with
    their other columns, whatever these are called; a null text stays null, a null id is one like any
    other, repeated rows are cut alike, and an empty table stays empty.
    """
    names = docs.columns
    keyed = _keyed(docs.select(F.struct(*names).alias("r"), "doc_id", "text"))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for text, s in zip(texts, x):
            if text is None or s is None:
                out.append(text)
                continue
            data = _bytes(text)
            inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
            spans = []
            for a, b in covered(len(data), s):
                while inside(a):
                    a += 1
                while inside(b) and b > a:
                    b -= 1
                spans.append((a, b))
            out.append(kept_bytes(data, spans).decode("utf-8", "surrogatepass"))
        give_back()
        return pd.Series(out)

    joined = keyed.join(stretches(keyed.select("rid", "text")), "rid", "left").withColumn("text", rest("text", "x"))
    joined = joined.select(*[F.col("text") if c == "text" else F.col("r").getField(c).alias(c) for c in names])
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(kind))
    return joined.select(*names)
