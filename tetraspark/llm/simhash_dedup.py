"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``2 r`` bits exactly when some 64-bit value lies within ``r``
bits of both. Every distinct fingerprint therefore emits all values within half the radius, equal
values meet, and fingerprints that meet are linked. All 2,081 values of a fingerprint (r = 2) are
never shuffled one by one: they are dealt out by their leading bits, so a fingerprint travels once
to each of the few buckets that its values fall in, and the bucket's task expands, sorts and
deduplicates the values there. Equal values give a chain of links, not all pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, give_back, ship

ship(__name__)

#: Values that a bucket's task expands at a time; larger buckets are split by further bits first.
EXPANDED = 1 << 21
#: Values that one task expands in all; fingerprints in a bucket beyond which STEP more bits deal it out anew; hot
#: buckets (one number each, a MB in all) up to which their list is broadcast.
TASK, DEALT, STEP, HOT = 1 << 26, 1 << 14, 6, 1 << 17
#: ``keep_one``: words of a shingle, and least Jaccard similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Its blocks of a wide SimHash: bits within which ball hashing looks, and how many of them may differ; sets that meet in
#: one task; members of a run of equal values up to which all pairs are checked; bits that check a pair, and how many of
#: them may differ.
BLOCK, WITHIN, MEET, RUN, CHECK, FAR = 21, 2, 1 << 18, 64, 128, 42
#: Chance that a bit differs at the least similarity (3/16 for sets of 4 and 5 shingles, at most 0.162 for others), and the
#: share of such pairs that may meet in no block.
DIFFER, MISSED = 3 / 16, 1e-4
#: Members of a family that a task compares with as many others.
CHUNK = 1024


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority vote over the XXH64 (seed 42) of all word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) for every row; null and blank texts get 0. Other columns are not read."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        got = np.array([text_fingerprint(t, shingle) for t in texts], np.uint64)
        return pd.Series(got.view(np.int64))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the links a-b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if not (off := ra != rb).any():
            return root
        a, b, ra, rb = a[off], b[off], ra[off], rb[off]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != (up := root[root])).any():
            root = up


def _signed(x: int) -> int:
    """The same 64 bits as a signed number."""
    return x - (1 << 64) if x >> 63 else x


def _meet(fp: np.ndarray, left: np.ndarray, low: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) between values that meet when up to ``left[i]`` of the ``low`` lowest bits flip.

    ``fp`` holds what stands in this bucket: the fingerprint with the leading bits it was dealt by.
    """
    single = np.uint64(1) << np.arange(low, dtype=np.uint64)
    masks = [np.bitwise_or.reduce(single[_choose(low, c)], axis=1) for c in range(radius + 1)]
    values, owners = [], []
    for c in range(radius + 1):
        own = np.flatnonzero(left >= c)
        values.append((fp[own, None] ^ masks[c][None, :]).ravel())
        owners.append(np.repeat(own, len(masks[c])))
    v, o = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(v)
    v, o = v[order], o[order]
    same = v[1:] == v[:-1]
    return o[:-1][same], o[1:][same]


def _choose(n: int, c: int) -> np.ndarray:
    """All choices of c out of n, one a row."""
    chosen = list(itertools.combinations(range(n), c))
    return np.array(chosen, np.int64).reshape(len(chosen), c)


def _bucket_links(fp: np.ndarray, at: np.ndarray, low: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket: ``at`` is the fingerprint moved into the bucket; bits above ``low`` agree."""
    used = np.bitwise_count(fp ^ at).astype(np.int64)
    left = radius - used
    sizes = np.array([sum(math.comb(low, c) for c in range(k + 1)) for k in range(radius + 1)])
    n = len(fp)
    if low > 4 and sizes[left].sum() > EXPANDED and n > 1:
        step = 3
        found = []
        shift = np.uint64(low - step)
        for head in range(1 << step):
            moved = (at & ~(np.uint64((1 << step) - 1) << shift)) | (np.uint64(head) << shift)
            ok = np.flatnonzero(np.bitwise_count(fp ^ moved) <= radius)
            if len(ok) > 1:
                a, b = _bucket_links(fp[ok], moved[ok], low - step, radius)
                found.append((ok[a], ok[b]))
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    else:
        a, b = _meet(at, left, low, radius)
        close = np.bitwise_count(fp[a] ^ fp[b]) <= 2 * radius  # the exact check of every colliding pair
        a, b = a[close], b[close]
    # a forest's links join what a chain of checked pairs joins, and may be farther apart than these
    root = _roots(n, a, b)
    other = np.flatnonzero(root != np.arange(n))
    return other, root[other]


def links(distinct: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` at ``radius`` (even) or fewer bits.

    ``n``: their number, from which the number of leading bits follows. Each bucket returns a
    spanning forest of its links, at most one row for each fingerprint dealt to it. Buckets of over
    DEALT fingerprints and four times the mean, as large groups of near copies make them, are dealt out anew by STEP more
    bits, until they are small or no bits are left; so no task gets a whole hot bucket.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius is twice what each side may vary, and so even")
    spark, half = distinct.sparkSession, radius // 2
    whole = sum(math.comb(64, c) for c in range(half + 1))
    bits = min(32, max(4, math.ceil(math.log2(max(1, n * whole / EXPANDED)))))

    def nearby(width: int) -> list[int]:
        """Masks of ``width`` bits that flip at most half the radius."""
        return [sum(1 << i for i in ix) for c in range(half + 1) for ix in _choose(width, c).tolist()]

    def deal(df: DataFrame, before: int, width: int) -> DataFrame:
        """Of (fp, at), ``at`` with the ``width`` bits that follow the first ``before`` varied, within half the radius in all."""
        low = 64 - before - width
        moved = df.select("fp", F.explode(F.array(*[F.col("at").bitwiseXOR(F.lit(_signed(m << low))) for m in nearby(width)])).alias("at"))
        return moved.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("at"))) <= half).withColumn("head", F.shiftrightunsigned("at", low))

    def run(low: int):
        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            # leading bits are the bucket's, the rest the fingerprint's own
            at = (fp & np.uint64((1 << low) - 1)) | (pdf["at"].to_numpy().view(np.uint64) >> np.uint64(low) << np.uint64(low))
            a, b = _bucket_links(fp, at, low, half)
            return pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

        return of

    found, before, width = None, 0, bits
    rows, most = distinct.select("fp", F.col("fp").alias("at")), n
    limit = max(DEALT, 4 * n * len(nearby(bits)) >> bits)  # a hot bucket is one far beyond the mean
    while True:
        dealt = deal(rows, before, width)
        before, low = before + width, 64 - before - width
        small, hot = dealt, None
        if low > 2 * STEP and most > limit:
            # at most so many heads can be hot: every row is dealt to len(nearby) of them
            sizes = dealt.groupBy("head").count().where(F.col("count") > limit)
            hot = durable(sizes.select(F.col("head").alias("__hot")))
            n_hot = hot.count()
            if n_hot:
                hot_heads = F.broadcast(hot) if n_hot <= HOT else hot
                small = dealt.join(hot_heads, dealt["head"] == hot["__hot"], "left_anti")
                rows = durable(dealt.join(hot_heads, dealt["head"] == hot["__hot"], "left_semi").select("fp", "at"))
            else:
                hot = None
        # by work, as these are few bytes and many values
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << bits, -(-n * whole // TASK)))
        part = small.repartition(tasks, "head").groupBy("head").applyInPandas(run(low), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if hot is None:
            return found
        most, width = rows.count(), STEP


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Exact copies share a fingerprint and are collapsed before any link is looked for. Null texts
    count as empty, empty and blank texts have fingerprint zero and link like any other; a null id
    keeps its row and names no component; repeated ids keep every row. An empty table gives an
    empty result. Columns of ``docs`` other than the two named are ignored.
    """
    fps = durable(fingerprints(docs, id_col, text_col, shingle))
    lowest = durable(fps.groupBy("fp").agg(F.min("id").alias("d")))
    edges = links(lowest.select("fp"), lowest.count(), radius)
    cc = components(edges)
    rooted = lowest.join(cc.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "d", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("d").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of all runs of ``width`` words; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.array([digest(b" ".join(words[i : i + width]), 42) for i in range(n)], np.uint64))


def _key(shingles: np.ndarray) -> int:
    """64-bit name of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def wide_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``words`` times 64 bits: majority vote over as many hashes of every shingle, made from its own."""
    votes = np.zeros(64 * words, np.int64)
    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(shingles), 255):  # so many votes fit a byte
        z = shingles[at : at + 255, None] + salt
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        bits = np.unpackbits(z.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(shingles), bitorder="little").view("<u8")


def layout(n: int) -> tuple[int, int, int]:
    """(prefix, blocks, words) for ``n`` sets: bits that deal a block's sets out to tasks, blocks, 64-bit words of a fingerprint.

    A pair meets in a block when the prefix agrees and at most WITHIN of the BLOCK bits that follow
    differ. There are as many blocks as make pairs of the least similarity miss all of them with
    chance MISSED.
    """
    prefix = max(0, math.ceil(math.log2(max(1, n) / MEET)))
    ball = sum(math.comb(BLOCK, c) * DIFFER**c * (1 - DIFFER) ** (BLOCK - c) for c in range(WITHIN + 1))
    blocks = math.ceil(math.log(MISSED) / math.log1p(-ball * (1 - DIFFER) ** prefix))
    return prefix, blocks, -(-(CHECK + blocks * (prefix + BLOCK)) // 64)


def _wide(docs: DataFrame, words: int) -> DataFrame:
    """(id, tk, key, n, fp) for every row: hash of the text, name, size and wide SimHash of its shingle set."""

    @F.pandas_udf("struct<key long, n int, fp binary>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:  # one set at a time
            s = shingle_set(t)
            rows.append((_key(s), len(s), wide_fingerprint(s, words).tobytes()))
        give_back()
        return pd.DataFrame(rows, columns=["key", "n", "fp"])

    got = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tk"), of("text").alias("x"))
    return got.select("id", "tk", "x.key", "x.n", "x.fp")


def _sized(n, m):
    """Whether sets of ``n`` and ``m`` shingles can be similar enough."""
    return np.minimum(n, m) >= np.maximum(n, m) * SIMILARITY - 1e-9


def _run_links(run: np.ndarray, near) -> tuple[list, list]:
    """Links that join all of a long run that pairs ``near`` each other join, and perhaps more, without trying all pairs.

    Leaders are compared with the whole run, and what none of them takes as well; the groups of two
    leaders are joined unseen, as members of theirs may be near.
    """
    a, b, heads, rest = [], [], [], run
    while len(rest) > RUN and len(a) < RUN:
        found = run[near(np.full(len(run), rest[0]), run)]
        a.append(np.full(len(found), rest[0]))
        b.append(found)
        heads += [rest[0]] * (len(found) > 1)
        rest = rest[~np.isin(rest, found)]
    if len(rest) > RUN:
        heads += rest.tolist()
    else:
        for i in rest:
            found = run[near(np.full(len(run), i), run)]
            a.append(np.full(len(found), i))
            b.append(found)
    a.append(np.array(heads[:-1], np.int64))
    b.append(np.array(heads[1:], np.int64))
    return a, b


def _block_links(block: np.ndarray, check: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, near): links between sets that meet in a block, by ball hashing.

    Every set emits all values within half of WITHIN bits, and equal values meet. ``check`` are two
    words, ``n`` sizes; ``near`` pairs pass both. All near pairs that meet are joined by the links, which
    are a forest and every set's near pair with the first other.
    """
    a, b = [], []

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(check[x] ^ check[y]).sum(axis=1) <= FAR) & _sized(n[x], n[y])

    # of much-repeated blocks the sets are joined, and more than RUN of each go on, whose runs are long so
    order = np.argsort(block, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(block[order], block[order])
    many = np.flatnonzero(place > RUN)
    a.append(order[many - 1])
    b.append(order[many])
    rows = np.sort(order[place <= RUN])
    masks = [sum(1 << i for i in ix) for c in range(WITHIN // 2 + 1) for ix in _choose(BLOCK, c).tolist()]
    parts = max(0, math.ceil(math.log2(max(1, len(rows) * len(masks)) / EXPANDED)))
    for head in range(1 << parts):
        values = []
        for m in masks:
            v = block[rows] ^ np.uint32(m)
            own = np.flatnonzero(v >> np.uint32(BLOCK - parts) == head) if parts else slice(None)
            values.append(v[own].astype(np.uint64) << np.uint64(32) | rows[own].astype(np.uint64))
        both = np.sort(np.concatenate(values))
        v, o = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        size = np.diff(np.append(starts, len(v)))
        for s, c in zip(starts[size > RUN], size[size > RUN]):
            x, y = _run_links(o[s : s + c], near)
            a += x
            b += y
        left = np.repeat(np.where(size > RUN, 0, starts + size), size) - np.arange(len(v)) - 1  # how many of a short run follow
        left = left.clip(0)
        at = np.flatnonzero(left)
        for step in range(1, RUN):
            at = at[left[at] >= step]
            if not len(at):
                break
            for i in range(0, len(at), 1 << 19):
                x, y = o[at[i : i + (1 << 19)]], o[at[i : i + (1 << 19)] + step]
                ok = near(x, y)
                a.append(x[ok])
                b.append(y[ok])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    root = _roots(len(block), a, b)
    other = np.flatnonzero(root != np.arange(len(block)))
    first = np.full(len(block), len(block))
    ok = near(a, b)
    np.minimum.at(first, b[ok], a[ok])
    least = np.flatnonzero(first < len(block))
    pairs = np.unique(np.concatenate([np.stack([root[other], other], 1), np.stack([first[least], least], 1)]), axis=0)
    return pairs[:, 0], pairs[:, 1], near(pairs[:, 0], pairs[:, 1])


def _met(one: DataFrame, prefix: int, blocks: int) -> DataFrame:
    """(a, b, near): links between the shingle sets of ``one`` (key, n, fp) that meet in a block of their wide SimHash.

    A set goes to one task for each block, in packed rows of a name, a size, a block and the checking bits.
    """

    def deal(batches):
        width = prefix + BLOCK
        powers = (np.uint32(1) << np.arange(BLOCK, dtype=np.uint32)), (np.int64(1) << np.arange(prefix, dtype=np.int64))
        for pdf in batches:
            if not len(pdf):
                continue
            fp = np.frombuffer(b"".join(pdf["fp"]), np.uint8).reshape(len(pdf), -1)
            key, n, check = pdf["key"].to_numpy(np.int64), pdf["n"].to_numpy(np.int32), fp[:, : CHECK // 8]
            bits = np.unpackbits(fp[:, CHECK // 8 :], axis=1, bitorder="little")
            rows = []
            for t in range(blocks):
                own = bits[:, t * width : (t + 1) * width]
                low, head = own[:, :BLOCK] @ powers[0], own[:, BLOCK:] @ powers[1]
                for h in np.unique(head):
                    ix = np.flatnonzero(head == h)
                    rows.append((t, int(h), key[ix].tobytes(), n[ix].tobytes(), low[ix].astype(np.uint32).tobytes(), check[ix].tobytes()))
            yield pd.DataFrame(rows, columns=["t", "h", "key", "n", "low", "chk"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n, low, check = (np.frombuffer(b"".join(pdf[c]), k) for c, k in (("key", np.int64), ("n", np.int32), ("low", np.uint32), ("chk", np.uint64)))
        order = np.argsort(key)  # the first is that of the least name in every block
        a, b, near = _block_links(low[order], check.reshape(-1, CHECK // 64)[order], n[order])
        key = key[order]
        out = pd.DataFrame({"a": key[a], "b": key[b], "near": near})
        give_back()
        return out

    dealt = one.select("key", "n", "fp").mapInPandas(deal, "t int, h long, key binary, n binary, low binary, chk binary")
    return dealt.groupBy("t", "h").applyInPandas(meet, "a long, b long, near boolean")


def _partners(met: DataFrame) -> DataFrame:
    """(b, others, first): all that a set has links to, at most two a block, and the first that it is near to."""
    return met.groupBy("b").agg(F.collect_set("a").alias("others"), F.min(F.when(F.col("near"), F.col("a"))).alias("first"))


def _contracted(star: DataFrame) -> DataFrame:
    """(a, b) that join what the links of ``star`` join: one for each b, and those between the distinct others of all b."""
    least = F.array_min("others")
    each = star.select(least.alias("a"), "b", F.explode("others").alias("o"))
    return each.select("a", F.when(F.col("o") == F.col("a"), F.col("b")).otherwise(F.col("o")).alias("b")).distinct()


def _sets(docs: DataFrame, base: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, sh) of the shingle sets whose names are in ``asked`` (key); one text of each is read."""

    @F.pandas_udf("struct<key long, sh binary>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        out = pd.DataFrame({"key": [_key(s) for s in sets], "sh": [s.tobytes() for s in sets]})
        del sets
        give_back()
        return out

    one = base.join(asked, "key").groupBy("key").agg(F.min("tk").alias("__tk")).select("__tk")
    texts = docs.select("text", F.xxhash64("text").alias("tk")).join(one, F.col("tk") == F.col("__tk"), "left_semi").dropDuplicates(["tk"])
    return durable(texts.select(of("text").alias("x")).select("x.key", "x.sh"))


def _alike(shared, n, m):
    """Whether sets of ``n`` and ``m`` shingles, of which ``shared`` are common, are similar enough."""
    return shared >= SIMILARITY * (n + m - shared) - 1e-9


def _similar(docs: DataFrame, base: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets have a Jaccard similarity of SIMILARITY or more, by their exact sets."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        both = [(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(x, y)]
        return pd.Series([_alike(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)) for s, t in both], dtype=bool)

    sets = _sets(docs, base, pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("sh").alias("y")), "b")
    return both.where(near("x", "y")).select("a", "b")


def _chunk_links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A forest of the links between members of two chunks that are near by SimHash and aren't joined yet, by their exact sets."""
    none = pd.DataFrame({"a": [], "b": []})
    if not len(left) or not len(right):
        return none
    one, two = (np.frombuffer(b"".join(x["chk"]), np.uint64).reshape(len(x), -1) for x in (left, right))
    n, m = left["n"].to_numpy(), right["n"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in left["sh"]], [np.frombuffer(x, np.uint64) for x in right["sh"]]
    names, at = np.unique(np.concatenate(sets[1]), return_inverse=True)
    starts = np.cumsum(m) - m
    mark = np.zeros(len(names), bool)
    a, b = [], []
    for i, own in enumerate(sets[0]):
        ask = (np.bitwise_count(one[i] ^ two).sum(axis=1) <= FAR) & (right["root"].to_numpy() != left["root"].iat[i]) & _sized(n[i], m)
        if not ask.any():
            continue
        place = np.searchsorted(names, own).clip(max=len(names) - 1)
        place = place[names[place] == own]
        mark[place] = True
        shared = np.add.reduceat(mark[at], starts, dtype=np.int64)
        mark[place] = False
        found = np.flatnonzero(ask & _alike(shared, n[i], m))
        a.append(np.full(len(found), i))
        b.append(found + len(n))
    if not a:
        return none
    keys = np.concatenate([left["key"].to_numpy(), right["key"].to_numpy()])
    root = _roots(len(keys), np.concatenate(a), np.concatenate(b))
    other = np.flatnonzero(root != np.arange(len(keys)))
    return pd.DataFrame({"a": keys[root[other]], "b": keys[other]})


def _across(docs: DataFrame, base: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between ``members`` (fam, key, root, n, chk) of one family and different roots.

    A family is cut into chunks of about CHUNK members: those of one large root by their keys, small
    roots whole, by their names. Two chunks meet in a group of their own, unless both are of one root, so
    no group is larger than two chunks, and what earlier links have joined is not compared again.
    """
    sizes = members.groupBy("fam", "root").agg(F.count("*").alias("c"))
    small = sizes.groupBy("fam").agg(F.sum(F.when(F.col("c") < CHUNK, F.col("c")).otherwise(0)).alias("s"))
    placed = members.join(sizes, ["fam", "root"]).join(small, "fam")
    large = F.col("c") >= CHUNK
    cut = lambda of, total: F.pmod(F.xxhash64(of), F.ceil(total / CHUNK).cast("long"))
    placed = placed.withColumn("chunk", F.when(large, F.struct(F.col("root").alias("of"), cut("key", F.col("c")).alias("at"), F.lit(True).alias("one")))
                               .otherwise(F.struct(F.lit(0).cast("long").alias("of"), cut("root", F.greatest("s", F.lit(1))).alias("at"), F.lit(False).alias("one"))))
    placed = durable(placed.select("fam", "key", "root", "n", "chk", "chunk"))
    chunks = placed.select("fam", "chunk").distinct()
    pairs = chunks.withColumnRenamed("chunk", "x").join(chunks.withColumnRenamed("chunk", "y"), "fam").where("x <= y")
    pairs = durable(pairs.where(~(F.col("x.one") & F.col("y.one") & (F.col("x.of") == F.col("y.of")))).withColumn("g", F.xxhash64("fam", "x", "y")))
    full = placed.join(_sets(docs, base, placed.select("key").distinct()), "key")
    names = ["g", "key", "root", "n", "chk", "sh"]
    side = lambda c: full.join(pairs.select("fam", F.col(c).alias("chunk"), "g"), ["fam", "chunk"]).select(*[F.col(x).alias(f"{x}_{c}") for x in names])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _chunk_links(*(x.set_axis(names, axis=1) for x in (left, right)))

    return side("x").groupBy("g_x").cogroup(side("y").groupBy("g_y")).applyInPandas(meet, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row: groups linked by five-word shingle similarity of SIMILARITY or more.

    Candidates meet by ball hashing in a block of their sets' wide SimHash, differ in at most FAR of
    CHECK bits and have sizes that allow the similarity; the exact shingle sets decide. First every set is
    compared with the first that it met. Then members of different roots, in families that
    the blocks' links hold together, meet in chunks; only a forest of their links leaves a task.
    """
    prefix, blocks, words = layout(docs.count())
    base = durable(_wide(docs, words))
    one = durable(base.where("n > 0").groupBy("key", "n").agg(F.first("fp").alias("fp")))
    star = durable(_partners(_met(one, prefix, blocks)))
    edges = durable(_similar(docs, base, star.where("first is not null").select(F.col("first").alias("a"), "b")))  # a pair a set, so few sets travel

    def rooted(df: DataFrame, cc: DataFrame) -> DataFrame:
        return df.join(cc.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))

    family = components(_contracted(star)).select(F.col("node").alias("key"), F.col("root").alias("fam"))
    split = rooted(family, components(edges))
    several = split.groupBy("fam").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("fam")
    left = durable(split.join(several, "fam", "left_semi").join(one.select("key", "n", F.substring("fp", 1, CHECK // 8).alias("chk")), "key"))
    cc = components(edges.unionByName(_across(docs, base, left)))
    named = rooted(base.select("id", "key"), cc)
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(least, "root").select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each group of ``near_groups``: that of the smallest doc_id, all columns kept.

    Rows with a null doc_id or a null text are kept as they are; texts without words are copies of
    each other. Of rows with texts that share the kept doc_id all stay.
    """
    texts = docs.where(F.col("text").isNotNull())
    kept = near_groups(texts).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    known = texts.join(kept, texts["doc_id"] == kept["__kept"], "left_semi")
    return known.unionByName(docs.where(F.col("doc_id").isNull() | F.col("text").isNull()))
