"""Benchmark decontamination with SimHash windows, a multi-index over Hamming blocks and an exact check.

Every benchmark item is compared with windows of documents that have as many word shingles as it
has. Windows and items get 64-bit SimHash fingerprints; an index over the blocks of the items'
fingerprints gives every item of the window's size within the radius, as fingerprints that differ in
at most RADIUS bits agree in at least one of RADIUS + 1 blocks; and the weighted Jaccard similarity
of the two multisets of shingles decides. DataFrame functions only.

A window can only be similar enough to some item of its size if enough of its shingles occur in items
of that size, and moving its start to its first such shingle never loses one. Only windows that start
at such a shingle and hold enough of them get a fingerprint. This knows no item and loses no pair;
which items a window is compared with is for the index alone to say.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of multisets with the least similarity differ in 9.7 of 64 bits on average, with a
#: standard deviation of 2.9; the radius is 3.9 deviations above.
RADIUS = 21
#: Rows of three or four numbers (16 MB) up to which a side is broadcast after its count is known; beyond, joins shuffle.
SMALL = 500_000


def words(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_hashes(hashed: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` word hashes; empty if there are fewer words."""
    n = F.size(hashed)
    at = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(width)]))


def with_shingles(df: DataFrame, width: int, name: str = "sh") -> DataFrame:
    """``df`` with its text's shingle hashes; the text's words are hashed first."""
    return df.withColumn("__h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).withColumn(name, shingle_hashes(F.col("__h"), width)).drop("__h")


def simhash(hashes: Column, lanes: int) -> Column:
    """64-bit SimHash of an array of hashes: a bit is 1 where over half of them have it.

    Bit counts are kept ``lanes`` to a long, in fields of 64 / lanes bits.
    """
    width = 64 // lanes
    one = sum(1 << (width * k) for k in range(lanes))
    field = (1 << width) - 1
    start = F.array_repeat(F.lit(0).cast("long"), width)
    sums = F.aggregate(hashes, start, lambda acc, h: F.transform(acc, lambda a, j: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(one))))

    def pack(acc: Column) -> Column:
        def add(out: Column, b: Column) -> Column:
            count = F.call_function("shiftrightunsigned", F.get(acc, b % width), (F.floor(b / width) * width).cast("int")).bitwiseAND(F.lit(field))
            return F.when(count * 2 > F.size(hashes), out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(out)

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), add)

    return F.get(F.transform(F.array(sums), pack), F.lit(0))


def blocks(fp: Column) -> Column:
    """The fingerprint's RADIUS + 1 blocks, as (number, value) pairs."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*[
        F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ])


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, word, similarity): documents that hold a window similar to an item.

    One row for each document and item: the window of greatest similarity, the first of them, from
    word number ``word``. Shingles have five words; items of fewer words are one shingle and must
    occur as they are; items without a word match nothing. Documents that are shorter than an item
    are compared whole. Null texts are empty; rows that repeat count once; null ids are ids of their
    own; other columns are ignored; empty tables give an empty result.
    """
    own = benchmark.where("text is not null").select("item_id", "text").distinct()
    counted = own.withColumn("w", F.size(words(F.col("text")))).where("w > 0")
    widths = sorted(r[0] for r in counted.select(F.least(F.lit(SHINGLE), "w").alias("k")).distinct().collect())  # at most five
    found = None
    for k in widths:
        items = counted.where((F.col("w") >= SHINGLE) if k == SHINGLE else (F.col("w") == k)).select("item_id", "text")
        part = _of_width(docs, items, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select("doc_id").limit(0).crossJoin(benchmark.select("item_id").limit(0)).select("doc_id", "item_id", F.lit(0).alias("word"), F.lit(0.0).alias("similarity"))
        return found
    best = F.min_by(F.struct("word", "similarity"), F.struct(-F.col("similarity"), "word"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.word", "x.similarity")


def _of_width(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    items = durable(with_shingles(items, width).select(F.xxhash64("item_id", "text").alias("ik"), "item_id", F.col("sh").alias("ish"), F.size("sh").alias("m")))
    shingles = durable(items.select("ik", "m", F.explode("ish").alias("h")).groupBy("ik", "m", "h").agg(F.count("*").alias("ci")))
    n_shingles, longest = shingles.count(), items.agg(F.max("m")).first()[0]
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    hashed = with_shingles(keyed.where("text is not null"), width).drop("text")
    # where a document's shingles are those of items of some size; _outer, as the filter that Spark infers for explode()
    # would work out all arrays anew for every element
    of_size = shingles.select("m", "h").distinct()
    hits = hashed.select("doc_id", "tk", F.posexplode_outer("sh").alias("p", "h")).join(_sized(of_size, n_shingles), "h")
    least = F.ceil(F.lit(SIMILARITY) * F.col("m") - 1e-9).cast("int")
    hits = hits.groupBy("doc_id", "tk", "m").agg(F.array_sort(F.collect_set("p")).alias("ps")).where(F.size("ps") >= least)
    # starts from which the window holds enough of them
    last = F.size("ps") - least
    starts = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.when(
        F.get("ps", i + least - 1) < F.get("ps", i) + F.col("m"), F.get("ps", i))), lambda s: s.isNotNull())
    asked = durable(hits.select("doc_id", "tk", "m", starts.alias("starts")).where(F.size("starts") > 0))
    n_asked = asked.count()
    near = _sized(asked.withColumnRenamed("doc_id", "__d").withColumnRenamed("tk", "__t"), n_asked)
    hold = keyed.where("text is not null").join(near, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("tk") == F.col("__t"))).drop("__d", "__t")
    hold = hold.dropDuplicates(["doc_id", "tk", "m"]) if n_asked else hold
    hold = with_shingles(hold, width).drop("text")
    clipped = F.array_distinct(F.transform("starts", lambda s: F.greatest(F.least(s, F.size("sh") - F.col("m")), F.lit(0))))
    windows = hold.select("doc_id", "tk", F.col("m").alias("wm"), "sh", F.explode_outer(clipped).alias("word"))
    windows = windows.select("doc_id", "tk", "wm", "word", F.slice("sh", F.col("word") + 1, F.col("wm")).alias("sh"))
    lanes = 4 if (longest or 0) < 1 << 16 else 2
    windows = windows.withColumn("fp", simhash(F.col("sh"), lanes))
    index = items.withColumn("ifp", simhash(F.col("ish"), lanes)).select("ik", "item_id", "m", "ifp", F.explode(blocks(F.col("ifp"))).alias("b"))
    index = durable(index.select("ik", "item_id", "m", "ifp", F.col("b.no").alias("no"), F.col("b.value").alias("value")))
    # items of the window's size that agree in a block; of several such blocks the first one counts
    asks = windows.select("doc_id", "tk", "wm", "word", "sh", "fp", F.explode(blocks(F.col("fp"))).alias("b"))
    index = _sized(index, n_shingles * (RADIUS + 1))
    meet = asks.join(index, (F.col("wm") == F.col("m")) & (F.col("b.no") == F.col("no")) & (F.col("b.value") == F.col("value")))
    differ = F.col("fp").bitwiseXOR(F.col("ifp"))
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    first = F.coalesce(*[F.when(F.shiftrightunsigned(differ, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0, F.lit(i)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    meet = meet.where((F.bit_count(differ) <= RADIUS) & (first == F.col("no")))
    # the exact check: weighted Jaccard of both multisets of shingles
    held = meet.select("doc_id", "tk", "ik", "item_id", "m", "word", F.size("sh").alias("n"), F.explode("sh").alias("h"))
    key = ["doc_id", "tk", "ik", "item_id", "m", "word", "n"]
    both = held.groupBy(*key, "h").agg(F.count("*").alias("c")).join(_sized(shingles.drop("m"), n_shingles), ["ik", "h"])
    shared = both.groupBy(*key).agg(F.sum(F.least("c", "ci")).alias("s"))
    similarity = F.col("s") / (F.col("n") + F.col("m") - F.col("s"))
    return shared.select("doc_id", "item_id", "word", similarity.alias("similarity")).where(F.col("similarity") >= SIMILARITY)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns, repeats, and rows with null texts are kept.

    A document with a null doc_id that holds an item goes with all rows of null doc_id, as they are
    one id; other rows that share an id go together as well. Empty tables leave ``docs`` as it is;
    of columns only doc_id and text are read.
    """
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")
