"""Cross-entropy difference between matched n-gram models of a target and of the background.

Both models are interpolated bigram models over one vocabulary: all words that occur at least twice
in the whole background, and one unknown word for the rest. Target and background are matched by
weighting: each model's counts are divided by its own number of tokens. Every document is scored by
models that have not counted it (leave one out), so a document is no evidence for itself.

Counts are exact and stay distributed. Texts are read once and kept as word numbers in parts of
bounded size, a row each, in the cluster's shared folder. Each part sends every word or bigram that
it holds once, to a bucket of the name's leading bits; the bucket adds up what all parts sent and
answers each part in the order it asked. Only totals reach the driver.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep, ship

ship(__name__)

#: Smoothing.
BIGRAM_WEIGHT, ADD = 0.6, 0.5
#: Characters of text, and documents, in a part at most (a longer text is a part of its own).
PART, PART_DOCS = 12_000_000, 400_000
#: Characters of text for each bucket, which gets a name for every ten characters or fewer.
BUCKET = 16_000_000
#: Local number of the mark at both ends of a text, and the names of the mark and of the unknown word.
MARK, UNKNOWN = 0, 1

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def name_of(word: str) -> int:
    """A word's 64-bit name; neither the mark's nor the unknown word's."""
    return max(2, xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42))


def bigram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit names of the bigrams (a, b)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, the lowest first, without those that are zero throughout."""
    planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T
    used = max((i + 1 for i in range(8) if planes[i].any()), default=0)
    return planes[:used].tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    if n:
        held = np.frombuffer(data, np.uint8).reshape(-1, n)
        planes[: len(held)] = held
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first from zero."""
    return np.diff(x, prepend=np.uint64(0))


def deal(part: int, k: np.ndarray, counts: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """A row for each bucket: the ascending names ``k`` that fall in it, and what the part counted of each."""
    cuts = np.searchsorted(k, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64))
    ends = np.append(cuts[1:], len(k))
    rows = [(part, b, int(z - a), pack(steps(k[a:z])), *(pack(c[a:z]) for c in counts)) for b, (a, z) in enumerate(zip(cuts, ends)) if z > a]
    return pd.DataFrame(rows, columns=["part", "b", "m", "k", *[f"c{i}" for i in range(len(counts))]])


def exchange(dealt: DataFrame, width: int) -> DataFrame:
    """(part, b, m, c0, ...): the sums over all parts of what each part counted, in the order in which it sent the names."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [np.cumsum(unpack(k, m), dtype=np.uint64) for k, m in zip(pdf["k"], pdf["m"])]
        one, at = np.unique(np.concatenate(names), return_inverse=True)
        cuts = np.cumsum([0, *pdf["m"]])
        out = pdf[["part", "b", "m"]].copy()
        for i in range(width):
            own = np.concatenate([unpack(c, m) for c, m in zip(pdf[f"c{i}"], pdf["m"])]).astype(np.int64)
            sums = np.bincount(at, own, len(one)).astype(np.uint64)  # exact below 2 ** 53
            out[f"c{i}"] = [pack(sums[at[a:z]]) for a, z in zip(cuts, cuts[1:])]
        del names, one, at, own, sums
        give_back()
        return out

    columns = ", ".join(f"c{i} binary" for i in range(width))
    return dealt.groupBy("b").applyInPandas(add, f"part long, b int, m int, {columns}")


def answered(pdf: pd.DataFrame, i: int) -> np.ndarray:
    """The sums ``c<i>`` that came back to a part, in the order of its names."""
    pdf = pdf.sort_values("b")
    got = [unpack(c, m) for c, m in zip(pdf[f"c{i}"], pdf["m"])]
    return np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64)


def _encoded(docs: DataFrame) -> DataFrame:
    """Parts, a row each: (part, ids, lengths, tokens, n_words, names, counts), texts as the part's own word numbers.

    ``names`` are the part's words in ascending order of their names, ``counts`` how often each
    occurs; a token is 0 for a mark, or the word's place among them and one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids, lengths, tokens, number, chars = [], [], [], {}, 0

        def row():
            nonlocal made
            local = list(number)
            k = np.array([name_of(w) for w in local], np.uint64)
            t = np.concatenate(tokens)
            names, at = np.unique(k, return_inverse=True)  # words whose names agree are one
            t = np.where(t > 0, at[t - 1] + 1, 0) if len(local) else t
            n = np.bincount(t, minlength=len(names) + 1)
            out = [(task << 31) + made, ids, pack(np.array(lengths, np.uint64)), pack(t.astype(np.uint64)), len(t), len(names), pack(steps(names)), pack(n[1:].astype(np.uint64))]
            made += 1
            give_back()
            return pa.RecordBatch.from_arrays([pa.array([x], type=f) for x, f in zip(out, types)], names=columns)

        for batch in batches:
            types = [pa.int64(), pa.list_(batch.schema.field(0).type), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(text or "")
                if ids and (chars + size > PART or len(ids) >= PART_DOCS):
                    yield row()
                    ids, lengths, tokens, number, chars = [], [], [], {}, 0
                words = words_of(text)
                own = np.zeros(len(words) + 2, np.int64)
                own[1:-1] = [number.setdefault(w, len(number)) for w in words]
                own[1:-1] += 1
                ids.append(d)
                lengths.append(len(own))
                tokens.append(own)
                chars += size
        if ids:
            yield row()

    schema = f"part long, ids array<{kind}>, lengths binary, tokens binary, n_tokens int, n_words int, names binary, counts binary"
    columns = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Part:
    """A part's texts, with singletons as the unknown word, and all names that it asks counts of."""

    def __init__(self, row, once: np.ndarray, hit: set):
        n = int(row["n_words"])
        names = np.cumsum(unpack(row["names"], n), dtype=np.uint64)
        known = np.where(once, np.uint64(UNKNOWN), names)
        t = unpack(row["tokens"], int(row["n_tokens"])).astype(np.int32)
        self.lengths = unpack(row["lengths"], len(row["ids"])).astype(np.int64)
        self.hit = np.array([i in hit for i in range(len(self.lengths))], bool)
        # what stands for each token is named once: the part's known words, the unknown word and the mark
        words, code = np.unique(np.append(known, np.uint64(MARK)), return_inverse=True)
        t = code.astype(np.int32)[t - 1]  # 0 - 1 is the last, the mark
        first = np.zeros(len(t), bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        after = np.flatnonzero(~first)  # every token but the mark at its text's beginning
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths - 1)
        before, here = t[after - 1], t[after]
        del t, first, after
        pairs, pair = np.unique(before.astype(np.int64) * len(words) + here, return_inverse=True)
        pair = pair.astype(np.int32)
        # words and bigrams share one space of names, so that one exchange counts both
        single = bigram(np.full(len(words), 0x5851F42D4C957F2D, np.uint64), words)
        self.names, at = np.unique(np.concatenate([single, bigram(words[pairs // len(words)], words[pairs % len(words)])]), return_inverse=True)
        at = at.astype(np.int32)
        self.at = np.stack([at[here], at[before], at[len(words) :][pair]])

    def counts(self) -> list[np.ndarray]:
        """How often each name occurs in the part's target texts, and in all of its texts."""
        target = self.hit[self.doc]
        return [sum(np.bincount(self.at[j][w], minlength=len(self.names)) for j in (0, 2)).astype(np.uint64) for w in (target, slice(None))]

    def _own(self, which: int, of: int) -> np.ndarray:
        """How often the name at each place of ``which`` occurs among the names ``of`` in the place's own text."""
        base = self.doc.astype(np.int64) * len(self.names)
        keys, n = np.unique(base + self.at[of], return_counts=True)
        base += self.at[which]
        at = np.searchsorted(keys, base).clip(max=max(0, len(keys) - 1))
        return np.where(keys[at] == base, n[at], 0).astype(np.int32)

    def losses(self, sums: list[np.ndarray], totals: list[int], size: int) -> list[np.ndarray]:
        """Each text's mean loss in either model, from which its own counts are taken."""
        own = [self._own(0, 0), self._own(1, 0), self._own(2, 2)]
        length = (self.lengths - 1)[self.doc]
        starts = np.cumsum(self.lengths - 1) - (self.lengths - 1)
        out = []
        for side in (0, 1):
            less = self.hit[self.doc].astype(np.int64) if side == 0 else 1  # the target has only counted its own texts
            word, context, pair = (sums[side][self.at[j]] - less * own[j] for j in range(3))
            p = (word + ADD) / (totals[side] - less * length + ADD * size)
            p = (1 - BIGRAM_WEIGHT) * p + BIGRAM_WEIGHT * np.where(context > 0, pair / np.maximum(context, 1), p)
            out.append(np.add.reduceat(-np.log(p), starts) / (self.lengths - 1))
        return out


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of ``docs``.

    The target is the rows of ``docs`` whose doc_id is in ``target_ids``; the background is all rows.
    Both models leave out the document that they score; repeated rows are documents of their own and
    so know each other. score = target_loss - background_loss, per token: lower means more like the
    target. Null and empty texts have no word and are scored on their end mark alone; null ids are
    scored and belong to the background; with no target text the target's loss comes from smoothing
    alone. Very long texts are a part of their own. Other columns are not read; empty tables give an
    empty result.
    """
    spark = docs.sparkSession
    name = f"lm-{uuid.uuid4().hex}"
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // BUCKET))
    parts = keep(_encoded(docs), f"{name}/parts")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def words(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                yield deal(r.part, np.cumsum(unpack(r.names, r.n_words), dtype=np.uint64), [unpack(r.counts, r.n_words)], buckets)

    asked = parts.select("part", "n_words", "names", "counts").mapInPandas(words, "part long, b int, m int, k binary, c0 binary")
    back = keep(exchange(asked, 1), f"{name}/words")

    # which texts of each part are the target's
    where = parts.select("part", F.posexplode("ids").alias("at", "d")).where("d is not null")
    wanted = target_ids.select(F.col("doc_id").alias("d")).where("d is not null").distinct()
    hits = where.join(wanted, "d", "left_semi").groupBy("part").agg(F.collect_list("at").alias("hits"))
    texts = parts.select("part", "ids", "lengths", "tokens", "n_tokens", "n_words", "names").join(hits, "part", "left")

    def once(counts: pd.DataFrame) -> np.ndarray:
        return answered(counts, 0) == 1

    def of(row, counts: pd.DataFrame) -> Part:
        hit = row["hits"]
        return Part(row, once(counts), set() if hit is None else {int(i) for i in hit})

    totals = "part long, b int, m int, k binary, c0 binary, c1 binary"

    def both(left: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c.split()[0]: [] for c in totals.split(", ")})
        part = of(left.iloc[0], counts)
        out = deal(int(left["part"].iat[0]), part.names, part.counts(), buckets)
        del part
        give_back()
        return out

    sums = keep(exchange(texts.groupBy("part").cogroup(back.groupBy("part")).applyInPandas(both, totals), 2), f"{name}/counts")
    # the vocabulary's size and the models' numbers of tokens, from what each part holds
    unit = "known double, target long, tokens long"

    def measure(left: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"known": [], "target": [], "tokens": []})
        row = left.iloc[0]
        hit, n = row["hits"], unpack(row["lengths"], len(row["ids"])).astype(np.int64) - 1
        here, all_ = unpack(row["counts"], int(row["n_words"])).astype(np.int64), answered(counts, 0)
        # a word adds up to one over all parts that hold it
        known = float((here[all_ > 1] / all_[all_ > 1]).sum())
        return pd.DataFrame({"known": [known], "target": [int(sum(n[int(i)] for i in (hit if hit is not None else ())))], "tokens": [int(n.sum())]})

    sizes = parts.select("part", "ids", "lengths", "n_words", "counts").join(hits, "part", "left")
    known, target, tokens = sizes.groupBy("part").cogroup(back.groupBy("part")).applyInPandas(measure, unit).agg(F.sum("known"), F.sum("target"), F.sum("tokens")).first()
    size, total = round(known or 0) + 2, [target or 0, tokens or 0]

    def score(left: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_tokens", "target_loss", "background_loss"]
        if not len(left):
            return pd.DataFrame({c: [] for c in columns})
        row = left.iloc[0]
        part = of(row, counts[counts["c1"].isna()])
        found = counts[counts["c1"].notna()]
        a, b = part.losses([answered(found, 0), answered(found, 1)], total, size)
        lengths = part.lengths - 2
        del part, found
        give_back()
        return pd.DataFrame(dict(zip(columns, (pd.Series(list(row["ids"]), dtype=object), lengths, a, b))))

    counts = sums.unionByName(back.withColumn("c1", F.lit(None).cast("binary")))
    got = texts.groupBy("part").cogroup(counts.groupBy("part")).applyInPandas(score, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double")
    return got.withColumn("score", F.col("target_loss") - F.col("background_loss"))
