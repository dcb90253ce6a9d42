"""Byte-pair encoding and decoding with a vocabulary file of the tokenizers library.

A word's symbols form a doubly linked list, and a priority queue holds the merges that its
neighbours allow, by rank and then by place. The best is taken; an entry whose symbols have changed
since it was pushed is stale and skipped. Equal words are encoded once while a bounded memory lasts.
Decoding concatenates vocabulary strings.
"""

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ship

ship(__name__)

#: Words that a task remembers before it starts anew.
REMEMBERED = 200_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary, given as the text of its JSON file.

    Supported: byte-level BPE with NFC, white-space and lower-case normalisation, a splitting
    pattern, an end-of-word suffix and special tokens that are matched in the raw text. Any other
    part in the file raises ValueError.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, *rest = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or [x["type"] for x in rest] != ["ByteLevel"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("the vocabulary needs parts that are not supported")
        blanks = spec["normalizer"]["normalizers"][1]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
        odd += [k for k, ok in (("Replace", blanks["pattern"] == {"Regex": r"\s+"} and blanks["content"] == " "), ("Split", split["behavior"] == "Removed" and split["invert"]),
                                ("ByteLevel", not rest[0]["add_prefix_space"] and not rest[0]["use_regex"])) if not ok]
        if odd:
            raise ValueError(f"the vocabulary sets what is not supported: {', '.join(odd)}")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.heads = {t[:2] for t in special}  # what a text must hold to have any of them
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in special.items()}
        self.inner = [self.vocab[c] for c in byte_alphabet()]
        self.last = [self.vocab[c + self.suffix] for c in byte_alphabet()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.vocab[a] << 32 | self.vocab[b], (rank, self.vocab[a + b]))
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one normalised word."""
        data = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if m := merges.get(ids[i] << 32 | ids[i + 1]):
                queue.append((m[0], i, m[1]))
        heapify(queue)
        while queue:
            rank, i, new = heappop(queue)
            if ids[i] < 0 or (j := after[i]) >= n:
                continue
            m = merges.get(ids[i] << 32 | ids[j])
            if not m or m[0] != rank:  # stale
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(new << 32 | ids[k]):
                    heappush(queue, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get(ids[h] << 32 | new)):
                heappush(queue, (m[0], h, m[1]))
        return [x for x in ids if x >= 0]

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of a text without blanks and line ends."""
        # The pattern drops white space, so it needs no normalising first; lower case is taken
        # character by character, without the rule for a final sigma.
        if not unicodedata.is_normalized("NFC", chunk):
            chunk = unicodedata.normalize("NFC", chunk)
        out: list[int] = []
        known = self.words
        for w in self.pattern.findall(chunk.replace("Σ", "σ").lower()):
            got = known.get(w)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = self.word(w)
                if len(w) < 64:
                    known[w] = got
            out += got
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        # No word spans a blank or a line end, and nothing composes with them.
        known, extend = self.chunks, out.extend
        get = known.get
        for c in text.replace("\n", " ").split(" "):
            got = get(c)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = self._chunk(c)
                if len(c) < 64:
                    known[c] = got
            extend(got)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; a null text is empty."""
        out: list[int] = []
        if not text:
            return out
        if not any(h in text for h in self.heads):
            self._plain(text, out)
            return out
        for i, part in enumerate(self.marks.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids) -> str:
        """The vocabulary strings of ``ids``; as the file has no decoder, blanks stand between them."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


def load(spark: SparkSession, path: str):
    """A broadcast of the vocabulary file's text; its size is the file's, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(source):
    """Column function: a text's token ids."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = Bpe(source.value)
        for texts in batches:
            yield texts.map(bpe.encode)

    return run


def decoder(source):
    """Column function: the text of token ids; null ids give the empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = Bpe(source.value)
        for rows in batches:
            yield rows.map(lambda ids: bpe.decode(ids) if ids is not None else "")

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, and its ids decoded.

    Null and empty texts have no token and the digests of nothing. Null and repeated ids are rows
    like any other; other columns are ignored; an empty table gives an empty result.
    """
    source = load(docs.sparkSession, path)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    @lean
    def run(batches):
        bpe = Bpe(source.value)
        decimal = {i: str(i) for i in bpe.strings}
        sha = hashlib.sha256
        for batch in batches:
            counts, digested, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids))
                digested.append(sha(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                decoded.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digested, pa.string()), pa.array(decoded, pa.string())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
