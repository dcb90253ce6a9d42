"""Each operator over a whole small table, against a brute-force version of its contract."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

pytest.importorskip("tetraspark.llm")

import corpus_pipeline
from tetraspark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1(spark):
    import re

    prints = {}
    for r in table(spark, "documents"):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op1_simhash_dedup(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


def test_op2(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents")}
    rows = Q.op2_hilbert_sharding(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(docs))
    by = defaultdict(list)
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text)) and 0 <= r.shard < 24
        by[r.shard].append(r)
    law = {r.law for r in rows}
    assert len(law) == 1
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    if law == {"rows"}:
        counts = [len(by[s]) for s in range(24)]
        assert max(counts) - min(counts) <= 1
    if law != {"key"}:
        assert all(r.grown_shard is None for r in rows)


def test_op3(spark):
    rows = Q.op3_html_extraction(spark, SF).collect()
    pages = {r.page_id: r for r in table(spark, "pages")}
    assert Counter(r.page_id for r in rows) == Counter(list(pages))
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert "<script" not in r.text and "\n\n" not in r.text and r.text == r.text.strip()
    assert sum(bool(r.text) for r in rows) > 0.8 * len(rows)


def auc(pairs):
    one, zero = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    return np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])


def test_op4(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold six toxic rows out of the training fold, too few to judge by
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op4_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert auc(held) > 0.9
    assert np.mean([(s >= 0.5) == bool(t) for s, t in held]) > 0.9


def test_op5(spark):
    vecs = {r.vec_id: np.array(r.embedding, dtype=float) for r in table(spark, "embeddings") if r.embedding is not None}
    vecs = {k: v for k, v in vecs.items() if np.isfinite(v).all() and v.any()}
    ids = np.array(sorted(vecs))
    m = np.stack([vecs[i] for i in ids])
    got = defaultdict(list)
    for r in Q.op5_nearest_neighbours(spark, SF).collect():
        got[r.query_id].append(r)
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(got) == queries
    hit = 0
    for q in queries:
        part = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in part] == list(range(1, 21))
        for r in part:
            assert r.score == pytest.approx(float(vecs[q] @ vecs[r.vec_id]), rel=1e-12, abs=1e-12)
        assert part == sorted(part, key=lambda r: (-r.score, r.vec_id))
        s = m @ vecs[q]
        best = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:20]
        hit += len({b for _, b in best} & {r.vec_id for r in part})
    assert hit / (20 * len(queries)) >= 0.9


def test_op6(spark):
    rows = Q.op6_lm_scoring(spark, SF).collect()
    assert len(rows) == len(table(spark, "documents"))


def test_op7(spark):
    turns = defaultdict(list)
    for r in table(spark, "conversations"):
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = Q.op7_chat_formatting(spark, SF).collect()
    assert Counter(r.conv_id for r in rows) == Counter(list(turns))
    for r in rows:
        own = sorted(turns[r.conv_id])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, role, t in own))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars > sum(len(t) for _, _, t in own)


def test_op8(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in table(spark, "documents")}
    seen = Counter(hash(b[i : i + 200]) for b in docs.values() for i in range(len(b) - 199))
    want = {}
    for d, b in docs.items():
        cut = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - 199):
            if seen[hash(b[i : i + 200])] > 1:
                cut[i] += 1
                cut[i + 200] -= 1
        gone = np.cumsum(cut)[: len(b)] > 0
        runs = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        want[d] = (len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op8_suffix_dedup(spark, SF).collect()}
    assert got == want


def test_op9(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    want = {}
    for r in table(spark, "documents"):
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op9_bpe(spark, SF).collect()}
    assert got == want


def test_op10(spark):
    """Documents that hold a whole item, word for word, are found."""
    items = {r.item_id: " ".join((r.text or "").lower().split()) for r in table(spark, "benchmark")}
    docs = {r.doc_id: f" {' '.join((r.text or '').lower().split())} " for r in table(spark, "documents")}
    whole = {d for d, t in docs.items() if any(len(i.split()) >= 5 and f" {i} " in t for i in items.values())}
    got = {r.doc_id for r in Q.op10_decontamination(spark, SF).collect()}
    assert whole and whole <= got


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in rows}
    assert ids <= {r.doc_id for r in table(spark, "documents")} and len(ids) == len(rows) > 50
