"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator and stage."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tetraspark.llm")

import corpus_pipeline
from tetraspark.llm import bpe, chat, common, decontaminate, sharding, simhash_dedup, suffix_dedup, toxicity
from tetraspark.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}" for i in range(20_000))
ROWS = [(1, None, 1), (2, "", 2), (3, " \n", 3), (4, "a b c d e f", 4), (4, "a b c d e f", 4), (None, "a b c d e f", 5), (None, None, 6), (5, LONG, 7), (2**60 + 1, "x", 8)]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with columns whose names the operators use inside."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, rid int").selectExpr("doc_id", "text", "rid", "rid as X", "rid as ID", "rid as fp", "rid as v", "rid as at", "rid as __d", "rid as key", "rid as size")


def ids(df, name="doc_id"):
    return Counter(r[name] for r in df.collect())


EVERY = Counter(r[0] for r in ROWS)


def test_op1_edges(docs):
    got = simhash_dedup.near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in got) == EVERY
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    zero, (same,) = "0" * 16, {r.fingerprint for r in got if r.doc_id == 4}
    assert by[1, zero] == by[2, zero] == by[3, zero] == by[None, zero] == 1 and by[4, same] == by[None, same] == 4
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash_dedup.near_duplicates(docs, radius=3)


def test_op1_hot_buckets_and_hubs(spark, monkeypatch):
    """Hot buckets are dealt out by further bits and hubs joined apart, without a change of the components."""
    monkeypatch.setattr(simhash_dedup, "DEALT", 150)
    monkeypatch.setattr(simhash_dedup, "EXPANDED", 1 << 12)  # many buckets, so that the mean is low
    monkeypatch.setattr(common, "HUB", 60)
    monkeypatch.setattr(common, "HUBS", 50)
    rng = random.Random(1)
    base, prints = rng.getrandbits(64), {rng.getrandbits(64) for _ in range(100)}
    for _ in range(500):
        x = base
        for b in rng.sample(range(46), rng.randint(1, 8)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(prints):
        for y in prints[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                root[find(y)] = find(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints}
    dealt, real = [], simhash_dedup.durable
    monkeypatch.setattr(simhash_dedup, "durable", lambda df: dealt.append(df.columns) or real(df))
    found = simhash_dedup.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), len(prints))
    assert ["fp", "at"] in dealt  # some bucket was hot
    cc = {r.node: r.root for r in common.components(found).collect()}
    groups = lambda of: sorted(sorted(x for x in prints if of(x) == r) for r in {of(x) for x in prints})
    assert groups(find) == groups(lambda x: cc.get(signed[x], signed[x]))


def test_op2_edges(docs):
    got = sharding.hilbert_shards(docs.selectExpr("doc_id", "text", "null as lang", "cast(null as string) as source", "ID", "X"), 24).collect()
    assert Counter(r.doc_id for r in got) == EVERY
    assert sorted(Counter(r.shard for r in got).values()) == [1] * len(ROWS) and {r.slot for r in got} == {0}
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(8, 0)}
    assert sharding.hilbert_shards(docs.limit(0).selectExpr("doc_id", "text", "'a' lang", "'b' source")).count() == 0


def test_op4_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in got) == EVERY and {r.predicted for r in got} == {0} and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.train(docs.limit(0), none)[0].size == 0
    kept = toxicity.reject_toxic(docs, spark.createDataFrame([(4, 1), (None, 1), (5, None)], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and ids(kept) == EVERY


def test_op7_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "tie"), (2, 0, None, "no role"), (3, 0, "assistant", "w " * 20_000), (None, 0, "user", "x"), (4, None, "user", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "turn as n", "role as R", "text as spans")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert {c: got[c].n_turns for c in (1, 2, 3, 4)} == {1: 3, 2: 1, 3: 1, 4: 1}
    assert got[1].loss_chars == 3 and got[3].loss_chars == 40_000
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_op8_edges(docs):
    got = suffix_dedup.repeats(docs).collect()
    assert Counter(r.doc_id for r in got) == EVERY
    by = {r.doc_id: (r.n_bytes, r.n_removed) for r in got}
    assert by[1] == by[2] == (0, 0) and by[4] == (11, 0) and by[5] == (len(LONG), len(LONG))  # the long text repeats itself
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0
    kept = suffix_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns and ids(kept) == EVERY
    assert {(r.doc_id, r.text) for r in kept.collect() if r.doc_id in (1, 4, 5)} == {(1, None), (4, "a b c d e f"), (5, "")}
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_op8_same_names(spark, monkeypatch):
    """Different rows that share a name are told apart."""
    real = suffix_dedup.F.xxhash64
    monkeypatch.setattr(suffix_dedup.F, "xxhash64", lambda *c: suffix_dedup.F.lit(7).cast("long") if len(c) == 2 and str(c[0]) == "Column<'doc_id'>" else real(*c))
    a = "".join(random.Random(2).choices("abcdefgh ", k=900))
    rows = [(1, a), (2, "x" + a[:400]), (3, "nothing else"), (4, None)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 400, 2: 400, 3: 0, 4: 0}


def test_op9_edges(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    got = Counter((r.doc_id, r.n_tokens) for r in bpe.digests(docs, vocabulary_path()).collect())
    assert got == Counter((d, len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, _ in ROWS)
    assert bpe.digests(docs.limit(0), vocabulary_path()).count() == 0


def test_op10_edges(spark, docs):
    items = spark.createDataFrame([(9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (8, None), (7, ""), (6, "x")], "item_id long, text string").selectExpr("*", "text as sh", "item_id as m")
    got = Counter((r.doc_id, r.item_id, r.similarity) for r in decontaminate.contaminated(docs, items).collect())
    assert got == Counter([(4, 9, 1.0), (4, None, 1.0), (None, 9, 1.0), (None, None, 1.0), (2**60 + 1, 6, 1.0)])
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and ids(kept) == Counter({1: 1, 2: 1, 3: 1, 5: 1})
    for a, b in ((docs.limit(0), items), (docs, items.limit(0))):
        assert decontaminate.contaminated(a, b).count() == 0


def test_op10_brute_force(spark):
    """All pairs of a document and an item that some window matches, and its similarity, against every window of every document."""
    import re

    rng = random.Random(6)
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(r.doc_id, words(r.text)[:400]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for n, (_, w) in enumerate(items):  # items with none to three words changed, within other words
        for c in range(4):
            own = list(w)
            for at in rng.sample(range(len(own)), c):
                own[at] = f"q{n}"
            texts.append((10_000 + 10 * n + c, [f"p{rng.randrange(99)}" for _ in range(n % 30)] + own + ["end"] * (n % 3)))
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for item, w in items:
        one = Counter(runs(w))
        m = sum(one.values())
        for doc, t in texts:
            sh = runs(t)
            if not one.keys() & set(sh):
                continue
            for at in range(max(1, len(sh) - m + 1)):
                two = Counter(sh[at : at + m])
                s = sum((one & two).values())
                if (sim := s / (m + sum(two.values()) - s)) >= 0.8 - 1e-12:
                    want[doc, item] = max(sim, want.get((doc, item), 0))
    got = decontaminate.contaminated(
        spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    ).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert got.keys() <= want.keys() and len(want) > 40 and len(got) >= 0.99 * len(want)
    assert all(abs(want[k] - s) < 1e-9 for k, s in got.items())


def test_near_groups_chunks(spark, monkeypatch):
    """Families cut into many chunks give the groups that one chunk gives."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    rows = []
    for i in range(90):  # a chain: each text changes one word more of its neighbour
        base = list(base)
        base[rng.randrange(120)] = f"z{i}"
        rows.append((i, " ".join(base)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in simhash_dedup.near_groups(docs).collect()}
    monkeypatch.setattr(simhash_dedup, "CHUNK", 8)
    assert {r.doc_id: r.component_id for r in simhash_dedup.near_groups(docs).collect()} == whole
    assert set(whole.values()) == {0}


def test_stages_on_odd_tables(spark, docs, tmp_path):
    """Every stage takes odd rows, other columns and empty tables, and all but the last return the columns they get."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            rows = out.collect()
            assert (len(rows) > 0) == (table is docs), name
            if name != "bpe":
                assert out.columns == docs.columns, name
            if table is docs:
                assert {1, None} <= {r.doc_id for r in rows}, name
