"""Methods step by step against plain forms of them, very long texts, and the queries' columns."""

import math
import os
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pulseweave.llm import langid, ngram_join, quality, queries, topk
from pulseweave.llm.textgrams import shingle_sets
from pulseweave.session import shared_dir

from .test_table_operators import sample_vectors, vectors
from .test_text_operators import EN, brute_components, shingles, texts_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_ftrl_equals_the_plain_recursion():
    g = np.random.default_rng(1)
    examples = [(np.sort(g.choice(20, 4, replace=False)), g.random(4), int(g.integers(3))) for _ in range(40)]
    a, b, l1, l2 = 0.5, 1.0, 0.5, 0.02
    z, n = [[0.0] * 3 for _ in range(21)], [[0.0] * 3 for _ in range(21)]

    def weight(i, c):
        if i == 20:
            return -z[i][c] / ((b + math.sqrt(n[i][c])) / a)
        return 0.0 if abs(z[i][c]) <= l1 else -(z[i][c] - math.copysign(l1, z[i][c])) / ((b + math.sqrt(n[i][c])) / a + l2)

    for _ in range(2):
        for cols, values, y in examples:
            x = {**dict(zip(cols.tolist(), values.tolist(), strict=True)), 20: 1.0}
            w = {(i, c): weight(i, c) for i in x for c in range(3)}
            m = [sum(v * w[i, c] for i, v in x.items()) for c in range(3)]
            e = [math.exp(v - max(m)) for v in m]
            for i, v in x.items():
                for c in range(3):
                    d = (e[c] / sum(e) - (c == y)) * v
                    z[i][c] += d - (math.sqrt(n[i][c] + d * d) - math.sqrt(n[i][c])) / a * w[i, c]
                    n[i][c] += d * d
    got, bias = langid.fit_ftrl(examples, 3, 20, l1=l1)
    want = np.array([[weight(i, c) for c in range(3)] for i in range(21)])
    assert np.allclose(got, want[:20], atol=1e-12) and np.allclose(bias, want[20], atol=1e-12)
    assert (got == 0).any()


def test_votes_equal_plain_cosines():
    texts = texts_of(EN, 40, 3) + [" ".join([w] * 6) for w in EN]
    dims = 256
    df = np.ones(dims + quality.REPEATS)
    idf = langid.inverse(df, len(texts)).astype(np.float32)
    space = quality.latent_space(quality.features(texts, idf), 8)
    known, labels = quality.project(texts, idf, space), np.array([1.0] * 40 + [0.0] * len(EN))
    model = quality.NeighbourModel(idf, space, known, labels, labels.mean(), 5)
    asked = texts[::7] + ["", "zz", texts[0], texts[0]]
    got = model.scores(asked)
    for i, x in enumerate(quality.project(asked, idf, space)):
        cos = [float(np.dot(x.astype(np.float64), k.astype(np.float64))) for k in known]
        near = sorted(range(len(cos)), key=lambda j: -cos[j])[:5]
        total = sum(max(cos[j], 0) for j in near)
        want = sum(max(cos[j], 0) * labels[j] for j in near) / total if total else model.prior
        tied = abs(cos[near[-1]] - sorted(cos)[-6]) < 1e-5  # which of tied neighbours vote is open
        assert tied or abs(got[i] - want) < 1e-4
    assert got[-1] == got[-2]


def test_labelled_rows_are_never_dense_all_at_once(spark, monkeypatch):
    rows = list(enumerate(texts_of(EN, 900, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    peaks = []

    def here(self, f, schema):
        batches = self.toArrow().to_batches()
        tracemalloc.start()
        out = pa.Table.from_batches(f(iter(batches)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return spark.createDataFrame(out)

    monkeypatch.setattr(type(docs), "mapInArrow", here)
    model = quality.train(docs, labels)
    assert len(model.labels) == 900 and max(peaks) < 900 * len(model.idf) * 4

    # the space is that of the dense rows; which sign a vector has is open
    x = quality.features([t for _, t in rows], model.idf)
    sparse = quality.SparseRows([(np.flatnonzero(row), row[row != 0]) for row in x], x.shape[1])
    a, b = (quality.unit(x @ quality.latent_space(m, 8)) for m in (x, sparse))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-3) and all(np.array_equal(p, q) for p, q in zip(np.split(x, [256, 512, 768]), sparse, strict=True))


def test_very_long_texts_have_whole_sets():
    r = random.Random(2)
    long = " ".join(f"W{r.randint(0, 30000)}" for _ in range(110_000))  # over 512 kB
    one = "x" * 600_000 + " a b c d e"
    column = pa.array([long, "a b", long + " tail", one, None, "y" * 700_000])
    sets = []
    for _, s, ends in shingle_sets(column):
        a = 0
        for b in ends.tolist():
            sets.append(s[a:b])
            a = b
    assert [len(s) for s in sets] == [len(shingles(t)) for t in column.to_pylist()]
    assert len(np.intersect1d(sets[0], sets[2])) == len(shingles(long))


def test_signatures_never_say_too_much():
    g = np.random.default_rng(4)
    for n in (5, 60, 700, 9000):
        x = np.unique(g.integers(0, 1 << 62, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[n // 5 :], g.integers(0, 1 << 62, n // 7, dtype=np.uint64)]))
        true = len(np.setxor1d(x, y))
        assert 0 < ngram_join.apart(ngram_join.signature(x), ngram_join.signature(y)) <= true
        assert ngram_join.apart(ngram_join.signature(x), ngram_join.signature(x)) == 0


def test_blocks_join_what_brute_force_joins():
    r, g = random.Random(6), np.random.default_rng(6)
    base = g.integers(0, 1 << 62, 120, dtype=np.uint64)
    sets = []
    for _ in range(60):
        x = base.copy()
        at = r.sample(range(120), r.randint(0, 14))
        x[at] = g.integers(0, 1 << 62, len(at), dtype=np.uint64)
        sets.append(np.unique(x[: r.randint(100, 120)]))
    rank = np.zeros(1 << ngram_join.SKETCH_BITS, dtype=np.uint16)
    every = np.unique(np.concatenate(sets))
    label, n = np.arange(60), len(sets)
    ones, halves = np.zeros(n, dtype=int), np.arange(n) % 2

    def groups(pairs):
        comp = list(range(n))
        for a, b in pairs:
            comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
        return comp

    near = [(a, b) for a in range(n) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    core = np.ones(n, dtype=bool)
    got = ngram_join.compare_blocks(sets, core, ones, label, every, rank)
    assert groups(got) == groups(near) and set(map(tuple, map(sorted, got))) <= set(map(tuple, map(sorted, near)))
    across = ngram_join.compare_blocks(sets, core, halves, label, every, rank)
    assert all(a % 2 != b % 2 for a, b in across) and groups(across) == groups([p for p in near if p[0] % 2 != p[1] % 2])
    assert not ngram_join.compare_blocks(sets, ~core, ones, label, every, rank)
    assert not ngram_join.compare_blocks(sets, core, ones, label, every[:0], rank)


def test_undecided_nodes_hold_every_near_pair():
    r, g = random.Random(8), np.random.default_rng(8)
    for n in (3, 40, 300, 5000):
        base, sets = g.integers(0, 1 << 62, n, dtype=np.uint64), []
        for k in range(40):
            x = base.copy() if k < 20 else g.integers(0, 1 << 62, n, dtype=np.uint64)
            x[: r.randint(0, n // 6)] += np.uint64(k + 1)
            sets.append(np.unique(x[: r.randint(n - n // 7, n)]))
        sizes, signs = np.array([len(s) for s in sets]), [ngram_join.signature(s) for s in sets]
        label, core, block = np.arange(40) % 30, np.arange(40) % 3 > 0, np.arange(40) % 2
        for b in (block, block * 0):
            near = {x for i in range(40) for j in range(i) if label[i] != label[j] and (core[i] or core[j]) and (b[i] != b[j] or not b.any()) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) for x in (i, j)}
            got = set(ngram_join.undecided(sizes, core, b, label, signs).tolist())
            assert near and near <= got and (n < 40 or got <= set(range(20)))
        assert not len(ngram_join.undecided(sizes, core, block, label * 0, signs)) and not len(ngram_join.undecided(sizes, core & False, block, label, signs))


def test_whole_sets_go_only_to_blocks_with_a_near_pair(spark, monkeypatch):
    r, words = random.Random(9), [f"{a}{b}" for a in EN for b in EN]
    passages = [" ".join(r.choice(words) for _ in range(40)) for _ in range(24)]
    # long lists of texts that share passages and are not near, and three that are
    rows = [(i, " ".join(r.sample(passages, 8))) for i in range(70)]
    rows += [(100 + k, " ".join([*rows[0][1].split()[: 320 - 2 * k], *[f"x{k}y{m}" for m in range(2 * k)]])) for k in (1, 2, 3)]
    saved, save = [], ngram_join.Scratch.save

    def noted(self, df, name):
        out = save(self, df, name)
        saved.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join.Scratch, "save", noted)
    monkeypatch.setattr(ngram_join, "PIVOTS", 0)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).documents.collect()
    _, want = brute_components(rows)
    assert {x.doc_id: x.component_id for x in got} == want and want[103] == 0
    assert max(n for name, n in saved if name == "homes") > 70 and [n for name, n in saved if name == "sets"][-1] < 10


def test_top_k_over_a_grid_with_bars(spark, monkeypatch):
    v = vectors(spark, sample_vectors() + sample_vectors()[:20])  # repeated rows count each
    asked = v.where("vec_id % 20 = 0")
    plain = sorted(map(tuple, topk.top_k(v, asked, 7).collect()))
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 200)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 2)
    assert sorted(map(tuple, topk.top_k(v, asked, 7, query_block=2, candidate_block=32).collect())) == plain
    ids = [(q, i) for q, _, i, _ in plain]
    assert len(ids) == len(set(ids)) + sum(n - 1 for n in Counter(ids).values()) and max(Counter(ids).values()) == 2 and max(r for _, r, _, _ in plain) == 7


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    there = SimpleNamespace(get=lambda key, default=None: "hdfs://x/y/")
    assert shared_dir(SimpleNamespace(conf=there)) == "hdfs://x/y"


COLUMNS = {
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", COLUMNS)
def test_queries_have_their_columns_and_all_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    ids = {r.doc_id for r in df.select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
