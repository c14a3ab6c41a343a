import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.llm import chat, embed_dedup, mixing, topk, url_filter
from pulseweave.llm.queries import URL_RULES


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int, score string")


def sample_vectors(n=300, d=8, seed=1):
    g = np.random.default_rng(seed)
    x = g.standard_normal((n, d)).astype(np.float32)
    x[1::7] = x[0::7][: len(x[1::7])] + 0.02 * g.standard_normal((len(x[1::7]), d)).astype(np.float32)
    x[200:240] = x[200] + 0.01 * g.standard_normal((40, d)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], int(i % 3 == 0) if not 200 <= i < 240 else 1, None, None) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1, None, None), (901, [0.0] * d, 1, None, None), (902, [nan] * d, 1, None, None), (903, [None] * d, 1, None, None), (904, [inf] + [1.0] * (d - 1), 1, None, None), (905, [1.0] * d, None, None, None)]
    rows += [(906, rows[5][1], rows[5][2], None, None)]  # an exact copy
    return rows


def test_top_k_equals_brute_force(spark):
    rows = sample_vectors()
    v = vectors(spark, rows)
    got = topk.top_k(v, v.where(F.col("vec_id") % 100 == 0), 10, query_block=2, candidate_block=64).collect()
    ok = {i: [math.floor(1024 * x) for x in e] for i, e, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    exp = []
    for q in (i for i in ok if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], c, strict=True)), i) for i, c in ok.items() if i != q)[:10]
        exp += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(exp)
    assert topk.top_k(v, v.where("false")).count() == 0 and topk.top_k(v.where("false"), v.where("vec_id = 0")).count() == 0


def test_search_block_keeps_ties_and_large_numbers():
    c = np.array([[3, 3, 1, 3]], dtype=np.int64)
    (q, ids, scores), = topk.search_block(np.array([[2]]), c, 2, np.array([9]), np.array([7, 5, 6, 9]))
    assert (q, ids.tolist(), scores.tolist()) == (9, [5, 7], [6, 6])
    big = np.full((2, 3), 1 << 40, dtype=np.int64)
    big[0, 1] += 1
    (_, ids, scores), = topk.search_block(big[:, :1], big, 2, np.array([0]), np.array([0, 1, 2]))
    assert ids.tolist() == [1, 2] and int(scores[0]) - int(scores[1]) == 1 << 40


def brute_links(rows):
    ok = [(i, np.array(e, float), y) for i, e, y, *_ in rows if e is not None and y is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    n, comp = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    for a, x, y in ok:
        for b, z, w in ok:
            if a < b and y == w and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= 0.93:
                n[a] += 1
                n[b] += 1
                p, q = sorted((comp[a], comp[b]))
                comp = {k: p if v == q else v for k, v in comp.items()}
    return n, comp


def test_near_dedup_recall_and_precision(spark):
    rows = sample_vectors()
    got = embed_dedup.near_duplicates(vectors(spark, rows))
    n, comp = brute_links(rows)
    out = got.vectors.collect()
    assert len(out) == len(rows) and got.recall >= 0.9
    found, true = sum(r.n_links for r in out), sum(n.values())
    assert 0.95 * true <= found <= true
    assert np.mean([r.component_id == comp[r.vec_id] for r in out]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert all((r.n_links, r.kept) == (0, True) for r in out if 900 <= r.vec_id <= 905)


def brute_counts(x):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    return (u @ u.T >= 0.93).sum(axis=1) - 1


def dense_vectors(n, d, spread, seed=3):
    """A group whose pairs lie about the threshold, few of them within half its angle."""
    g = np.random.default_rng(seed)
    x = g.standard_normal(d) / math.sqrt(d) + spread * g.standard_normal((n, d)) / math.sqrt(d)
    return x.astype(np.float32)


def test_near_dedup_of_a_dense_group(spark):
    x = dense_vectors(400, 32, 0.22)
    true = brute_counts(x)
    assert true.mean() > 300
    got = embed_dedup.near_duplicates(vectors(spark, [(i, [float(v) for v in x[i]], 1, None, None) for i in range(len(x))])).vectors.collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(true.tolist()))
    assert {r.component_id for r in got} == {0}


def test_near_dedup_compares_all_where_the_descent_fails(spark, monkeypatch):
    # no candidates at all, in any try: the audit is what must notice
    blocks = embed_dedup._from_blocks
    monkeypatch.setattr(embed_dedup, "_from_blocks", lambda *a: blocks(*a).where("false"))
    monkeypatch.setattr(embed_dedup, "_open", lambda edges, radius, theta: radius.where("false").selectExpr("id", "0L n", "0 k"), raising=False)
    x = np.random.default_rng(5).standard_normal((600, 16)).astype(np.float32)
    x[1::2] = x[0::2] + 0.28 * np.random.default_rng(6).standard_normal((300, 16)).astype(np.float32)
    got = embed_dedup.near_duplicates(vectors(spark, [(i, [float(v) for v in x[i]], 1, None, None) for i in range(len(x))]))
    true = brute_counts(x)
    assert got.recall >= embed_dedup.RECALL and true.sum() > 400
    assert {r.vec_id: r.n_links for r in got.vectors.collect()} == dict(enumerate(true.tolist()))


def test_lists_of_wide_balls_stay_open(spark):
    # the only entry cannot link, but a farther ball as wide as the list's own could
    edges = spark.createDataFrame([(1, 2, math.cos(0.55), 1), (2, 1, math.cos(0.55), 1)], "u long, v long, s double, k int")
    radius = spark.createDataFrame([(1, 0.15), (2, 0.0)], "id long, radius double")
    assert [r.id for r in embed_dedup._open(edges, radius, math.acos(0.93)).collect()] == [1]


def test_near_dedup_of_nothing(spark):
    assert embed_dedup.near_duplicates(vectors(spark, [])).vectors.count() == 0


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7/x?q#f", "http://a.example.com/en/8", "http://notexample.com/en/7", "http://x.net/de/1", "http://b.example.net/de/81", "http://o.org/es/", "http://o.org/es", "http://adult-x.biz/", "x://y.net://z/de/", "http://com/en/"]
    p = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in url_filter.judge(p, URL_RULES).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate([*urls, urls[4]]):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = rest[:cut].lower()
            path = rest[cut:].split("?")[0].split("#")[0]
        fit = [(h + q, v) for h, q, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, "block" if "adult" in host else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)


def test_rotation_masks_read_back(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 70, "ann", "late"), (2, 0, None, "who"), (3, 0, "system", "alone"), (None, 1, "x", "y"), (4, None, "x", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    got = chat.rotate(d).collect()
    assert sorted((r.conv_id, r.perspective, r.segment) for r in got) == [(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (2, "unknown", 0)]
    for r in got:
        own = [r.text[int(a) : int(b)] for a, b in (s.split("-") for s in r.target_spans.split(",") if s)]
        assert sum(map(len, own)) == r.n_target_chars
    first = next(r for r in got if (r.perspective, r.segment) == ("ann", 0))
    assert first.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n"
    assert (first.n_rows, first.n_messages) == (4, 3)
    assert chat.rotate(d.where("false")).count() == 0


def test_mixture_meets_its_targets(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(0, 40), "big" if i % 3 else f"s{i % 5}") for i in range(1500)] + [(9000, None, None), (9001, "a b", None), (9001, "a b", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n": F.lit("x"), "mix_rank": F.lit("old")})
    tokens = d.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n"))
    w = mixing.weights(tokens, evenness=0.9, budget=1.0).collect()
    p = np.array([x.weight for x in w if x.weight > 0])
    assert abs(p.sum() - 1) < 1e-6 and abs(-(p * np.log(p)).sum() - 0.9 * math.log(len(p))) < 1e-5
    total = sum(x.n for x in w)
    got = mixing.mix(d, evenness=0.9).withColumn("t", mixing.words(F.col("text"))).collect()
    spent = {}
    for x in got:
        spent[x.source] = spent.get(x.source, 0) + x.t
    for x in w:
        if x.n:
            assert spent.get(x.source, 0) <= x.weight * total + 1e-6
            assert spent.get(x.source, 0) >= x.weight * total - max(4, x.n / 10)  # to within a block
    # a block is whole in a pass, and a pass is a permutation
    seen = {}
    for x in got:
        seen.setdefault((x.source, x.mix_epoch, x.mix_block), x.mix_rank)
        assert seen[x.source, x.mix_epoch, x.mix_block] == x.mix_rank
    cover = mixing.mix(d, max_repetition=2.0, budget="cover").groupBy("doc_id", "text").count().collect()
    assert len(cover) == 1502 and max(x["count"] for x in cover if x.doc_id != 9001) <= 2
    assert mixing.mix(d.where("false"), evenness=0.9).count() == 0


def test_cover_passes_the_smallest_source(spark):
    tokens = spark.createDataFrame([("big", 8_000_000_000), ("tiny", 1), ("small", 20), (None, 0)], "source string, n long")
    got = {r.source: r for r in mixing.weights(tokens, max_repetition=2.0, budget="cover").collect()}
    assert all(r.epochs >= 1 for r in got.values())
    assert all((r.epochs + r.rest / r.n) <= 2.000001 for r in got.values() if r.n)


def test_mixing_with_clashing_columns_and_without_a_limit(spark):
    from pulseweave.llm import mixing

    rows = [(i, "a b c", f"s{i % 3}", i, i, i, i) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _at int, _MIX int, block int, epoch int")
    got = mixing.mix(d, max_repetition=2.0)
    assert all(r._at == r._MIX == r.block == r.epoch == r.doc_id for r in got.collect()) and got.columns[-4:] == list(mixing._NEW)
    tiny = spark.createDataFrame([(0, "a", "t", ), *((i, "b " * 20000, "big") for i in range(1, 5))], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="max_repetition"):
        mixing.mix(tiny, evenness=1.0)
