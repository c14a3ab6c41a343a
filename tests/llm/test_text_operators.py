import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pulseweave.llm import langid, ngram_join, packing, quality, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "one", "Hello, World. it's 12345 <|startoftext|> x", "a<|endoftext|>.", "İstanbul ΑΣ σας", "x\x85y \x1c\x1d z", "é ́ q", "日本語 テスト \u3000 a", "a\n\n b\t c  d", "ß. ŉ ª ² ¼",
    "𝔘𝔫 😀😀", "word " * 5000, "x" * 9000,
]
EN = "the of and to in is that it was for on are as with his they at be this from".split()
DE = "der die das und ist nicht ein eine mit auf für dem den von zu im werden sich auch".split()


def texts_of(words, n, seed):
    r = random.Random(seed)
    return [" ".join(r.choices(words, k=r.randint(5, 60))) for _ in range(n)]


def docs(spark, rows, schema="doc_id long, text string, lang string, source string, score string, node string"):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], schema)


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    d = docs(spark, list(enumerate(TEXTS)) + [(3, "one")])
    got = token_counts.count_tokens(d, WORD, limit=100).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        t = TEXTS[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100)


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE)
    more = texts_of(EN, 300, 1)
    rows = list(enumerate(TEXTS + more))
    got = packing.pack_documents(docs(spark, rows), BYTE).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert len(pieces) == -(-len(ids) // 2048)
        for k, r in enumerate(pieces):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(part))
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(bins) <= total / 2048 * 1.1 + 5  # one partly filled bin or so for each partition
    assert packing.pack_documents(docs(spark, []), BYTE).count() == 0


def test_open_bins_close_the_fullest_first():
    b = packing.OpenBins(10, 2)
    assert [b.place(n) for n in (6, 7, 4)] == [(0, 0), (1, 0), (0, 6)]
    assert b.place(8) == (2, 0)  # bin 1 (3 left) and bin 2 (2 left) are open
    assert b.place(9) == (3, 0)  # bin 2, the fullest, closes
    assert b.place(2) == (1, 7)


def shingles(t):
    w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return ({tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if w else set()


def brute_components(rows):
    s = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in s}
    changed = True
    while changed:
        changed = False
        for a in s:
            for b in s:
                if a < b and s[a] and s[b] and comp[a] != comp[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return s, comp


@pytest.mark.parametrize("pivots", [0, 1, 4])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 8)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    r = random.Random(5)
    base = [f"w{r.randint(0, 400)}" for _ in range(60)]
    rows = list(enumerate(["", None, "a b c", "A B c", "a b", "  "] + [" ".join(base)] * 3))
    for k in range(60):  # variants of one text, and of a distant variant of it
        w = list(base if k % 3 else base[:40] + [f"v{i}" for i in range(20)])
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300 + k, t) for k, t in enumerate(texts_of(EN, 30, 2))]
    got = {x.doc_id: x for x in ngram_join.join(docs(spark, rows)).documents.collect()}
    sets, comp = brute_components(rows)
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), comp[i])
    assert ngram_join.join(docs(spark, [])).documents.count() == 0


def test_repeated_rows_are_one_group(spark):
    got = ngram_join.join(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (0, "a b c d e f"), (7, None)])).documents.collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (1, 0), (7, 7)]


def test_rows_without_ids_link(spark):
    t = texts_of([f"{a}{b}" for a in EN for b in EN], 1, 5)[0] + " " + " ".join(EN * 2)
    a, b, c = (" ".join(t.split()[i:]) for i in range(3))
    got = ngram_join.join(docs(spark, [(5, a), (None, b), (None, b), (9, c), (None, None)]))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got.documents.collect()) == [(0, 0), (0, 5), (0, 5), (5, 5), (9, 5)]
    alone = ngram_join.join(docs(spark, [(None, a), (None, b)]))
    assert alone.links.count() == 1


def test_language_held_out_accuracy_and_und(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts_of(EN, 150, 3))] + [(1000 + i, t, "de") for i, t in enumerate(texts_of(DE, 150, 4))]
    rows += [(5000, None, "en"), (5001, "123 !!", "de"), (5002, "", None)]
    d = docs(spark, rows).withColumn("held", langid.held_out(F.col("doc_id"), 5, 0))
    model = langid.train(d.where("not held"), sample=200)
    got = langid.detect(d, model).collect()
    assert len(got) == len(rows)
    known = [r for r in got if r.doc_id < 5000]
    assert np.mean([r.lang_pred == r.lang for r in known if r.held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id >= 5000)
    assert langid.train(d.where("false")) is None
    assert langid.detect(d, None).where("lang_pred <> 'und'").count() == 0


def test_quality_held_out_and_edges(spark):
    good, bad = texts_of(EN, 150, 6), [" ".join(f"{w}###" for w in t.split()) for t in texts_of(EN, 150, 7)]
    rows = [(i, t) for i, t in enumerate(good)] + [(1000 + i, t) for i, t in enumerate(bad)] + [(5000, None), (5001, "")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1 if i < 1000 else 0) for i, _ in rows if i < 5000 and i % 2] + [(1, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(d.drop("score"), quality.train(d, labels, rank=8)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    assert np.mean([(got[i] >= 0.5) == (i < 1000) for i in got if i < 5000 and i % 2 == 0]) > 0.97
    none = quality.train(d, labels.where("false"))
    assert none is None and quality.score(d.drop("score"), none).where("score <> 0.5").count() == 0
