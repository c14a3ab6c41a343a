"""Conversation repair, BPE and ranked search against plain forms of them."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pulseweave.llm import bpe, lexical, queries, repair

WORD = public_tokenizers.path("word_bpe_49k.json")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation in order."""
    seen, codes, faults = set(), [], Counter()
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        codes.append(fault)
    best = {"": (0, "", [])}  # by the roles so far, shortened to what matters
    short = lambda s: s if len(s) < 2 else s[-1]

    def better(d, k, v):
        if k not in d or v[:2] < d[k][:2]:
            d[k] = v

    def inserted(d):
        out = dict(d)
        for _ in range(2):
            for s, (c, a, m) in list(out.items()):
                r = "assistant" if s.endswith("u") else "user"
                better(out, short(s + r[0]), (c + 3, a + "I", m + [r + ":"]))
        return out

    for (_, role, text), fault in zip(rows, codes, strict=True):
        new = {}
        for s, (c, a, m) in inserted(best).items():
            better(new, s, (c + 4, a + "D", m))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            i = role[:1]
            if (i == "s" and s == "") or (i == "u" and not s.endswith("u")) or (i == "a" and s.endswith("u")):
                better(new, short(s + i), (c + more, a + "K", m + [f"{role}:{text}"]))
            r = "assistant" if s.endswith("u") else "user"
            better(new, short(s + r[0]), (c + 3 + more, a + "R", m + [f"{r}:{text}"]))
        best = new
    c, a, m = min((v for s, v in inserted(best).items() if s == "" or s.endswith("a")), key=lambda v: v[:2])
    roles = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:], strict=False))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, c, a, hashlib.sha256("\n".join(m).encode()).hexdigest())


def rows_of(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, ""]
    texts = ["Hello.", "Why?", "no end", " ", "", None, "Fine!  ", "more. . x", "Ünï.\n", *(f"T{i}." for i in range(30))]
    out = []
    for c in [None, *range(n)]:
        for _ in range(r.choice([1, 2, 5, 9, 25])):
            out.append((c, r.choice([None, *range(8)]), r.choices(roles, [6, 6, 2, 1, 1, 1])[0], r.choice(texts)))
    return out + out[:7]


def key(row):
    return (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode())


@pytest.mark.parametrize("segment", [3, 4096])
def test_repair_equals_the_plain_search(spark, segment):
    rows = rows_of(5, 60)
    df = spark.createDataFrame([(*x, "e", 1) for x in rows], "conv_id long, turn long, role string, text string, seg string, audit int")
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    fixed = repair.repair(df.repartition(3), segment=segment)
    numbers = {r.conv: tuple(r[1:]) for r in fixed.conversations.collect()}
    audits = {r.conv: (r.audit, r.repaired_sha256) for r in repair.digests(fixed.segments).collect()}
    assert numbers.keys() == audits.keys() == convs.keys()
    for c, said in convs.items():
        assert (*numbers[c], *audits[c]) == plain_repair(sorted(said, key=key)), c
    said = fixed.messages().orderBy("conv", "seg", "place").collect()
    for c, (_, digest) in audits.items():
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in said if m.conv == c).encode()).hexdigest() == digest


def test_repair_of_one_hot_conversation_and_of_nothing(spark):
    r = random.Random(3)
    rows = [(1, i, r.choice(["user", "assistant", "system"]), r.choice(["yes.", f"m{i}!", f"m{i}", ""])) for i in range(900)] + [(1, 5, "user", "again.")] * 400
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    fixed = repair.repair(df, segment=16)
    want = plain_repair(sorted([x[1:] for x in rows], key=key))
    assert tuple(fixed.conversations.first()[1:]) == want[:6]
    assert tuple(repair.digests(fixed.segments).first()[1:]) == want[6:]
    empty = repair.repair(df.where("conv_id = 2"))
    assert empty.conversations.count() == 0 and repair.digests(empty.segments).count() == 0 and empty.messages().count() == 0


def test_damaged_conversations_that_vanish_are_returned(spark, tmp_path):
    rows = [(c, t, "user", "a.") for c in range(60) for t in range(2)] + [(None, None, None, None), (7, None, None, "x.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[1:]) for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert len(got) == 61
    for c, values in got.items():
        said = []
        for x, t, role, text in rows:
            if x != c:
                continue
            code = zlib.crc32(f"{' ' if x is None else x}:{' ' if t is None else t}".encode()) % 20
            role, text = role or " ", text or " "
            said += [] if code == 0 else [(t, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)] * (1 + (code == 3))
        assert values == (plain_repair(sorted(said, key=key)) if said else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))


TEXTS = [
    None, "", " ", "one", "Hello, World. it's 12345 <|startoftext|> x", "a<|endoftext|>.", "İstanbul ΑΣ σας", "x\x85y \x1c\x1d z", "é ́ q", "日本語 テスト 　 a", "a\n\n b\t c  d", "ß. ŉ ª ² ¼",
    "𝔘𝔫 😀😀", "word " * 5000, "x" * 9000, "abcde" * 3000 + " " + "Zz" * 2000, "Ɤx \U00010d50.", "don't we'll I'VE", "one",
]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, monkeypatch):
    lib = library()
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS)], "doc_id long, text string, node string")
    rows = bpe.decode(bpe.encode(df, WORD), WORD).collect()
    assert [r.node for r in rows] == ["e"] * len(TEXTS)
    for r in rows:
        want = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.where("doc_id < 0"), WORD).count() == 0
    odd = spark.createDataFrame([(0, None), (1, []), (2, [320, None, 99999, -1, 49407])], "i int, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, WORD).orderBy("i").collect()] == [None, "", "a</w> <|endoftext|>"]


def test_rank_arrays_and_heap_agree_and_full_memories_change_nothing(monkeypatch):
    lib, r, v = library(), random.Random(4), bpe.Vocabulary(WORD)
    words = ["".join(r.choices("abcdethrsnéß日", k=r.randint(1, 90))) for _ in range(400)]
    assert bpe.merge_words(v, words) == [bpe.merge_long(v, w.encode()) for w in words]
    monkeypatch.setattr(bpe, "MEMORY", 50)
    monkeypatch.setattr(bpe, "SLICE", 300)
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(60)] + [t for t in TEXTS if t]
    for t, ids in zip(texts, bpe.encode_texts(v, texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert len(v.chunk_ids) < 800


def plain_rank(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    N, L = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, found = set(words(text)), []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k_ + 1, None if none else i, -s) for k_, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def test_search_equals_the_plain_ranking(spark, monkeypatch):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "x_y", "日本", "a-b"]
    text = lambda n: " ".join(r.choices(vocab, [1 / (1 + i) for i in range(len(vocab))], k=n))
    docs = [(i, text(r.randint(1, 60))) for i in range(400)] + [(5, "w1 w1"), (5, "w1 w1"), (None, "w2 w3 日本"), (9, None), (10, ""), (11, " .,;"), (12, "W1 " * 3000)]
    items = [(i, text(r.randint(1, 12))) for i in range(15)] + [(3, "w7 w7 W7"), (None, "w1"), (20, None), (21, "zzz"), (22, "")]
    d = spark.createDataFrame([(*x, "e", 1) for x in docs], "doc_id long, text string, item_id string, score int").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    show = lambda rows: sorted(map(str, rows))
    want = show(plain_rank(docs, items, 7))
    assert show(tuple(x) for x in lexical.rank(d, q, 7).collect()) == want
    monkeypatch.setattr(lexical, "QUERY_BYTES", 200)  # several groups
    assert show(tuple(x) for x in lexical.rank(d, q, 7).collect()) == want
    assert lexical.rank(d.where("doc_id < 0"), q, 7).count() == 0 and lexical.rank(d, q.where("item_id < 0"), 7).count() == 0


def test_bounds_hold_and_long_texts_are_whole(monkeypatch):
    g = np.random.default_rng(1)
    tf, m = g.integers(1, 5000, 4000), g.integers(50, 100000, 4000)
    exact = lexical.saturated(tf, m)
    byte = -(-exact // lexical.STEP)
    assert byte.max() <= 255 and (byte * lexical.STEP >= exact).all() and ((byte - 1) * lexical.STEP < np.maximum(exact, 1)).all()
    text = b" ".join(b"t%d" % i for i in g.integers(0, 50, 5000))
    number = {b"t%d" % i: i for i in range(50)}
    whole = lexical.counts(text, number)
    monkeypatch.setattr(lexical, "WINDOW", 100)
    assert lexical.counts(text, number) == whole


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_bpe_query_equals_the_library_on_every_text(spark):
    lib = library()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: tuple(r[1:]) for r in queries.op12_bpe(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
