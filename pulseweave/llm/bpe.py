"""Operator 12: BPE encoding and decoding.

Contiguous rank array.  A word is a row of parts (token ids, at first one for
each byte, the last one with the word's end) beside the ranks of its adjacent
pairs.  The minimum of the ranks is scanned for again and again; its boundary
is deleted, and the ranks left and right of the new part are looked up anew.
Words of about equal length are rows of one matrix, so a step scans, deletes
and refreshes for all of them at once.  Words of more than SHORT bytes go by a
heap over linked parts, since scanning is quadratic; both take the leftmost of
equal ranks, as the library does.

Texts are split at white space, which no token crosses, and special strings
(the file's added tokens) are cut out before anything else.  What a worker has
encoded is remembered by chunk and by word; a full memory is emptied, which
changes no result.  Long texts are encoded in windows that end at white space.

Null text counts as empty: no ids.  Null ids decode to null, null elements and
ids outside the vocabulary are left out as the library leaves them out.
Repeated rows are encoded each on its own.  An empty table gives an empty
table.  All columns are kept; one that has the name of the output is replaced.
Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from .textgrams import slices
from .token_counts import _chunks

SHORT = 96
#: Chunks, and words, that a worker remembers.
MEMORY = 300_000
#: Characters of text that are held as chunks at a time.
SLICE = 1 << 20
_NONE = np.int32(0x7FFFFFFF)
_END = np.int32(-1).tobytes()
_tables: dict[str, Vocabulary] = {}


class Vocabulary:
    """A tokenizer file's tables: ids of bytes, ranks of pairs, texts of ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, added = j["model"], j["added_tokens"]
        normal = [(x["type"], x.get("pattern", {}).get("Regex")) for x in j["normalizer"]["normalizers"]]
        split, level = j["pre_tokenizer"]["pretokenizers"]
        known = (
            model["type"] == "BPE" and not (model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"] or model["unk_token"])
            and normal == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and split["behavior"] == "Removed" and split["invert"]
            and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"] and j["decoder"] is None
            and not any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
        )
        if not known:
            raise ValueError(f"{path} is not a word BPE file of the kind that is known here")
        vocab = model["vocab"]
        self.words = regex.compile(split["pattern"]["Regex"])
        self.lines = regex.compile(split["pattern"]["Regex"] + "|\n")
        self.special = {a["content"]: a["id"] for a in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        # printable bytes stand for themselves, the others for the characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in plain]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte = {c: b for b, c in sign.items()}
        self.path = path
        end = model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab[sign[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[sign[b] + end] for b in range(256)], dtype=np.int64)
        left, right, made = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])], dtype=np.int64).T
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        texts = vocab | self.special
        self.texts = pa.array([t for t, _ in sorted(texts.items(), key=lambda x: x[1])])
        self.known_ids = np.array(sorted(texts.values()), dtype=np.int64)
        self.chunk_ids: dict[str, bytes] = {}
        self.word_ids: dict[str, bytes] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """Its tables of characters serve where Python's are older."""
        return Tokenizer.from_file(self.path)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def first_parts(self, word: bytes) -> np.ndarray:
        b = np.frombuffer(word, np.uint8)
        parts = self.inner[b]
        parts[-1] = self.last[b[-1]]
        return parts


def vocabulary(path: str) -> Vocabulary:
    if path not in _tables:
        _tables[path] = Vocabulary(path)
    return _tables[path]


def merge_short(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids (int32 as bytes) of words of about equal length, all rows of one matrix."""
    out: list[bytes] = [b""] * len(words)
    width = max(map(len, words))
    size = np.array([len(w) for w in words])
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    parts = v.inner[raw]
    row, col = np.arange(len(words)), np.arange(width)
    parts[row, size - 1] = v.last[raw[row, size - 1]]
    ranks = np.full((len(words), width), _NONE, dtype=np.int32)
    ranks[:, :-1] = v.rank(parts[:, :-1], parts[:, 1:])
    ranks[col >= size[:, None] - 1] = _NONE
    place = row
    while len(place):
        at = ranks.argmin(axis=1)
        best = ranks[row[: len(place)], at]
        done = best == _NONE
        if done.any():
            for i, p, n in zip(place[done].tolist(), parts[done].astype(np.int32), size[done].tolist(), strict=True):
                out[i] = p[:n].tobytes()
            live = ~done
            parts, ranks, size, place, at, best = parts[live], ranks[live], size[live], place[live], at[live], best[live]
            if not len(place):
                break
        n = row[: len(place)]
        # delete the boundary behind ``at``: all that stands right of it moves left
        move = np.minimum(col + (col > at[:, None]), width - 1)
        parts, ranks = np.take_along_axis(parts, move, axis=1), np.take_along_axis(ranks, move, axis=1)
        ranks[:, -1] = _NONE
        parts[n, at] = v.made[best]
        size = size - 1
        here = parts[n, at]
        after, before = np.minimum(at + 1, width - 1), np.maximum(at - 1, 0)
        ranks[n, at] = np.where(at + 1 < size, v.rank(here, parts[n, after]), _NONE)
        ranks[n, before] = np.where(at > 0, v.rank(parts[n, before], here), ranks[n, before])
    return out


def merge_long(v: Vocabulary, word: bytes) -> bytes:
    """Ids of one word of any length: a heap of (rank, place) over linked parts."""
    parts = v.first_parts(word)
    first = v.rank(parts[:-1], parts[1:])
    p, made = parts.tolist(), v.made
    n = len(p)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at = np.flatnonzero(first != _NONE)
    heap = list(zip(first[at].tolist(), at.tolist(), parts[at].tolist(), parts[at + 1].tolist(), strict=True))
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def push(i: int, k: int) -> None:
        pair = (p[i], p[k])
        if pair not in known:
            known[pair] = int(v.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
        if known[pair] != _NONE:
            heapq.heappush(heap, (known[pair], i, *pair))

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if p[i] != a or j >= n or p[j] != b:
            continue  # one of its parts has been merged
        p[i], p[j] = int(made[r]), -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            push(i, k)
        if before[i] >= 0:
            push(before[i], i)
    return np.array([x for x in p if x >= 0], dtype=np.int32).tobytes()


def merge_words(v: Vocabulary, words: list[str]) -> list[bytes]:
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    out: list[bytes] = [b""] * len(words)
    order = sorted((i for i, b in enumerate(raw) if len(b) <= SHORT), key=lambda i: len(raw[i]))
    while order:
        width = len(raw[order[0]])
        n = next((k for k, i in enumerate(order) if len(raw[i]) > width + 3 + width // 4 or k >= 4096), len(order))
        for i, ids in zip(order[:n], merge_short(v, [raw[i] for i in order[:n]]), strict=True):
            out[i] = ids
        order = order[n:]
    for i, b in enumerate(raw):
        if len(b) > SHORT:
            out[i] = merge_long(v, b)
    return out


def _lower(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # a final sigma depends on its neighbours for str.lower(), but not for the tokenizer
    return "σ".join(part.lower() for part in text.split("Σ")) if "Σ" in text else text.lower()


def _pieces(v: Vocabulary, chunk: str) -> list[str | int]:
    """A chunk with special strings or odd characters as words and ids of special strings."""
    out: list[str | int] = []
    for x in v.cut.split(chunk) if v.cut is not None else [chunk]:
        if x in v.special:
            out.append(v.special[x])
        elif any(map(unassigned, x)):
            out += [bytes(map(v.byte.__getitem__, w)).decode() for w, _ in v.library.pre_tokenizer.pre_tokenize_str(v.library.normalizer.normalize_str(x))]
        else:
            out += v.words.findall(_lower(x))
    return out


@lru_cache(1 << 16)
def unassigned(sign: str) -> bool:
    """Characters that this Python's tables do not know; the library's may."""
    return unicodedata.category(sign) == "Cn"


def _word_ids(v: Vocabulary, words: list[str]) -> dict[str, bytes]:
    found = {w: v.word_ids.get(w) for w in words}
    new = [w for w, ids in found.items() if ids is None]
    new = dict(zip(new, merge_words(v, new), strict=True))
    found.update(new)
    if len(v.word_ids) + len(new) > MEMORY:
        v.word_ids.clear()
    v.word_ids.update(x for x in new.items() if len(x[0]) <= SHORT)
    return found


def encode_chunks(v: Vocabulary, chunks: list[str]) -> dict[str, bytes]:
    """Ids of distinct chunks."""
    odd = {c for c in set("".join(chunks)) if unassigned(c)}
    hard = [c for c in chunks if "<" in c and v.cut.search(c) or odd and not odd.isdisjoint(c)]
    plain = [c for c in chunks if c not in set(hard)] if hard else chunks
    # all plain chunks are one text; its lines tell the chunks apart
    words = v.lines.findall(_lower("\n".join(plain)))
    pieces = [_pieces(v, c) for c in hard]
    found = _word_ids(v, [w for w in words if w != "\n"] + [w for ws in pieces for w in ws if isinstance(w, str)])
    found["\n"] = _END
    ids = np.frombuffer(b"".join(map(found.__getitem__, words)), np.int32)
    ends = np.flatnonzero(ids == -1)
    raw, starts, ends = ids.tobytes(), [0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), 4 * len(ids)]
    out = dict(zip(plain, [raw[a:b] for a, b in zip(starts, ends, strict=True)], strict=True)) if plain else {}
    for c, ws in zip(hard, pieces, strict=True):
        out[c] = b"".join(np.int32(w).tobytes() if isinstance(w, int) else found[w] for w in ws)
    return out


def _windows(text: str) -> Iterator[str]:
    """Windows of about SLICE characters that end at white space."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end] not in " \t\n\r\v\f":
            end += 1
        yield text[at:end]
        at = end


def _encode_group(v: Vocabulary, texts: list[str | None]) -> list[bytes]:
    lists = [_chunks(t) if t else [] for t in texts]
    known = v.chunk_ids
    distinct = set().union(*lists)
    unseen = distinct.difference(known)
    if len(known) + len(unseen) > MEMORY:
        kept = {c: known[c] for c in distinct.intersection(known)}
        known.clear()
        known.update(kept)
    known.update(encode_chunks(v, list(unseen)))
    out = [b"".join(map(known.__getitem__, cs)) for cs in lists]
    for c in [c for c in unseen if len(c) > SHORT]:
        del known[c]
    return out


def encode_texts(v: Vocabulary, texts: list[str | None]) -> list[bytes]:
    """Ids (int32 as bytes) of each text."""
    out: list[bytes] = []
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end] or "") <= SLICE):
            held += len(texts[end] or "")
            end += 1
        if held > SLICE:  # one long text
            out.append(b"".join(_encode_group(v, [w])[0] for w in _windows(texts[at])))
        else:
            out += _encode_group(v, texts[at:end])
        at = end
    return out


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes or elements of a column (or one row), so that little of a batch is held as objects."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values) if pa.types.is_string(values.type) else pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes.astype(np.int64), most, len(batch)):
        yield batch.slice(a, b - a)


def _with(df: DataFrame, out: str, kind: str) -> tuple[StructType, list[str]]:
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    return StructType([*kept, *StructType.fromDDL(f"x {kind}").fields]), [f.name for f in kept]


def encode(docs: DataFrame, tokenizer_path: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text, array<int>."""
    schema, kept = _with(docs, out, "array<int>")
    schema.fields[-1].name = schema.names[-1] = out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer_path)
        for batch in batches:
            for some in _slices(batch, text, SLICE):
                ids = encode_texts(v, some.column(text).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))]))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), lists], [*kept, out])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer_path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that the library decodes every row's ids to, special tokens included."""
    schema, kept = _with(rows, out, "string")
    schema.fields[-1].name = schema.names[-1] = out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer_path)
        for batch in batches:
            for some in _slices(batch, ids, SLICE // 4):
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), decode_lists(v, some.column(ids))], [*kept, out])

    return rows.mapInArrow(run, schema)


def decode_lists(v: Vocabulary, lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.minimum(np.searchsorted(v.known_ids, ids), len(v.known_ids) - 1)
    known = v.known_ids[at] == ids
    owner = np.repeat(np.arange(len(sizes)), sizes)[known]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]).astype(np.int32)
    texts = pa.ListArray.from_arrays(pa.array(ends), v.texts.take(pa.array(at[known])))
    return pc.if_else(pc.is_valid(lists), pc.binary_join(texts, " "), None)


def joined(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
