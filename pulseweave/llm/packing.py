"""Operator 3: best-fit packing.

Bounded-space online best-fit: a fixed number of open bins, found through a
bitset keyed by free space.  A piece goes to the bin with the least free space
that holds it; when all bins are open, the fullest closes first.

Pieces of a partition arrive in runs of about RUN pieces drawn by hash, in
falling order of length within a run, so that long pieces open bins that the
short ones behind them fill; a run makes more part-filled bins than may be
open, so the fullest of earlier runs close.

Documents become token ids and one closing id 0.  Only documents longer than
the capacity are cut, into whole capacities behind a first piece that may be
shorter.  Tokenizing is one Arrow pass over the texts; only lengths and check
sums are shuffled, into partitions of bounded size that pack on their own.

Null text counts as empty (one token, the closing id).  Repeated rows are
packed each on its own; pieces of equal length go by doc_id and piece.  An
empty table gives an empty table.  Columns besides id and text play no part.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

CAPACITY = 2048
OPEN_BINS = 4096
RUN = 6000
PIECES_A_PARTITION = 200_000
END = (0).to_bytes(4, "little")
#: The split rule that the tokenizer file names (its byte-level pre-tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII and the Latin letters, whose classes no library sees differently.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7e\xa1-ɏ]*\Z")


class ByteEncoder:
    """Ids as the tokenizer library gives them.

    Text of the characters in _PLAIN without special strings goes to a faster
    library with the same vocabulary; all other text goes to the tokenizer
    library itself, whose classes of rare characters may differ.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.special = tuple(special)
        # another split rule in the file means that only the library knows it
        self.known = self._split_rule(path) == PATTERN
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _split_rule(path: str) -> str | None:
        """The pattern that a file's pre-tokenizer splits by; None if it is of another kind."""
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        before = config.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        return PATTERN if plain and not config.get("normalizer") else None

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if self.known and _PLAIN.match(text) and not any(s in text for s in self.special):
            ids = self.core(text)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: a shorter first one, then whole ones."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            keys, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            sizes = np.asarray(pc.binary_length(texts).fill_null(0))
            while at < len(keys):
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), 4 << 20)))
                cols: list[list] = [[] for _ in range(5 + with_ids)]
                for key, raw in zip(keys[at:end], texts.slice(at, end - at).to_pylist(), strict=True):
                    raw = encode(raw or "") + END
                    for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                        part = raw[4 * s : 4 * (s + n)]
                        row = (key, k, s, n, zlib.crc32(part), *([np.frombuffer(part, "<u4").tolist()] if with_ids else []))
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])
                at = end

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, schema)


class OpenBins:
    """A fixed number of open bins by free space, with a bitset of the free spaces at hand."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.open, self.made, self.bits = capacity, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return got

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece; the bin closes when full."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_, offset = self._take(free), self.capacity - free
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, offset, free = self.made, 0, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, offset


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, partitions: int = 1, runs: int = 1) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (at most the capacity)."""
    from pyspark import TaskContext

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            got = [bins.place(n) for n in batch.column("length").to_pylist()]
            new = [pa.array([base + b for b, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "sequence_id", "offset"])

    run = F.pmod(F.xxhash64("doc_id", "piece", F.lit(1)), F.lit(max(1, runs)))
    spread = pieces.repartition(partitions, "doc_id", "piece").sortWithinPartitions(run, F.desc("length"), "doc_id", "piece")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return spread.mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenizes, then packs in partitions of about PIECES_A_PARTITION pieces; each partition leaves few bins part-filled."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(tokenize(docs, tokenizer_path, id_col=id_col, text=text, capacity=capacity), "pieces")
    n = pieces.count()
    partitions = 1 + n // PIECES_A_PARTITION
    return pack(pieces, capacity=capacity, open_bins=open_bins, partitions=partitions, runs=1 + n // partitions // RUN)
