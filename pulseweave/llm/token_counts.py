"""Operator 5: token counts.

Batch encoding in Arrow functions that return lengths only.  Texts are split
at white space, which no token of the word tokenizer crosses, so one very long
text is many small encodings.  Chunks that come again are encoded once for each
worker and their lengths remembered; what else a text holds is encoded in
batches of about equal bytes.

Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted each
on its own.  An empty table gives an empty table.  A column that already has
the name of an output column is replaced.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths remembered by a worker, by tokenizer file; cleared when full, which changes no result.
MEMORY = 400_000
BATCH_BYTES, SLICE_BYTES = 1 << 18, 4 << 20
_SPACE = re.compile(r"[ \t\n\r\v\f]+")
_lengths: dict[str, dict[str, int]] = {}
_library: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _library:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _library[path] = t
    return _library[path]


def _size(text: str) -> int:
    """Bytes of a text."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _encode_lengths(path: str, chunks: list[str]) -> list[int]:
    """Lengths by the library, in batches of at most BATCH_BYTES bytes (or one chunk)."""
    tokenizer, out, batch, held = _tokenizer(path), [], [], 0
    for c in chunks:
        size = _size(c)
        if batch and held + size > BATCH_BYTES:
            out += map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False))
            batch, held = [], 0
        batch.append(c)
        held += size
    if batch:
        out += map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False))
    return out


def _chunks(text: str) -> list[str]:
    # str.split() also splits at these four, which the tokenizer does not take for white space
    odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _SPACE.split(text.strip(" \t\n\r\v\f")) if odd else text.split()


def count_texts(path: str, texts: list[str | None]) -> list[int]:
    """Tokens of each text, as the library would count the whole text.

    White space is never part of a token here and composes with nothing under
    NFC, so the count of a text is the sum over its white-space chunks, in
    any order.
    """
    known = _lengths.setdefault(path, {})
    get, totals, unseen = known.get, [], []
    for t in texts:
        chunks = _chunks(t) if t else []
        found = list(map(get, chunks))
        rest = [c for c, n in zip(chunks, found, strict=True) if n is None]
        totals.append(sum(filter(None, found)))
        unseen.append(rest)
    # what comes again is encoded by itself and remembered; the rest of a text is one encoding
    again = [c for c, n in Counter(chain.from_iterable(unseen)).items() if n > 1]
    if len(known) + len(again) > MEMORY:
        known.clear()
    lengths = dict(zip(again, _encode_lengths(path, again), strict=True))
    known.update(lengths)
    once = [" ".join([c for c in rest if c not in lengths]) for rest in unseen]
    some = [i for i, x in enumerate(once) if x]
    for i, n in zip(some, _encode_lengths(path, [once[i] for i in some]), strict=True):
        totals[i] += n
    return [n + sum(lengths[c] for c in rest if c in lengths) for n, rest in zip(totals, unseen, strict=True)]


def token_counter(path: str):
    """An Arrow-batched column function: text to its number of tokens."""

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out, at = batch.tolist(), [], 0
            while at < len(texts):  # slices of about equal bytes bound what is held as chunks
                end, held = at, 0
                while end < len(texts) and (held == 0 or held < SLICE_BYTES):
                    held += _size(texts[end] or "")
                    end += 1
                out += count_texts(path, texts[at:end])
                at = end
            yield pd.Series(out, dtype="int64")

    return n_tokens


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to every row of ``docs``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "n_bytes": F.octet_length(whole).cast("long"),
            "n_tokens": token_counter(tokenizer_path)(whole),
        }
    ).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
