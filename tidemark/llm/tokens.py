"""Encoding of text with the vocabulary of a public byte-level tokenizer.

A pre-tokenizer cuts the text into words; each distinct word is merged once per task and remembered in a bounded table.
A word's merges run over a segment tree: leaf i holds the rank of the pair that starts at byte i, every inner node the
leftmost minimum below it, so the next merge is read off the root and changes two neighbouring pairs, each by one walk
from leaf to root. A word of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import spread

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 400_000
REMEMBERED_BYTES = 64
SLICE_CHARS = 4_000_000


def load_ranks(name: str = "byte_bpe_50k", folder: str = FOLDER) -> dict[bytes, int]:
    """Token bytes to id, which is the merge rank as well."""
    lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: pairs are merged by least rank, the leftmost first."""
    n = len(word)
    if word in ranks:
        return [ranks[word]]
    if n == 1:
        return [ranks[word]]
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    none = (1 << 62) * 2
    tree = [none] * (2 * width)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        rank = get(word[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * n + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while (root := tree[1]) != none:
        i = root % n
        j = after[i]
        end = after[j]
        after[i] = end
        if j < n - 1:
            put(j, none)
        if end < n:
            before[end] = i
            rank = get(word[i : after[end]])
            put(i, none if rank is None else rank * n + i)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            rank = get(word[h:end])
            put(h, none if rank is None else rank * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def _encoder(vocabulary, column: str, keep: list[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks = vocabulary.value
        words = regex.compile(WORDS).findall
        known: dict[str, list[int]] = {}

        def ids_of(text: str | None) -> list[int]:
            out: list[int] = []
            add = out.extend
            for word in words(text) if text else ():
                ids = known.get(word)
                if ids is None:
                    raw = word.encode("utf-8")
                    ids = merge_word(raw, ranks)
                    if len(raw) <= REMEMBERED_BYTES:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = ids
                add(ids)
            return out

        for batch in batches:
            texts = batch.column(column)
            start = 0
            while start < batch.num_rows:
                flat: list[int] = []
                counts: list[int] = []
                stop, chars = start, 0
                while stop < batch.num_rows and (stop == start or chars < SLICE_CHARS):
                    text = texts[stop].as_py()
                    ids = ids_of(text)
                    flat.extend(ids)
                    counts.append(len(ids))
                    chars += len(text or "")
                    stop += 1
                offsets = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, np.int32)))
                piece = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], lists], names=[*keep, "ids"])
                start = stop

    return encode


def encode_texts(documents: DataFrame, keep: list[str], text: str, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """keep, ids: the token ids of each text, without special tokens, whose strings are ordinary text.

    Null and empty texts give the empty list; every row comes out once, repeated rows as often as they stand. The
    vocabulary (about 50,000 entries, fixed by the tokenizer) is broadcast, so executors need no files. Nothing is
    shuffled: the work is one pass over the scan.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(vocabulary, folder))
    rows = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = spread(rows).mapInArrow(_encoder(ranks, "text", names), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "ids")
