"""Evaluation passages inside a training corpus.

A passage is a run of `words` words of an item. Texts are compared as words in a normal form, joined by single spaces. By
the q-gram lemma a passage of m characters that stands in a document with at most k edits shares at least
m - q + 1 - k q of its q-grams with it, all on diagonals (place in the document less place in the item) that differ by
at most k. Shared q-grams are therefore counted in overlapping bands of diagonals, 2 (k + 1) wide and k + 1 apart, bands
that reach the least such bound over the item's passages are kept, and a banded alignment of the item's passages along
them settles the number of edits.

q is 12, or less for an item whose shortest passage would not be sure of a shared q-gram at 12.

The items are a stated query set. They are read a partition at a time, cut into parts that overlap by a passage less one
word, and indexed in blocks of at most BLOCK_CHARS characters, each a broadcast of bounded size. The corpus is read
once, without a shuffle: a task normalises and hashes a slice of texts once and probes all blocks with it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

#: The greatest of these that leaves an item's shortest passage a shared q-gram is its q.
QS = (12, 8, 5, 3, 2, 1)
WORDS = 12
BLOCK_CHARS = 2_000_000
PART_CHARS = 100_000
SLICE_CHARS = 500_000
#: Slices that a task holds while the blocks pass by, and blocks that stay in its memory.
SLICES, KEPT_BLOCKS = 8, 4
#: Shared q-grams that are laid out at a time; documents with more are cut into overlapping windows.
HITS = 500_000
TABLE_BITS = 22
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
#: Fixed value: characters that are not seen, besides those of category Cf.
_UNSEEN = re.compile("[͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️\U000e0100-\U000e01ef\x00-\x08\x0e-\x1b\x7f]")


def normal_words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC and case folding, without unseen characters; none of a null text."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(_UNSEEN.sub("", text).lower())
    seen = _UNSEEN.sub("", text)
    seen = "".join(c for c in seen if unicodedata.category(c) != "Cf") if not seen.isascii() else seen
    return _WORD.findall(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", seen).casefold()))


def joined(words: list[str]) -> str:
    """Words between single spaces, one at either end, so that whole words are compared."""
    return f" {' '.join(words)} " if words else ""


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram; equal hashes are checked by the alignment, so collisions cost time only."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    out = wide[:n].copy()
    for j in range(1, q):
        out *= MULTIPLIER
        out += wide[j : j + n]
    out ^= out >> np.uint64(29)
    return out * MULTIPLIER


def least_edits(passage: str, region: str, most: int) -> int:
    """Fewest edits between the passage and any stretch of the region, or most + 1.

    A banded alignment: a stretch that needs at most `most` edits leaves the diagonal of its start by no more than that,
    so row i is filled from column i - most to i + (difference of the lengths) + 2 most only.
    """
    if passage in region:
        return 0
    m, n = len(passage), len(region)
    over = most + 1
    if not most or n < m - most:
        return over
    row = [0] * (n + 1)
    for i, c in enumerate(passage, 1):
        low, high = max(1, i - most), min(n, i + n - m + 2 * most)
        last = row[low - 1]
        row[low - 1] = min(i, over) if low == 1 else over
        best = row[low - 1]
        for j in range(low, high + 1):
            here = last if c == region[j - 1] else 1 + min(last, row[j], row[j - 1])
            last, row[j] = row[j], min(here, over)
            best = min(best, row[j])
        if high < n:
            row[high + 1 :] = [over] * (n - high)
        if best >= over:
            return over
    return min(row)


class ItemIndex:
    """q-grams of a block of parts of items, sorted by hash, with a bit table that answers most lookups."""

    def __init__(self, items: list[tuple[int, list[str]]], q: int, words: int, edits: int):
        self.q, self.words, self.edits = q, words, edits
        self.ids, self.texts, self.starts = [], [], []
        hashes, owners, places, least = [], [], [], []
        for item, tokens in items:
            text = joined(tokens)
            starts, lengths = passages(tokens, words)
            grams = gram_hashes(codes_of(text), q)
            hashes.append(grams)
            owners.append(np.full(len(grams), len(self.ids), np.int64))
            places.append(np.arange(len(grams)))
            self.ids.append(item)
            self.texts.append(text)
            self.starts.append(np.stack([starts, lengths]))
            least.append(int(lengths.min()) - q + 1 - edits * q)
        flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owner = np.concatenate([*owners, np.empty(0, np.int64)])[order]
        self.place = np.concatenate([*places, np.empty(0, np.int64)])[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - TABLE_BITS)] = True
        self.least = np.array(least, np.int64)
        self.longest = max((int(s[1].max()) for s in self.starts), default=0)

    @classmethod
    def restored(cls, state: dict) -> ItemIndex:
        """An index from its broadcast state, which is plain data: workers need not be able to import this class."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def matches(self, texts: list[str], codes: np.ndarray | None = None, grams: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """(document, part, edits) of each document, in joined form, that carries a passage; both by their places.

        codes, grams: of the documents with line breaks between them, if they are known already."""
        codes = codes_of("\n".join(texts)) if codes is None else codes
        grams = gram_hashes(codes, self.q) if grams is None else grams
        edge = np.cumsum([0] + [len(t) + 1 for t in texts])
        at = np.flatnonzero(self.table[grams >> np.uint64(64 - TABLE_BITS)])
        low = np.searchsorted(self.hashes, grams[at], "left")
        many = np.searchsorted(self.hashes, grams[at], "right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        if not len(at):
            return
        document = np.searchsorted(edge, at, "right") - 1
        total = np.cumsum(many)
        first = 0
        while first < len(at):
            # whole documents up to HITS shared q-grams, or one that has more
            stop = int(np.searchsorted(total, (total[first - 1] if first else 0) + HITS, "right"))
            stop = int(np.searchsorted(document, document[stop], "left")) if stop < len(at) else stop
            if stop > first:
                yield from self._counted(texts, edge, at[first:stop], low[first:stop], many[first:stop], document[first:stop])
            else:
                doc = int(document[first])
                stop = int(np.searchsorted(document, doc, "right"))
                yield from ((doc, part, edits) for part, edits in self._dense(texts[doc]))
            first = stop

    def _dense(self, text: str) -> Iterator[tuple[int, int]]:
        """(part, edits) of a text that shares too many q-grams to lay out: cut into windows that overlap by more than
        any passage, and at their smallest aligned directly with each passage of the parts that share a q-gram."""
        width = self.longest + 4 * (self.edits + 1)
        found: dict[int, int] = {}
        if len(text) > 4 * width:
            half = len(text) // 2
            for piece in (text[: half + width], text[half - width :]):
                for _, part, edits in self.matches([piece]):
                    found[part] = min(edits, found.get(part, edits))
        else:
            grams = np.unique(gram_hashes(codes_of(text), self.q))
            low, high = np.searchsorted(self.hashes, grams, "left"), np.searchsorted(self.hashes, grams, "right")
            for part in sorted({int(o) for a, b in zip(low, high, strict=True) for o in np.unique(self.owner[a:b])}):
                best = self.edits + 1
                for passage in {self.texts[part][a : a + m] for a, m in self.starts[part].T.tolist()}:
                    best = min(best, least_edits(passage, text, best - 1))
                    if not best:
                        break
                if best <= self.edits:
                    found[part] = best
        yield from found.items()

    def _counted(self, texts: list[str], edge: np.ndarray, at: np.ndarray, low: np.ndarray, many: np.ndarray, document: np.ndarray) -> Iterator[tuple[int, int, int]]:
        where, document = np.repeat(at, many), np.repeat(document, many)
        hit = np.repeat(low, many) + np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
        part, place = self.owner[hit], self.place[hit]
        step = self.edits + 1
        band = (where - edge[document] - place) // step + (1 << 31)
        key = (document * len(self.ids) + part).astype(np.int64)
        # each hit counts in its own stripe of diagonals and in the band that starts a stripe before
        pairs = np.concatenate([np.stack([key, band]), np.stack([key, band - 1])], axis=1)
        place, where = np.concatenate([place, place]), np.concatenate([where, where])
        order = np.lexsort((where, pairs[1], pairs[0]))
        pairs, place, where = pairs[:, order], place[order], where[order]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(pairs) != 0).any(axis=0)]))
        ends = np.append(cut[1:], len(order))
        keep = (ends - cut) >= self.least[pairs[0][cut] % len(self.ids)]
        found: dict[tuple[int, int], int] = {}
        for a, b in zip(cut[keep].tolist(), ends[keep].tolist(), strict=True):
            doc, it = divmod(int(pairs[0][a]), len(self.ids))
            best = found.get((doc, it), self.edits + 1)
            if best:
                found[doc, it] = min(best, self._verified(it, texts[doc], place[a:b], int(pairs[1][a] - (1 << 31)) * step))
        for (doc, it), edits in found.items():
            if edits <= self.edits:
                yield doc, it, edits

    def _verified(self, item: int, text: str, places: np.ndarray, diagonal: int) -> int:
        """Fewest edits of a passage of the part that shares enough q-grams with the band that starts at `diagonal`."""
        places = np.sort(places)
        best = self.edits + 1
        margin = 2 * (self.edits + 1)
        starts, lengths = self.starts[item]
        shared = np.searchsorted(places, starts + lengths - self.q, "right") - np.searchsorted(places, starts, "left")
        enough = shared >= lengths - self.q + 1 - self.edits * self.q
        for k in np.flatnonzero(enough & (shared > 0))[np.argsort(-shared[enough & (shared > 0)], kind="stable")]:
            a, m = int(starts[k]), int(lengths[k])
            region = text[max(0, a + diagonal - margin) : a + m + diagonal + 2 * margin]
            best = min(best, least_edits(self.texts[item][a : a + m], region, best - 1))
            if not best:
                break
        return best


class Slice:
    """Some texts in joined form with their places in a batch, and their q-gram hashes for each q in use."""

    def __init__(self, batch: pa.RecordBatch, places: list[int], texts: list[str]):
        self.batch, self.places, self.texts = batch, places, texts
        self.codes = codes_of("\n".join(texts))
        self.grams: dict[int, np.ndarray] = {}

    def found(self, index: ItemIndex) -> pa.RecordBatch | None:
        if index.q not in self.grams:
            self.grams[index.q] = gram_hashes(self.codes, index.q)
        rows = list(index.matches(self.texts, self.codes, self.grams[index.q]))
        if not rows:
            return None
        doc, part, edits = zip(*rows, strict=True)
        ids = self.batch.column("doc").take(pa.array([self.places[d] for d in doc]))
        return pa.RecordBatch.from_arrays([ids, pa.array([index.ids[i] for i in part], pa.int64()), pa.array(edits, pa.int32())], names=["doc", "item", "edits"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        texts = batch.column("text")
        places, held, chars = [], [], 0
        for i in range(batch.num_rows):
            places.append(i)
            held.append(joined(normal_words(texts[i].as_py())))
            chars += len(held[-1])
            if chars >= SLICE_CHARS:
                yield Slice(batch, places, held)
                places, held, chars = [], [], 0
        if places:
            yield Slice(batch, places, held)


def _finder(blocks: list):
    def probed(slices: list[Slice]) -> Iterator[pa.RecordBatch]:
        for n, block in enumerate(blocks):
            index = ItemIndex.restored(block.value)
            yield from filter(None, (s.found(index) for s in slices))
            if n >= KEPT_BLOCKS:
                block.__dict__.pop("_value", None)  # read again from the worker's disk for the next slices

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for piece in _slices(batches):
            held.append(piece)
            if len(held) == SLICES:
                yield from probed(held)
                held = []
        yield from probed(held)

    return find


def passages(tokens: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the passages of an item in joined form."""
    edge = np.cumsum([0] + [len(w) + 1 for w in tokens])
    return edge[:-words], edge[words:] - edge[:-words] + 1


def _parts(tokens: list[str], words: int) -> Iterator[list[str]]:
    """Parts of an item that hold each of its passages, of about PART_CHARS characters or two passages."""
    start, chars = 0, 0
    for i, w in enumerate(tokens):
        chars += len(w) + 1
        if chars > PART_CHARS and i + 1 - start >= 2 * words:
            yield tokens[start : i + 1]
            start = i + 2 - words
            chars = sum(len(x) + 1 for x in tokens[start : i + 1])
    if len(tokens) - start >= words:
        yield tokens[start:]


def _blocks(items: Iterator, words: int, edits: int) -> Iterator[ItemIndex]:
    """Indexes of parts of items, each of one q; one block of each q is open at a time."""
    held: dict[int, list] = {}
    chars: dict[int, int] = {}
    for item, text in items:
        for tokens in _parts(normal_words(text), words):
            shortest = int(passages(tokens, words)[1].min())
            q = next(q for q in QS if q * (edits + 1) <= shortest)
            held.setdefault(q, []).append((item, tokens))
            chars[q] = chars.get(q, 0) + sum(len(w) + 1 for w in tokens)
            if chars[q] >= BLOCK_CHARS:
                yield ItemIndex(held.pop(q), q, words, edits)
                chars[q] = 0
    for q, rest in held.items():
        yield ItemIndex(rest, q, words, edits)


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", words: int = WORDS, edits: int = 2) -> DataFrame:
    """doc_id, item_id, edits: documents in which a run of `words` words of an item stands with at most `edits` edits.

    Case, punctuation, white space, line breaks, unseen characters and compatibility forms do not matter; 0 edits means
    that the run stands there word for word. Items of fewer words, and null and empty texts, match nothing. Repeated
    rows count once. Passages may be short: more than 2 `words` edits are refused, since then nothing need be shared.
    Whole texts are searched. The items are read while the plan is made, by one job a partition of theirs, and at most
    one block of each q is held by the driver.
    """
    if edits > 2 * words:
        raise ValueError(f"{edits} edits may leave nothing of {words} words")
    spark = documents.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = [spark.sparkContext.broadcast(vars(index)) for index in _blocks(rows.toLocalIterator(), words, edits)]
    corpus = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter("text IS NOT NULL")
    kind = f"doc {corpus.schema['doc'].dataType.simpleString()}, item bigint, edits int"
    if not blocks:
        found = spark.createDataFrame([], kind)
    else:
        found = spread(corpus).mapInArrow(_finder(blocks), kind)
    return found.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.min("edits").alias("edits"))
