"""Text cut off by field limits or in transfer.

Hazards of discrete lengths are learnt from all documents. For every source, the hazard of a whole text ending at exactly
a length is tested against the hazards around it, by windows over the counts of lengths; significant lengths are field
limits. A cut in transfer has no common length of the whole text, but the last line or sentence it breaks off has one
that lines and sentences do not end at: so for every source and kind of last token, the hazard of the last unit of a text
ending at a number of tokens is tested against the hazard that the units within texts have at that number, for single
numbers and for ever wider intervals of them. Both tests control the false discovery rate.

Texts whose length or last unit is significant are flagged where their ending is incomplete: where the last token, after
the tokens before it, hardly ever ends a line or sentence anywhere in the corpus. At significant lengths of whole texts
more endings are doubted than at those of last units. What a cut leaves behind, such as a bracketed word or dots, is learnt
as well: it is an ending behind which texts are at a significant length more often than not.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed, spread

#: A word is known if it is in this share of the documents; at most (mean words of a document) / WORD_SHARE words are.
WORD_SHARE = 0.005
LEAST_DOCS = 5
#: Least count of a context for its rates to be used.
SUPPORT = 10
#: An ending is sure if it stands AMONG times or more, SHARE of the times after what is before it, and HALF of the others end.
AMONG, SHARE, HALF = 4, 0.02, 0.5
#: A known word is a sure ending after tokens behind which this share of all next tokens end.
ANY_ENDS = 0.8
#: Least rates of a complete ending, elsewhere and at significant lengths: of the ending given the tokens before, where
#: its last token is a number, id or unknown word (OPEN) or another one (FIXED), and of ending given the whole (ENDS).
OPEN, FIXED, ENDS = (0.05, 0.1), (0.005, 0.03), 0.2
NEIGHBOURS = 24
DISCOVERY = 0.01
LEAST_AT_LENGTH = 4
TAIL_CHARS = 600
LAST_CHARS = 120
#: Whole powers of two, of their roots, and all numbers: intervals of numbers of tokens, beside the single numbers.
INTERVALS = (2.0, 1.0, 0.0)
SLICE_CHARS = 2_500_000

_STOPS = ".!?。؟।"
#: A stop takes the blank behind it along, so that it can be told from one within a word.
_TOKEN = re.compile(rf"\w+(?:-(?<=[^\W\d_]-)\d+\b)?|[^\w\s{_STOPS}]|[{_STOPS}](?:[^\S\n]|$)?|\n+")
#: What may be a cut's mark: a bracketed group, three dots, or other signs that end no sentence, at the very end.
_SUFFIX = re.compile(rf"\s*(\[[^\[\]\n]+\]|\([^()\n]+\)|<[^<>\n]+>|\{{[^{{}}\n]+\}}|\.{{3}}|[^\w\s{_STOPS}'\"»”’)\]}}>]+)$")
_CLOSERS = re.compile(f"(?<=[{_STOPS}])[\"'»”’)\\]]+$")
LEVELS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def closed(text: str) -> str:
    """Text without blanks at its end and without quotes and brackets that close a sentence."""
    text = text.rstrip()
    return text[:-LAST_CHARS] + _CLOSERS.sub("", text[-LAST_CHARS:])


def parted(text: str) -> tuple[str, str | None]:
    """Text without blanks at its end and without what may be a cut's mark; and that, with any number as 0."""
    text = text.rstrip()
    mark = _SUFFIX.search(text[-LAST_CHARS:])
    if not mark:
        return text, None
    return text[: len(text) - len(mark.group())].rstrip(), re.sub(r"\d+", "0", mark.group(1).lower())


def _code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Tokens(dict):
    """Token to class number: a known word is a class, other words, numbers and ids are one each, ids by their length."""

    def __init__(self, known: frozenset[str]):
        super().__init__()
        self.known = known
        self.numbers: dict[tuple, int] = {}
        self.table: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, bool)]
        self.start = self._class("^start", "^start", False, False)
        self.line = self._class("\n", "\n", False, False)

    def _class(self, exact: str, loose: str, openness: bool, stop: bool) -> int:
        return self.numbers.setdefault((exact, loose, openness, stop), len(self.numbers))

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        if token[0] == "\n":
            number = self.line
        elif token in self.known:
            number = self._class(token, "^word", False, False)
        elif token[0] in _STOPS:
            number = self._class(".", ".", False, len(token) > 1)
        elif token.isdigit():
            number = self._class("^number", "^number", True, False)
        elif len(token) == 1 and not token.isalnum():
            number = self._class(token, token, False, False)
        elif "-" not in token and any(map(str.isdigit, token)):
            number = self._class(c := f"^id{len(token)}", c, True, False)
        else:
            number = self._class("^unknown", "^word", True, False)
        self[token] = number
        return number

    def read(self, text: str) -> list[int]:
        """Class numbers of a text behind three starts."""
        return [self.start] * 3 + list(map(self.__getitem__, _TOKEN.findall(text)))

    def columns(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, loose codes, openness and stops of class numbers."""
        if len(self.table[0]) < len(self.numbers):
            new = list(self.numbers)[len(self.table[0]) :]
            exact, loose, openness, stop = zip(*new, strict=True)
            codes = [np.array(list(map(_code, c)), np.uint64) for c in (exact, loose)]
            self.table = [np.concatenate(pair) for pair in zip(self.table, [*codes, np.array(openness, bool), np.array(stop, bool)], strict=True)]
        return tuple(c[numbers] for c in self.table)


def _mixed(seed: int, *parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), seed, np.uint64) * _MIX
    for p in parts:
        out = (out ^ p) * _MIX
        out ^= out >> np.uint64(31)
    return out


def contexts(a: np.ndarray, b: np.ndarray, c: np.ndarray, loose: np.ndarray, last: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For tokens `last` behind a, b and c, at each level the key of the tokens before and of those with the last.

    Levels: three tokens; two; three, the last of them by its loose class; one."""
    before = [_mixed(1, a, b, c), _mixed(2, b, c), _mixed(3, a, b, loose), _mixed(4, c)]
    return [(p, _mixed(11 + i, p, last)) for i, p in enumerate(before)]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each key, and first place and size of each group, by hashing."""
    back, different = pd.factorize(keys)
    at = np.empty(len(different), np.int64)
    at[back[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return back, at, np.bincount(back, minlength=len(different))


def _counts(tokens: Tokens, ids: np.ndarray, begins: np.ndarray, sources: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of texts' class numbers, each behind three starts at `begins`, with one more at the end: counts of keys (key, n, ends); counts
    of units within texts (source, class, tokens, n); and class and tokens of each text's last unit."""
    e, w, openness, stop = tokens.columns(ids)
    following = ids[1:]
    token = (ids[:-1] != tokens.start) & (ids[:-1] != tokens.line)
    done = stop[:-1] | (following == tokens.line) | (following == tokens.start)
    # a text's last token is counted by its ending, once for all copies of the text
    real = np.flatnonzero((ids[:-1] != tokens.start) & (following != tokens.start))
    a, b, c, loose, last = (x[y] for x, y in ((e, real - 3), (e, real - 2), (e, real - 1), (w, real - 1), (e, real)))
    # equal stretches of four tokens are counted first; the other keys are counted over the different ones only
    back, at, times = _grouped(_mixed(0, a, b, c, last))
    ending = np.bincount(back, weights=done[real], minlength=len(at))
    keys, n, closing = [], [], []
    for pair in contexts(a[at], b[at], c[at], loose[at], last[at]):
        for key in pair:
            back, first, _ = _grouped(key)
            keys.append(key[first])
            n.append(np.bincount(back, weights=times, minlength=len(first)))
            closing.append(np.bincount(back, weights=ending, minlength=len(first)))
    counted = [np.concatenate(keys).view(np.int64), np.concatenate(n).astype(np.int64), np.concatenate(closing).astype(np.int64)]

    final = token & (following == tokens.start)
    ends = np.flatnonzero(token & done)
    kind = _mixed(5, w[ends], openness[ends].astype(np.uint64)).view(np.int64)
    long = np.diff(np.cumsum(token)[ends], prepend=0)
    text_of = np.searchsorted(begins, ends, "right") - 1
    inner = ~final[ends]
    cells = [sources[text_of[inner]], kind[inner], long[inner]]
    _, first, times = _grouped(_mixed(6, *(c.view(np.uint64) for c in cells)))
    units = [*(c[first] for c in cells), times]
    unit_kind, unit_tokens = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
    unit_kind[text_of[~inner]], unit_tokens[text_of[~inner]] = kind[~inner], long[~inner]
    return counted, units, unit_kind, unit_tokens


def _tail(tokens: Tokens, body: str) -> list[int]:
    """Class numbers of the last four tokens of a text, which may be starts; texts are read from near their end."""
    if len(body) > TAIL_CHARS:
        found = tokens.read(body[-TAIL_CHARS:])[4:]  # the first token may be a part of one
        if len(found) >= 4:
            return found[-4:]
    return ([tokens.start] + tokens.read(body))[-4:]


_ENDING = "struct<open: boolean, stop: boolean, keys: array<bigint>>"
#: A text's row, or the counts of a slice of texts.
_ROW = f"""digest bigint, source string, suffix string, lengths array<int>, kind bigint, tokens bigint, whole {_ENDING}, body {_ENDING},
    keys array<bigint>, n array<bigint>, e array<bigint>, unit_sources array<string>, unit_kinds array<bigint>, unit_tokens array<bigint>, unit_n array<bigint>"""


def _reader(known, doc: pa.DataType):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = {f.name: to_arrow_type(f.dataType) for f in _parse_datatype_string(_ROW)}
    schema = pa.schema([("doc", doc), *kinds.items()])

    def endings_of(tokens: Tokens, tails: list[list[int]], bodies: list[str]) -> pa.Array:
        ids = np.array(tails).reshape(-1, 4)
        e, w, openness, _ = (x.reshape(-1, 4) for x in tokens.columns(ids.reshape(-1)))
        keys = np.stack([k for pair in contexts(e[:, 0], e[:, 1], e[:, 2], w[:, 2], e[:, 3]) for k in pair], axis=1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (2 * LEVELS)), pa.array(keys.reshape(-1)))
        stop = pa.array([bool(b) and b[-1] in _STOPS for b in bodies], pa.bool_())
        return pa.StructArray.from_arrays([pa.array(openness[:, 3]), stop, lists], fields=list(kinds["whole"]))

    def lists(values: list) -> dict:
        names = ["keys", "n", "e", "unit_sources", "unit_kinds", "unit_tokens", "unit_n"]
        return {k: pa.array([v], kinds[k]) for k, v in zip(names, values, strict=True)}

    def batch_of(columns: dict, rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(known.value)

        def flushed(batch: pa.RecordBatch, at: list[int], numbers: array, begins: list[int], lengths: list, whole: list, parts: list) -> Iterator[pa.RecordBatch]:
            numbers.append(tokens.start)
            source = batch.column("source").take(pa.array(at)).dictionary_encode()
            code = np.asarray(source.indices.fill_null(len(source.dictionary)), np.int64)
            counted, units, kind, long = _counts(tokens, np.frombuffer(numbers, np.int32), np.array(begins), code)
            names = [*source.dictionary.to_pylist(), None]
            yield batch_of(lists([*counted, [names[i] for i in units[0].tolist()], *units[1:]]), 1)
            columns = {c: batch.column(c).take(pa.array(at)) for c in ("doc", "digest", "source")}
            columns |= {"suffix": pa.array([p[0] for p in parts], pa.string()), "lengths": pa.array(lengths, kinds["lengths"]), "kind": pa.array(kind), "tokens": pa.array(long)}
            columns["whole"] = endings_of(tokens, [x[0] for x in whole], [x[1] for x in whole])
            marked = [i for i, p in enumerate(parts) if p[0] is not None]
            if marked:
                bodies = endings_of(tokens, [_tail(tokens, parts[i][1]) for i in marked], [parts[i][1] for i in marked])
                place = np.full(len(parts), -1)
                place[marked] = np.arange(len(marked))
                columns["body"] = bodies.take(pa.array(place, mask=place < 0))
            yield batch_of(columns, len(at))

        for batch in batches:
            at, numbers, begins, lengths, whole, parts, chars = [], array("i"), [], [], [], [], 0
            for i, text in enumerate(batch.column("text")):
                value = text.as_py()
                if not value or value.isspace():
                    continue
                full = closed(value)
                body, suffix = parted(value)
                ids = tokens.read(full)
                begins.append(len(numbers))
                numbers.extend(ids)
                at.append(i)
                whole.append((([tokens.start] + ids)[-4:], full))
                parts.append((suffix, closed(body)))
                lengths.append([len(value), len(value.encode("utf-8", "surrogatepass")), len(body), len(body.encode("utf-8", "surrogatepass"))])
                chars += len(value)
                if chars > SLICE_CHARS:
                    yield from flushed(batch, at, numbers, begins, lengths, whole, parts)
                    at, numbers, begins, lengths, whole, parts, chars = [], array("i"), [], [], [], [], 0
            if at:
                yield from flushed(batch, at, numbers, begins, lengths, whole, parts)

    return read


def known_words(documents: DataFrame, text: str, share: float = WORD_SHARE) -> frozenset[str]:
    """Words in at least `share` of the documents that have text; each holds `share` of them, which bounds their number."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1)))
    there = documents.filter(F.length(F.trim(text)) > 0)
    all_of = there.count()
    counted = there.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return frozenset(r["word"] for r in counted.filter(F.col("n") >= max(LEAST_DOCS, share * all_of)).toLocalIterator())


def discovered(tested: DataFrame, discovery: float = DISCOVERY) -> DataFrame:
    """Rows whose count n exceeds the expected mu: its Poisson upper tail is at most exp(k - mu - k ln(k / mu)), and the
    Benjamini-Hochberg step over all rows of LEAST_AT_LENGTH or more keeps the share of false ones at `discovery`.

    The tested rows are checkpointed; their tails are counted in tenths of a power of ten up to 500, so that at most 5,001
    counts come to the driver, where the step is taken.
    """
    k, mu = F.col("n").cast("double"), F.col("mu")
    tail = F.when(k > mu, (k - mu - k * F.log(k / mu)) / F.log(F.lit(10.0))).otherwise(0.0)
    tested = checkpointed(tested.filter(F.col("n") >= LEAST_AT_LENGTH).withColumn("bucket", F.least(F.floor(-tail * 10), F.lit(5000)).cast("int")))
    counts = sorted(tested.groupBy("bucket").count().collect(), reverse=True)
    tests = sum(n for _, n in counts)
    rank, least = 0, None
    for bucket, n in counts:
        rank += n
        if -bucket / 10 <= math.log10(discovery * rank / tests):
            least = bucket
    return (tested.filter(F.col("bucket") >= least) if least is not None else tested.filter("false")).drop("bucket")


def significant_lengths(lengths: DataFrame, near: int = NEIGHBOURS, discovery: float = DISCOVERY) -> DataFrame:
    """source, measure, length at which too many texts end, of rows (source, measure, length).

    The hazard of a length is the share of texts at least as long that end there. Against the hazard of the `near` lengths
    below or above, whichever is higher, its count has a Poisson upper tail of at most exp(k - mu - k ln(k / mu)); the
    Benjamini-Hochberg step over all tested lengths keeps the share of false ones at `discovery`.
    """
    cells = lengths.groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy("source", "measure")
    down = each.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    risk = cells.withColumn("risk", F.sum("n").over(down)).withColumn("longest", F.max("length").over(each))

    def side(low: int, high: int, lengths_there: Column) -> Column:
        """Expected count by the hazard of one side; the risk at lengths that no text has is about that of the others."""
        w = each.orderBy("length").rangeBetween(low, high)
        total = F.coalesce(F.sum("n").over(w), F.lit(0)) + 0.5
        return total / F.greatest(lengths_there, F.lit(1)) * F.col("risk") / F.coalesce(F.avg("risk").over(w), F.col("risk"))

    # the longest texts of all end with certainty: their count must stand out from the counts below as well
    below = (F.coalesce(F.sum("n").over(each.orderBy("length").rangeBetween(-near, -1)), F.lit(0)) + 0.5) / F.greatest(F.least(F.lit(near), F.col("length") - 1), F.lit(1))
    around = risk.withColumn("mu", F.greatest(below, side(-near, -1, F.least(F.lit(near), F.col("length") - 1)), side(1, near, F.least(F.lit(near), F.col("longest") - F.col("length")))))
    return discovered(around, discovery).select("source", "measure", "length")


def significant_units(units: DataFrame, discovery: float = DISCOVERY) -> DataFrame:
    """source, kind, tokens of last units that end at a significant number of tokens, of rows (source, kind, tokens, last,
    inner): how many last units and units within texts end so.

    The hazard of a kind at a number is the share of the source's units at least as long that end there as that kind; the
    last units' count is tested against the hazard of the units within texts, for every number and for INTERVALS of them.
    """
    scale = F.array(F.col("tokens"), *[F.floor(F.log2("tokens") * r + 1e-9) for r in INTERVALS])
    cells = units.select("source", "kind", "tokens", "last", "inner", F.posexplode(scale).alias("measure", "place"))
    placed = cells.groupBy("source", "kind", "measure", "place").agg(F.sum("last").alias("n"), F.sum("inner").alias("inner"))
    down = Window.partitionBy("source", "measure").orderBy(F.col("place").desc()).rangeBetween(Window.unboundedPreceding, 0)
    risk = placed.withColumn("mu", F.sum("n").over(down) * (F.col("inner") + 0.5) / (F.sum("inner").over(down) + 1))
    found = discovered(risk, discovery).select(F.col("source").alias("s"), F.col("kind").alias("k"), F.col("measure").alias("m"), F.col("place").alias("p"))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("kind") == F.col("k")) & (F.col("measure") == F.col("m")) & (F.col("place") == F.col("p"))
    return cells.filter("last > 0").join(found, on, "left_semi").select("source", "kind", "tokens").distinct()


def _source(c: Column) -> Column:
    return F.lower(F.trim(c))


def endings(documents: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """doc, source, mark, stop, open, lengths, limit, unit, given, ends, sure: each text's ending and how usual it is.

    limit: whether one of its lengths is significant; unit: whether the length of its last unit is; mark: whether it ends
    in a cut's mark, which the ending is then read before. given: share of the ending's last token after the tokens before
    it that also ends there; ends: share of the times it stands there that it ends. Three tokens before it are looked at,
    or two if three are too rare, or what one or three looser ones say at best. Without enough support both are 1.

    The known words are collected while the plan is made, and the texts are then read once, into a checkpoint of some 200
    bytes a text and the counts of each slice.
    """
    spark = documents.sparkSession
    known = spark.sparkContext.broadcast(known_words(documents, text))
    rows = documents.select(F.col(doc_id).alias("doc"), _source(F.col(source)).alias("source"), F.col(text).alias("text"), F.xxhash64(text).alias("digest")).filter("text IS NOT NULL")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["doc"].dataType
    read = checkpointed(spread(rows).mapInArrow(_reader(known, to_arrow_type(kind)), f"doc {kind.simpleString()}, {_ROW}"))
    texts = read.filter("lengths IS NOT NULL")

    measured = texts.select("source", F.posexplode("lengths").alias("measure", "length"))
    limits = significant_lengths(measured).groupBy("source").agg(F.collect_set(F.struct("measure", "length")).alias("limits"))
    texts = texts.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    at = F.transform("lengths", lambda x, i: F.coalesce(F.array_contains("limits", F.struct(i.alias("measure"), x.alias("length"))), F.lit(False)))
    texts = texts.withColumn("at", at).drop("limits").withColumn("limit", F.array_contains("at", True)).withColumn("before", F.get("at", F.lit(2)) | F.get("at", F.lit(3)))
    often = F.count(F.when(F.col("before"), 1))
    marks = texts.filter("suffix IS NOT NULL").groupBy(F.col("suffix").alias("x")).agg(often.alias("k"), F.count(F.lit(1)).alias("n")).filter((F.col("k") >= LEAST_AT_LENGTH) & (F.col("k") * 2 > F.col("n")))
    texts = texts.join(checkpointed(marks).select("x", F.lit(True).alias("mark")), F.col("suffix") == F.col("x"), "left").withColumn("mark", F.coalesce("mark", F.lit(False)))
    ending = F.when(F.col("mark"), F.col("body")).otherwise(F.col("whole"))
    texts = texts.select("doc", "digest", "source", "mark", "limit", "lengths", "kind", "tokens", ending["open"].alias("open"), ending["stop"].alias("stop"), ending["keys"].alias("keys"))

    inner = read.filter("unit_n IS NOT NULL").select(F.explode(F.arrays_zip("unit_sources", "unit_kinds", "unit_tokens", "unit_n")).alias("u"))
    inner = inner.select(F.col("u.unit_sources").alias("source"), F.col("u.unit_kinds").alias("kind"), F.col("u.unit_tokens").alias("tokens"), F.lit(0).cast("long").alias("last"), F.col("u.unit_n").alias("inner"))
    last = read.filter("tokens > 0").select("source", "kind", "tokens", F.lit(1).cast("long").alias("last"), F.lit(0).cast("long").alias("inner"))
    units = inner.unionByName(last).groupBy("source", "kind", "tokens").agg(F.sum("last").alias("last"), F.sum("inner").alias("inner"))
    units = significant_units(units).select(F.col("source").alias("us"), F.col("kind").alias("uk"), F.col("tokens").alias("ut"), F.lit(True).alias("unit"))

    once = texts.select("digest", F.posexplode("keys").alias("slot", "key")).distinct().select("key", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("e"))
    counts = read.filter("keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "n", "e")).alias("c")).select("c.keys", "c.n", "c.e").toDF("key", "n", "e")
    counts = counts.unionByName(once).groupBy("key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    tails = texts.select("keys").distinct().withColumn("tail", F.xxhash64("keys"))
    wanted = tails.select("tail", F.posexplode("keys").alias("slot", "key"))
    met = wanted.join(counts, "key").groupBy("tail").agg(*[F.max(F.when(F.col("slot") == s, F.struct("n", "e"))).alias(f"s{s}") for s in range(2 * LEVELS)])
    rates = [F.when(F.col(f"s{2 * i}.n") >= SUPPORT, F.struct((F.col(f"s{2 * i + 1}.e") / F.col(f"s{2 * i}.n")).alias("given"), (F.col(f"s{2 * i + 1}.e") / F.col(f"s{2 * i + 1}.n")).alias("ends"))) for i in range(LEVELS)]
    chosen = F.coalesce(*rates[:2], F.greatest(*rates[2:]))
    n, m, w, e = ([F.col(f"s{2 * i + j}.{c}") for i in range(LEVELS)] for j, c in ((0, "n"), (0, "e"), (1, "n"), (1, "e")))
    always = [(n[i] >= SUPPORT) & (m[i] - 1 >= ANY_ENDS * (n[i] - 1)) for i in range(2)]
    sure = [(w[i] >= AMONG) & (w[i] >= SHARE * n[i]) & (e[i] - 1 >= HALF * (w[i] - 1)) for i in range(LEVELS)]
    scored = met.select("tail", chosen.alias("c"), F.coalesce(F.greatest(*sure), F.lit(False)).alias("sure"), F.coalesce(F.greatest(*always), F.lit(False)).alias("always")).select("tail", "c.given", "c.ends", "sure", "always")

    placed = texts.withColumn("tail", F.xxhash64("keys")).drop("keys", "digest").join(scored, "tail", "left")
    placed = placed.join(units, F.col("source").eqNullSafe(F.col("us")) & (F.col("kind") == F.col("uk")) & (F.col("tokens") == F.col("ut")), "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0)).alias(c)
    sure = F.coalesce(F.col("sure") | (F.col("always") & ~F.col("open")), F.lit(False)).alias("sure")
    return placed.select("doc", "source", "mark", "stop", "open", "lengths", "limit", F.coalesce("unit", F.lit(False)).alias("unit"), one("given"), one("ends"), sure)


def cut_texts(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc, source, cut, limit, unit, mark: every text that is neither null nor blank and whether it stops before its end.

    A text is cut only if its length or that of its last unit is significant, or it bears a mark that is found at
    significant lengths and does not follow the end of a sentence. Sources are compared without case and surrounding
    blanks, a null source is one of its own. Texts of a corpus too small for support count as complete. Repeated rows
    come out as often as they stand.
    """
    found = endings(documents, doc_id, source, text)
    level = lambda pair: F.when(F.col("limit"), pair[1]).otherwise(pair[0])
    usual = F.when(F.col("open"), F.col("given") >= level(OPEN)).otherwise((F.col("given") >= level(FIXED)) & (F.col("ends") >= ENDS))
    broken = ~usual & ~(F.col("sure") & ~(F.col("limit") & F.col("open")))
    cut = F.when(F.col("mark"), ~F.col("stop")).otherwise((F.col("limit") | F.col("unit")) & broken)
    return found.select("doc", "source", cut.alias("cut"), "limit", "unit", "mark")
