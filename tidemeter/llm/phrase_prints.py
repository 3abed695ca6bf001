"""Fingerprints of texts from locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names into longer phrases, and so on up to one name for the whole text.  At each level:

- equal neighbours are taken together as one symbol with a count, so that neighbours differ;
- deterministic coin tossing: a symbol's label is the lowest bit in which it differs from the symbol before, together with that bit's value.
  Neighbouring labels differ again, and after three or four rounds they are below six;
- a phrase begins where the label is a local maximum, so it has two to about eleven symbols;
- its name is a 64-bit hash of what it holds: equal phrases have equal names, in all documents and at any offset.

Where a phrase begins depends on five symbols to its left and one to its right only.  So equal substrings are parsed alike but
for a few phrases at both ends, wherever they stand.  The fingerprint is the ``SKETCH`` least names among the phrases of level ``LEVEL``
and above, about thirty bytes long and longer, and the whole text's name, in hexadecimal digits of 32 bits each.  Likeness is Dice's
measure of the two sets of names, estimated from the least names of their union: 1 for equal fingerprints, about one half for texts that share a half.

Null and empty texts have an empty fingerprint; two of them are alike (1), and unlike any other text (0).  Equal texts have equal
fingerprints.  A very long text is parsed whole, in about 100 bytes of memory for each of its bytes.  Repeated rows give one row
each; other columns are not read.  The order by key takes equal keys by text, null keys last; an empty table gives no rows, and of a single
row the next document is the row itself.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemeter.llm.memo import small_batches
from tidemeter.llm.words import mix, slices, texts_of
from tidemeter.session import cut

#: Phrases from this level on make up the fingerprint, which has this many names at most.
LEVEL, SKETCH = 3, 48
_CODES = np.random.default_rng(20261201).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_REPEAT, _LENGTH, _STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=1)
def _tosses() -> np.ndarray:
    """One round of coin tossing for two bytes, by the byte before times 256 plus the byte."""
    before, here = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    differ = before ^ here
    bit = np.bitwise_count((differ & -differ) - 1).astype(np.int64) * (differ != 0)
    return (2 * bit + (here >> bit & 1)).astype(np.uint8).reshape(-1)


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty(len(labels), dtype=np.uint16)
    before[1:] = labels[:-1]
    before[first] = labels[first] ^ 1
    return _tosses()[(before << np.uint16(8)) | labels]


def _toss_wide(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    differ = np.empty_like(names)
    differ[1:] = names[1:] ^ names[:-1]
    differ[first] = 1
    bit = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    return (2 * bit + ((names >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return np.cumprod(np.full(4096, _STEP))


def _phrases(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level over rows that each hold a symbol or more: names of the phrases, their first symbols, and each row's first phrase."""
    opens = np.zeros(len(symbols), dtype=bool)
    opens[first] = True
    heads = opens.copy()
    heads[1:] |= symbols[1:] != symbols[:-1]
    heads = np.flatnonzero(heads)
    times = np.diff(np.append(heads, len(symbols)))
    distinct = symbols[heads]
    start = np.searchsorted(heads, first)
    if symbols.dtype == np.uint8:
        labels, rounds = _toss(distinct, start), 2
        names = _CODES[distinct]
    else:
        labels, rounds = _toss_wide(distinct, start), 3
        names = distinct
    for _ in range(rounds):
        labels = _toss(labels, start)
    many = times > 1
    if many.any():
        names = names.copy()
        names[many] = mix(names[many] + times[many].astype(np.uint64) * _REPEAT)
    begin = np.zeros(len(labels), dtype=bool)
    begin[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    last = np.append(start[1:], len(labels)) - 1
    begin[last] = False  # a maximum needs a neighbour of its own row on both sides
    begin[start] = True
    begin = np.flatnonzero(begin)
    length = np.diff(np.append(begin, len(labels)))
    place = np.arange(len(labels)) - np.repeat(begin, length)
    named = mix(np.add.reduceat(mix(names) * _weights()[place % 4096], begin) + length.astype(np.uint64) * _LENGTH)
    return named, heads[begin], np.searchsorted(begin, start)


def parse(data: np.ndarray, off: np.ndarray):
    """Levels from 1 on: (rows still open, first byte of each phrase, name of each phrase, each open row's first phrase).  A row ends with one phrase."""
    rows = np.flatnonzero(np.diff(off) > 0)
    first = off[rows]
    base = int(off[0])
    symbols, first = data[base:int(off[-1])], (first - base).astype(np.int64)
    at = np.arange(len(symbols))
    while len(rows):
        symbols, heads, first = _phrases(symbols, first)
        at = at[heads]
        yield rows, at, symbols, first
        count = np.diff(np.append(first, len(symbols)))
        going = count > 1
        if not going.all():
            keep = np.repeat(going, count)
            symbols, at, rows, count = symbols[keep], at[keep], rows[going], count[going]
            first = np.cumsum(count) - count


def fingerprints(column) -> list[np.ndarray]:
    """The least names of each text of an Arrow column, in order."""
    data, off = texts_of(column)
    out: list[np.ndarray] = []
    for a, b in slices(off):
        owners, names = [], []
        for level, (rows, _, found, first) in enumerate(parse(data, off[a:b + 1]), 1):
            count = np.diff(np.append(first, len(found)))
            if level < LEVEL:  # of the rows that end here, the whole text's name
                at = first[count == 1]
                owners.append(rows[count == 1])
                names.append(found[at])
            else:
                owners.append(np.repeat(rows, count))
                names.append(found)
        owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        name = (np.concatenate(names) >> np.uint64(32)).astype(np.uint32) if names else np.zeros(0, dtype=np.uint32)
        both = np.unique(owner.astype(np.uint64) << np.uint64(32) | name)
        cuts = np.searchsorted(both, np.arange(b - a + 1).astype(np.uint64) << np.uint64(32))
        both = both.astype(np.uint32)
        out += [both[cuts[r]:min(cuts[r + 1], cuts[r] + SKETCH)] for r in range(b - a)]
    return out


def bytes_of(found: np.ndarray) -> bytes:
    return found.astype(">u4").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice's measure of the two sets of phrases, from their least names."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    if len(a) >= SKETCH or len(b) >= SKETCH:  # beyond the sketch a set's names are not known
        both = both[:SKETCH]
    shared = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True))
    return 2.0 * shared / (len(both) + shared)


def phrases(docs: DataFrame, level: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The phrases of one level: (doc_id, start, end, name), in bytes of the UTF-8 text; texts that end below the level give none."""
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("body"))
    schema = T.StructType([kept.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "end", "name")]])

    def rows_of(batches):
        for batch in batches:
            data, off = texts_of(batch.column(1))
            for a, b in slices(off):
                for k, (rows, at, names, first) in enumerate(parse(data, off[a:b + 1]), 1):
                    if k == level:
                        owner = np.repeat(rows, np.diff(np.append(first, len(names)))) + a
                        here = at - (off[owner] - off[a])
                        end = np.append(here[1:], 0)
                        final = np.append(owner[1:] != owner[:-1], True)
                        end[final] = (off[owner + 1] - off[owner])[final]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(here), pa.array(end), pa.array(names.view(np.int64))],
                                                         names=schema.names)

    return kept.mapInArrow(rows_of, schema)


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as much, or all, of the following text's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_FOUND = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_DIGITS = _FOUND[1:4]


def _schema(key: T.StructField) -> T.StructType:
    """Digests and fingerprints as bytes, half as long as their digits."""
    kinds = (T.LongType(), T.BinaryType(), T.BinaryType(), T.BinaryType(), T.DoubleType(), T.DoubleType())
    return T.StructType([key, *[T.StructField(c, t) for c, t in zip(_FOUND, kinds)]])


def _pairs(texts: list[str], own: list[np.ndarray], following: list[str], theirs: list[np.ndarray]) -> list[pa.Array]:
    """The result columns of texts and the texts that follow them."""
    new = [edited(t, f) for t, f in zip(texts, following)]
    column = pa.array(new, pa.large_string())
    prints = fingerprints(column)
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in new], pa.binary()),
            pa.array([bytes_of(p) for p in own], pa.binary()), pa.array([bytes_of(p) for p in prints], pa.binary()),
            pa.array([likeness(a, b) for a, b in zip(own, prints)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, theirs)], pa.float64())]


def with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, in the order of falling keys: fingerprints of its text and of its edited text, and its likeness to that and to the next document.

    The texts are dealt out by ranges of the key and of a hash of the text, one exchange, so that no key is too large for a task, and each
    task reads its range in order, holding one row over.  Only the last row of a range needs another task's first row: those
    pairs, one for each range, are written with the results, and put together after that.
    """
    spark = small_batches(docs.sparkSession)
    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("body"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order, "body").select("doc_id", "body")
    result = _schema(kept.schema["doc_id"])
    written = T.StructType([*result, T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("edge_text", T.StringType())])

    def ranges(batches):
        part = TaskContext.get().partitionId()
        held = None  # the last row so far: its key, text and fingerprint

        def edge(kind, row):
            k, t, _ = row
            return pa.RecordBatch.from_arrays([k, *[pa.nulls(1, f) for f in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())],
                                               pa.array([part], pa.int32()), pa.array([kind], pa.string()), pa.array([t], pa.string())], names=written.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, texts, prints = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], fingerprints(batch.column(1))
            if held is None:
                yield edge("first", (keys.slice(0, 1), texts[0], None))
            else:
                keys = pa.concat_arrays([held[0], keys])
                texts.insert(0, held[1])
                prints.insert(0, held[2])
            n = len(texts) - 1
            if n:
                found = _pairs(texts[:-1], prints[:-1], texts[1:], prints[1:])
                yield pa.RecordBatch.from_arrays([keys.slice(0, n), *found, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())],
                                                 names=written.names)
            held = (keys.slice(n, 1), texts[n], prints[n])
        if held is not None:
            yield edge("last", held)

    out = cut(ranged.mapInArrow(ranges, written))
    # two rows a range: which range follows which is a list of at most as many numbers as there are partitions
    parts = sorted(r.part for r in out.filter("edge = 'first'").select("part").collect())
    pairs = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    first = out.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("edge_text").alias("following"))
    last = out.filter("edge = 'last'").select("doc_id", "part", "edge_text").join(pairs, "part").join(first, "next").select("doc_id", "edge_text", "following")

    def joined(batches):
        for batch in batches:
            texts, following = ([t or "" for t in batch.column(k).to_pylist()] for k in (1, 2))
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_pairs(texts, fingerprints(batch.column(1)), following, fingerprints(batch.column(2)))], names=result.names)

    both = out.filter(F.col("edge").isNull()).select(*result.names).unionByName(last.mapInArrow(joined, result))
    return both.select("doc_id", *[F.lower(F.hex(c)).alias(c) if c in _DIGITS else c for c in _FOUND])
