"""Periodic runs of words inside a document, by an online sparse dynamic program over diagonals.

A run is a stretch of consecutive words whose words ``q`` apart are identical, ``q`` being its smallest period, of at least
``min_length`` words and at least ``2 * q``, that no neighbouring word extends with period ``q``.

The program goes through the words once.  For each lag at which earlier words are being matched (a diagonal) it keeps where the match
began; a word that equals its earlier occurrence at that lag lengthens it, and a diagonal that ends long enough gives its run at
once.  Three things keep the set of diagonals small for any text, one word repeated a million times included:

- a run of period ``q`` has ``q`` matches or more, so a lag of 8 to 15 is entered only when eight words in a row are met again, one of 16
  to 31 at sixteen, and so on; earlier occurrences are looked up among the hashes of such stretches, within twice their length;
- a diagonal is entered once, where it begins: the words before the two occurrences differ;
- inside a run of period ``q``, the multiples of ``q`` that begin with it also end with it and are not smallest periods: they are left out.

Words are compared by 64-bit hashes.  Rows are independent: a narrow map without a shuffle; a lost task is run again.  Null and empty texts have no
words and no run; equal rows and rows of equal or null key each give their own row; an empty table gives none; ties between runs of equal
length go to the smaller start, then the smaller period.  A very long text is worked on whole, in about 100 bytes of
memory for each of its bytes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemeter.llm.memo import small_batches
from tidemeter.llm.words import Words, mix, slices, texts_of

#: Lags below this one are looked at directly, from as many matches as the shortest run can have.
DIRECT = 8
#: What separates words, in a pattern of the JVM.
BLANKS = "[\\x20\\x09-\\x0D]+"


def _begin_direct(h: np.ndarray, row: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonals of small lags that reach the matches a run needs: first matching word, lag, matches seen."""
    starts, lags, seen = [], [], []
    for lag in range(1, min(DIRECT, len(h))):
        need = max(min_length - lag, lag)
        same = np.zeros(len(h), dtype=bool)
        same[lag:] = (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        at = begin[end - begin >= need]
        starts.append(at)
        lags.append(np.full(len(at), lag))
        seen.append(np.full(len(at), need))
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, lags, seen))


def _begin_doubling(words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Diagonals of lags from ``DIRECT``: those of lag ``size`` to ``2 * size - 1`` where ``size`` words in a row have been met before."""
    out, size = [], DIRECT
    at, h = words.windows(size)
    while len(at):
        key = mix(h ^ mix(words.row[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        pos, key = at[order], key[order]
        again = np.zeros(len(pos), dtype=bool)
        again[1:] = key[1:] == key[:-1]
        # what stands before: a hash, or at the start of a row nothing that could be equal
        before = words.hash[np.maximum(pos - 1, 0)]
        opens = pos == words.first[words.row[pos]]
        stretch = np.flatnonzero(~again | opens | np.concatenate([[True], before[1:] != before[:-1]]) | np.concatenate([[True], opens[:-1]]))
        head = np.repeat(stretch, np.diff(np.append(stretch, len(pos))))  # first of those in a row with the same key and word before
        group = np.cumsum(~again)
        me, cand = np.arange(1, len(pos)), np.arange(len(pos) - 1)
        while len(me):
            near = (cand >= 0) & (group[np.maximum(cand, 0)] == group[me])
            near[near] = pos[me[near]] - pos[cand[near]] < 2 * size
            me, cand = me[near], cand[near]
            differ = head[cand] != head[me]
            differ &= (before[cand] != before[me]) | opens[cand] | opens[me]
            found = differ & (pos[me] - pos[cand] >= size)
            if found.any():
                out.append((pos[me[found]], pos[me[found]] - pos[cand[found]], np.full(int(found.sum()), size)))
            cand = np.where(differ, cand - 1, head[cand] - 1)
        # a stretch twice as long is met again only where both halves are
        often = again.copy()
        often[:-1] |= again[1:]
        mark = np.zeros(len(words) + 1, dtype=bool)
        mark[pos[often]] = True
        at = np.sort(pos[often])
        at = at[(at + size < len(words))]
        at = at[mark[at + size]]
        last = at + 2 * size - 1
        at = at[last < len(words)]
        at = at[words.row[at] == words.row[at + 2 * size - 1]]
        size *= 2
        h = words.span_hash(at, size) if len(at) else h[:0]
    return out


def _walk(w: list[int], begins: list[tuple[int, int, int]], min_length: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one document; ``begins`` has, by place, the diagonals that begin to count there: place, first match, lag."""
    n, k, i = len(w), 0, 0
    active: dict[int, int] = {}  # lag -> first matching word
    squares: dict[int, list[int]] = defaultdict(list)  # first word of the stretch -> its lags
    runs: list[tuple[int, int, int]] = []
    while active or k < len(begins):
        if not active:
            i = begins[k][0]
        ended = [lag for lag in active if i >= n or w[i] != w[i - lag]]
        for lag in ended:
            first = active.pop(lag)
            squares[first - lag].remove(lag)
            if i - first >= max(min_length - lag, lag):
                runs.append((first - lag, i - first + lag, lag))
        while k < len(begins) and begins[k][0] == i:
            _, first, lag = begins[k]
            k += 1
            stretch = squares[first - lag]
            if lag in active or any(lag % q == 0 and i - active[q] + 1 >= q for q in stretch):
                continue
            active[lag] = first
            stretch.append(lag)
        i += 1
    least: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted((start, length, period) for (start, length), period in least.items())


def runs_of(words: Words, min_length: int) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each row that has any, by row; starts count from the row's first word."""
    if not len(words):
        return {}
    found = [_begin_direct(words.hash, words.row, min_length), *_begin_doubling(words)]
    first, lag, seen = (np.concatenate(x) for x in zip(*found))
    place = first + seen - 1
    order = np.lexsort((lag, place))
    rows = words.row[first[order]]
    cuts = np.flatnonzero(np.diff(rows)) + 1
    out = {}
    for part in np.split(order, cuts) if len(order) else []:
        row = int(words.row[first[part[0]]])
        lo, hi = int(words.first[row]), int(words.first[row + 1])
        runs = _walk(words.hash[lo:hi].tolist(), list(zip((place[part] - lo).tolist(), (first[part] - lo).tolist(), lag[part].tolist())), min_length)
        if runs:
            out[row] = runs
    return out


def collapsed_spans(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words stay: all but those that a run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, min_length: int = 12, key: str = "doc_id", text: str = "text", collapsed: bool = False) -> DataFrame:
    """Per document: its runs by start, then period; how many; the longest; digests of the runs and of the text without repetitions, or that text itself."""
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("body"))
    schema = T.StructType([kept.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_runs", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in ("start", "length", "period", "exponent_milli")],
                           T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
                           T.StructField("runs", T.ArrayType(_RUN)), *[T.StructField("collapsed", T.StringType())] * collapsed])
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def report(batches):
        for batch in batches:
            data, off = texts_of(batch.column(1))
            counts, lists, longest, run_digests, text_digests, texts = [], [], [], [], [], []
            for a, b in slices(off):
                words = Words(data, off, a, b)
                found = runs_of(words, min_length)
                for row in range(b - a):
                    n, runs = int(words.counts[row]), found.get(row, [])
                    parts = data[off[a + row]:off[a + row + 1]].tobytes().split()
                    if runs:
                        parts = [parts[k] for k in np.flatnonzero(collapsed_spans(runs, n))]
                    whole = b" ".join(parts)
                    counts.append(n)
                    lists.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                    longest.append(min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None))
                    run_digests.append(hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest())
                    text_digests.append(hashlib.sha256(whole).hexdigest())
                    if collapsed:
                        texts.append(whole.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array([len(x) for x in lists], pa.int64()),
                 *[pa.array([r and r[k] for r in longest], pa.int64()) for k in range(3)],
                 pa.array([r and 1000 * r[1] // r[2] for r in longest], pa.int64()),
                 pa.array(run_digests, pa.string()), pa.array(text_digests, pa.string()), pa.array(lists, run_type), *[pa.array(texts, pa.string())] * collapsed],
                names=schema.names)

    return kept.mapInArrow(report, schema)


def with_periodic_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents of which about one in ten, picked by a checksum of its key, goes on repeating a stretch of its own words up to its end."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col(text), BLANKS), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.floor((n - a) / (F.lit(3) + g % 8)).cast("long") + 1
        again = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), again), F.lit(1), n.cast("int")), " ")

    return docs.withColumn(text, F.when((h % 10 == 0) & F.col(text).rlike("[^\\x20\\x09-\\x0D]"), tail(words)).otherwise(F.col(text)))
