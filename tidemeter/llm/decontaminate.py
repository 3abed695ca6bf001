"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton holds every run of words of every item.  A document streams through it word by word; the state
after each word gives the length of the longest run that ends there and still occurs in an item.  Where the
length reaches the window (or a whole shorter item ends), the words of that run are hit.

The automaton grows with the benchmark, not with the corpus.  It is sent to the workers only in parts of about
``PART_WORDS`` item words, a count taken before; a larger benchmark is split by a hash of its items, an item longer than that into
stretches that share no window, and documents pass through the parts one after the other.  The driver builds one part at a
time and sends it out before the next.  Documents are never shuffled; a very long one is looked at as a whole in one task.

Words lower-case A-Z and split at every ASCII byte that is no letter or digit.  Null and empty texts have no
words.  An item without words matches nothing.  Repeated document rows are judged each; items that share an id
count once; one without an id hits words but is not listed.  An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.words import MARKS, Words, slices, texts_of
from tidemeter.session import cut

#: Item words in one automaton: some hundred bytes each, so tens of megabytes at most in a broadcast.
PART_WORDS = 200_000
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TO_WORDS = bytes(0x20 if MARKS[b] else _FOLD[b] for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    """The words of one item, as ``Words(..., MARKS, lower=True)`` finds them."""
    return [w for w in (text or "").encode("utf-8").translate(_TO_WORDS).split(b" ") if w]


class SuffixAutomaton:
    """All word runs of the items; each state knows the items in which its runs occur."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: list[bytes] = sorted({w for _, words in items for w in words})
        ids = {w: i for i, w in enumerate(self.vocabulary)}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = sorted({name for name, words in items if words})
        number = {n: i for i, n in enumerate(self.names)}
        coded = [(number[name], [ids[w] for w in words]) for name, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.step)
        self.owners: list[set[int]] = [set() for _ in range(n)]
        self.ends: list[list[int]] = [[] for _ in range(n)]  # whole items shorter than a window that end here
        for item, words in coded:
            state = 0
            for w in words:
                state = self.step[state][w]
                up = state
                while up > 0 and item not in self.owners[up]:
                    self.owners[up].add(item)
                    up = self.link[up]
            if len(words) < window:
                self.ends[state].append(item)
        self.end_above = [-1] * n  # nearest state up the links, itself included, at which a short item ends
        for state in sorted(range(1, n), key=self.length.__getitem__):
            self.end_above[state] = state if self.ends[state] else self.end_above[self.link[state]]
        self.shortest = min((min(len(w), window) for _, w in coded), default=0)
        pairs = {a * len(ids) + b for _, words in coded for a, b in zip(words, words[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, w: int) -> int:
        known = self.step[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, w)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and w not in self.step[at]:
            self.step[at][w] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            target = self.step[at][w]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, target, w)
        return new

    def _split(self, at: int, target: int, w: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.step[target]))
        self.link[copy], self.link[target] = self.link[target], copy
        while at >= 0 and self.step[at].get(w) == target:
            self.step[at][w] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(-1)
        self.length.append(length)
        return len(self.step) - 1

    def run(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches ``[from, to)`` of a word list, and the numbers of the items that were hit."""
        step, link, length, window = self.step, self.link, self.length, self.window
        state = size = 0
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for at, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                size = length[state]
            to = step[state].get(w)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= window:
                spans.append((at + 1 - size, at + 1))
                up = state
                while length[link[up]] >= window:
                    up = link[up]
                items |= self.owners[up]
            up = self.end_above[state]
            if up > 0 and length[up] > size:  # the state holds longer runs than the one matched
                up = self.end_above[link[up]]
            while up > 0:
                spans.append((at + 1 - length[up], at + 1))
                items.update(self.ends[up])
                up = self.end_above[link[up]]
        return spans, items


class Matcher:
    """Finds item runs in slices of text: candidates by word pairs, then the automaton."""

    def __init__(self, automaton: SuffixAutomaton):
        self.automaton = automaton
        sep = b" ".join(automaton.vocabulary)
        own = Words(np.frombuffer(sep, dtype=np.uint8), np.array([0, len(sep)]), 0, 1, MARKS, lower=True)
        order = np.argsort(own.hash, kind="stable")
        self.hashes, self.ids = own.hash[order], order

    def hits(self, words: Words) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        """By row of the slice: hit stretches (word numbers in the slice) and item numbers."""
        auto, spans, items = self.automaton, {}, {}
        if not len(words) or not len(self.hashes):
            return spans, items
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        ids = np.where(self.hashes[at] == words.hash, self.ids[at], -1)
        pair = ids[:-1] * len(auto.vocabulary) + ids[1:]
        linked = np.zeros(len(words), dtype=bool)
        if len(auto.pairs):
            k = np.minimum(np.searchsorted(auto.pairs, pair), len(auto.pairs) - 1)
            linked[:-1] = (auto.pairs[k] == pair) & (ids[:-1] >= 0) & (ids[1:] >= 0) & (words.row[:-1] == words.row[1:])
        starts = np.flatnonzero((ids >= 0) & ~np.concatenate([[False], linked[:-1]]))
        ends = np.flatnonzero((ids >= 0) & ~linked) + 1
        for a, b in zip(starts, ends):
            if b - a < auto.shortest:
                continue
            run = [int(i) if words.text(a + k).translate(_FOLD) == auto.vocabulary[i] else -1 for k, i in enumerate(ids[a:b].tolist())]
            found, which = auto.run(run)
            if found:
                row = int(words.row[a])
                spans.setdefault(row, []).extend((a + x, a + y) for x, y in found)
                items.setdefault(row, set()).update(which)
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(items: DataFrame, item_key: str, item_text: str, window: int) -> DataFrame:
    """``name``, ``body`` and ``size`` (words) of the items; one of more than ``PART_WORDS`` words in stretches that overlap by all but one of a window."""
    lower = F.translate(F.col("body"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = (items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("body")).filter("body IS NOT NULL")
             .withColumn("words", F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))).filter("size(words) > 0"))
    starts = F.expr(f"CASE WHEN size(words) <= {PART_WORDS + window} THEN array(0) ELSE sequence(0, size(words) - {window}, {PART_WORDS}) END")
    length = F.when(F.size("words") <= PART_WORDS + window, F.size("words")).otherwise(PART_WORDS + window - 1)
    piece = F.slice("words", F.col("start") + 1, length)
    return whole.withColumn("start", F.explode(starts)).select("name", F.array_join(piece, " ").alias("body"), F.size(piece).alias("size"))


def _parts(items: DataFrame, item_key: str, item_text: str, window: int) -> Iterator[tuple[SuffixAutomaton, bool]]:
    """Automata of about ``PART_WORDS`` words, one after the other, and whether it is the last."""
    pieces = cut(_pieces(items, item_key, item_text, window))
    n = max(1, math.ceil((pieces.agg(F.sum("size")).first()[0] or 0) / PART_WORDS))
    for k in range(n):
        part = pieces if n == 1 else pieces.filter(F.pmod(F.xxhash64("name", "body"), F.lit(n)) == k)
        yield SuffixAutomaton([(r.name, item_words(r.body)) for r in part.select("name", "body").collect()], window), k == n - 1


def _found(docs: DataFrame, items: DataFrame, window: int, text: str, item_key: str, item_text: str, keep: list[str], clean: bool) -> DataFrame:
    """``k0``, ``k1`` ... for the kept columns, whose own names may be anything, then the findings."""
    sc = docs.sparkSession.sparkContext
    held = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(*[docs[c].alias(k) for c, k in zip(keep, held)], docs[text].alias("__text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema[:-1]]
    middle = ", ".join([*kinds, "__text string, n_words long, items array<string>, spans array<struct<from:long,to:long>>"])
    out = slim.withColumns({"n_words": F.lit(0).cast("long"), "items": F.array().cast("array<string>"),
                            "spans": F.array().cast("array<struct<from:long,to:long>>")})
    span_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def through(part, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = None
            for batch in batches:
                matcher = matcher or Matcher(part.value)
                names = part.value.names
                data, off = texts_of(batch.column(len(held)))
                counts, items, spans, texts = [], [], [], []
                before_items, before = batch.column(len(held) + 2).to_pylist(), batch.column(len(held) + 3).to_pylist()
                for i, j in slices(off):
                    words = Words(data, off, i, j, MARKS, lower=True)
                    found, which = matcher.hits(words)
                    counts += words.counts.tolist()
                    for r in range(j - i):
                        base = int(words.first[r])
                        spans.append(_merged([(int(a) - base, int(b) - base) for a, b in found.get(r, ())]
                                             + [(s["from"], s["to"]) for s in before[i + r]]))
                        if last and clean:
                            texts.append(_without(words, r, spans[-1]) if spans[-1] else None)
                        items.append(sorted(({names[k] for k in which.get(r, ())} | set(before_items[i + r])) - {""}))
                body = batch.column(len(held))
                if last and clean:
                    body = pc.coalesce(pa.array(texts, pa.string()), body)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in range(len(held))], body, pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())),
                     pa.array([[{"from": a, "to": b} for a, b in s] for s in spans], span_type)],
                    [*held, "__text", "n_words", "items", "spans"])
        return run

    for automaton, last in _parts(items, item_key, item_text, window):
        out = out.mapInArrow(through(sc.broadcast(automaton), last), middle)
    out = out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"]))
    return out.withColumnRenamed("__text", "text") if clean else out.drop("__text")


def benchmark_hits(docs: DataFrame, items: DataFrame, *, window: int = 10, key: str = "doc_id", text: str = "text",
                   item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """What each document shares with the test items.

    Returns ``key``, ``n_words``, ``n_hit``, ``items`` (the hit items' ids as strings, sorted) and ``spans`` (hit
    stretches, by word number).
    """
    found = _found(docs, items, window, text, item_key, item_text, [key], False)
    return found.select(F.col("k0").alias(key), "n_words", "n_hit", "items", "spans")


def _without(words: Words, row: int, spans: list[tuple[int, int]]) -> str:
    """The text of a row without the words of the spans, and without what stands between them and the next word."""
    first, end = int(words.first[row]), int(words.off[row + 1])
    kept, at = [], int(words.off[row])
    for a, b in spans:
        kept.append(words.data[at:words.start[first + a]].tobytes())
        at = int(words.start[first + b]) if b < words.counts[row] else end
    return b"".join([*kept, words.data[at:end].tobytes()]).decode("utf-8")


def items_digest(items) -> F.Column:
    """Lowercase hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(items, ","), 256)


def decontaminated(docs: DataFrame, items: DataFrame, *, window: int = 10, max_coverage: float = 0.5, text: str = "text",
                   item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without benchmark text, in their own columns.

    Hit words go, with the separators up to the next word; a document whose hit words are more than
    ``max_coverage`` of its words goes as a whole.  Documents that share nothing stay as they are.
    """
    rest = [c for c in docs.columns if c != text]
    found = _found(docs, items, window, text, item_key, item_text, rest, True)
    kept = found.filter((F.col("n_hit") == 0) | (F.col("n_hit") <= F.col("n_words") * F.lit(max_coverage)))
    return kept.select(*[F.col("text").alias(c) if c == text else F.col(f"k{rest.index(c)}").alias(c) for c in docs.columns])
