"""Line deduplication by a segment-partition edit join.

A line goes when an earlier line of the corpus (smaller document key, then line number) is at most ``edits``
single-character edits away, if both have ``min_chars`` characters or more; below that an edit makes another line, so a shorter
one goes only if it equals an earlier one.  Lines without a word stay.

Equal lines are settled by their hashes.  The distinct lines are cut into edits + 1 segments each: of two lines
within that distance, at least one segment of one occurs unchanged in the other, near its own place.  So each
line files its segments under (length, segment number, content) and asks, for every length in reach, for its
substrings at the places that the edits allow.  Lines that meet are compared: by the parities of their
character pairs, of which an edit can change four, and then by a banded bit-parallel edit distance, run for many
pairs at once.  Only lines that meet another one ever travel with their text.

Buckets beyond ``BLOCK`` lines are dealt into blocks, and every pair of blocks is a task of its own; lines that are
equal inside one slice of text travel once.  A line needs one earlier neighbour, so no pairs are listed.

Rows with equal key and text are one document and all get its result.  Null and empty texts have no lines worth
a look, an empty table gives an empty one; null keys come first.  Of equal lines in one document the first stays.  A text
is looked at as a whole in one task, however long, with some dozens of bytes for each of its characters.  Extra columns of any
name stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.blocks import dealt
from tidemeter.llm.memo import per_process
from tidemeter.llm.words import BASE, SPACES, mix, powers, slices, texts_of
from tidemeter.session import at_most, cut

EDITS, MIN_CHARS = 2, 20
#: Lines in one block of a bucket.
BLOCK = 512
#: Line ids that may be broadcast instead of shuffling all lines to them: 16 MB.
BROADCAST_IDS = 1_000_000
NULL_KEY = np.iinfo(np.int64).min
#: The characters of ``SPACES``.
_BLANKS = " \t\n\x0b\x0c\r"
_CHECK = np.uint64(0xC2B2AE3D27D4EB4F)


def point_codes(points: np.ndarray) -> np.ndarray:
    """``mix`` of code points plus one: from a table that the process keeps, worked out only beyond its end."""
    table = per_process(("line point codes",), lambda: mix(np.arange(1, 2**16 + 1, dtype=np.uint64)))
    out = table.take(points, mode="clip")
    far = np.flatnonzero(points >= len(table))
    out[far] = mix(points[far].astype(np.uint64) + np.uint64(1))
    return out


class Lines:
    """The lines of rows ``i`` to ``j`` in code points: ``start``, ``size``, ``row``, line ``number`` in its text, and prefix hash sums."""

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int):
        raw = data[off[i]:off[j]]
        self.points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        edges = lead[off[i:j + 1] - off[i]]  # rows in code points
        breaks = np.flatnonzero(self.points == 10)
        starts = np.union1d(edges[:-1][np.diff(edges) > 0], breaks + 1)
        row = np.searchsorted(edges, starts, side="right") - 1
        keep = (starts < edges[-1]) & (row < j - i)
        self.start, self.row = starts[keep], row[keep]
        following = np.concatenate([breaks, [len(self.points)]])
        end = following[np.searchsorted(following, self.start)] if len(self.start) else self.start
        self.size = np.minimum(end, edges[self.row + 1]) - self.start
        self.number = np.searchsorted(breaks, self.start) - np.searchsorted(breaks, edges[:-1])[self.row]
        blank = np.concatenate([[0], np.cumsum((self.points < 128) & SPACES[np.minimum(self.points, 127)])])
        self.blank = blank[self.start + self.size] - blank[self.start] == self.size
        n = len(self.points)
        up, self.down = powers(BASE, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(point_codes(self.points) * up[:n], out=self.sums[1:])

    def hash(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at] + size.astype(np.uint64))

    def text(self, k: int) -> str:
        return self.points[self.start[k]:self.start[k] + self.size[k]].tobytes().decode("utf-32-le")


def _segment(size: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``i`` (from 0) of lines of a size: even parts, the longer ones last."""
    parts = edits + 1
    short = size // parts
    n_short = parts - size % parts
    return i * short + np.maximum(0, i - n_short), short + (i >= n_short)


def _worth(lines: Lines, min_chars: int) -> np.ndarray:
    return np.flatnonzero((lines.size >= min_chars) & ~lines.blank)


def _all_lines(min_chars: int) -> Callable:
    """(uid, doc, body) to one row for each line that has a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, off = texts_of(batch.column(2))
            for i, j in slices(off):
                lines = Lines(data, off, i, j)
                k = _worth(lines, 0)
                h = lines.hash(lines.start[k], lines.size[k])
                other = mix(((lines.sums[lines.start[k] + lines.size[k]] - lines.sums[lines.start[k]]) * lines.down[lines.start[k]]) ^ _CHECK)
                row = i + lines.row[k]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(other.view(np.int64)), pa.array(doc[row]), pa.array(uid[row]),
                                                  pa.array(lines.number[k]), pa.array(lines.size[k] < min_chars)],
                                                 ["line", "check", "doc", "uid", "number", "short"])
    return run


def _segments(edits: int, min_chars: int) -> Callable:
    """Filed segments (odd codes) and questions (even codes) of the lines that are distinct in a slice of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch.column(0))
            for i, j in slices(off):
                lines = Lines(data, off, i, j)
                k = _worth(lines, min_chars)
                line, one = np.unique(lines.hash(lines.start[k], lines.size[k]), return_index=True)
                start, size = lines.start[k[one]], lines.size[k[one]]
                keys, ids, filed = [], [], []
                for less in range(edits + 1):  # lengths asked for: the line's own and up to ``edits`` less
                    target = size - less
                    for s in range(edits + 1):
                        at, length = _segment(target, s, edits)
                        low = max(-s, less - (edits - s))
                        high = min(s, less + (edits - s))
                        for move in range(low, high + 1):
                            p = at + move
                            ok = np.flatnonzero((p >= 0) & (p + length <= size))
                            h = lines.hash(start[ok] + p[ok], length[ok])
                            keys.append(mix(h + mix(target[ok].astype(np.uint64) * np.uint64(64) + np.uint64(s))))
                            ids.append(line[ok])
                            filed.append(np.full(len(ok), less == 0 and move == 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids).view(np.int64)),
                                                  pa.array(np.concatenate(filed))], ["key", "line", "filed"])
    return run


def _texts(min_chars: int) -> Callable:
    """Lines that are distinct in a slice of text, with their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch.column(0))
            for i, j in slices(off):
                lines = Lines(data, off, i, j)
                k = _worth(lines, min_chars)
                line, one = np.unique(lines.hash(lines.start[k], lines.size[k]), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(line.view(np.int64)), pa.array([lines.text(int(x)) for x in k[one]], pa.string())], ["line", "body"])
    return run


class Bodies:
    """Code points of many lines, with the parities of their character pairs."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        bit = (mix(self.points[:-1] * np.uint64(0x1F123BB5) ^ self.points[1:]) & np.uint64(255)).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), self.size)
        inner = np.flatnonzero(row[:-1] == row[1:])
        odd = np.bincount(row[inner] * 256 + bit[inner], minlength=256 * len(texts)) & 1
        self.marks = np.packbits(odd.astype(np.uint8).reshape(len(texts), 256), axis=1, bitorder="little").view(np.uint64)

    def may_match(self, x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
        """An edit changes at most four parities: two pairs go and two come."""
        ok = np.abs(self.size[x] - self.size[y]) <= edits
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(self.marks[x[at]] ^ self.marks[y[at]]).sum(axis=1) <= 4 * edits
        return ok

    def within(self, x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
        """Whether pairs of lines are at most ``edits`` edits apart.

        Column by column, bit r stands for row column - edits + r of the distance table; VP and VN hold where the
        distance rises and falls downward.  The sum follows the lower edge of the band until it meets the last
        row, and then that row.  A pair leaves when its sum can no longer come down far enough.
        """
        out = np.zeros(len(x), dtype=bool)
        width = 2 * edits + 1
        one, mask = np.uint64(1), np.uint64((1 << width) - 1)
        m, n = self.size[x], self.size[y]
        live = np.flatnonzero(np.abs(m - n) <= edits)
        total = np.full(len(live), edits, dtype=np.int64)
        vp = np.full(len(live), ((1 << (edits + 1)) - 1) << edits, dtype=np.uint64)
        vn = np.zeros(len(live), dtype=np.uint64)
        last = len(self.points) - 1
        j = 0
        while len(live):
            j += 1
            a, size, b = self.at[x[live]], m[live], self.points[np.minimum(self.at[y[live]] + j - 1, last)]
            pm = np.zeros(len(live), dtype=np.uint64)
            for r in range(width):
                i = j - edits + r - 1
                if i >= 0:
                    same = (i < size) & (self.points[np.minimum(a + i, last)] == b)
                    pm |= same.astype(np.uint64) << np.uint64(r)
            d0 = (((((pm & vp) + vp) ^ vp) | pm | vn)) & mask
            hp = (vn | ~(d0 | vp)) & mask
            hn = d0 & vp
            down = j + edits <= size  # the lower edge is still inside the table
            total += np.where(down, ((d0 >> np.uint64(2 * edits)) & one) == 0, 0)
            bit = np.clip(size - j + edits, 0, 63).astype(np.uint64)
            total += np.where(down, 0, ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
            vp = (hn | ~((d0 >> one) | hp)) & mask
            vn = (d0 >> one) & hp
            done = j >= n[live]
            out[live[done & (total <= edits)]] = True
            go = ~done & (total <= edits + np.where(down, 2 * edits, n[live] - j))
            live, total, vp, vn = live[go], total[go], vp[go], vn[go]
        return out


def _later_ones(edits: int) -> Callable:
    """From rows sorted by bucket and block pair: lines that have an earlier one within reach."""
    def work(t: pa.Table, starts: np.ndarray) -> np.ndarray:
        i, j, salt, line, doc, uid, number = (t.column(c).to_numpy() for c in ("i", "j", "salt", "line", "doc", "uid", "number"))
        body = t.column("body").to_pylist()
        distinct, where, code = np.unique(line, return_index=True, return_inverse=True)
        lines = Bodies([body[k] for k in where])
        rank = np.empty(len(distinct), dtype=np.int64)
        rank[np.lexsort((number[where], uid[where], doc[where]))] = np.arange(len(distinct))
        gone = np.zeros(len(distinct), dtype=bool)
        ends = np.append(starts[1:], len(line))
        group = np.repeat(np.arange(len(starts)), ends - starts)
        small = ends - starts <= 16

        def test(x: np.ndarray, y: np.ndarray) -> None:
            """Rows x and y may be near: marks the later line of each pair that is."""
            a, b = code[x], code[y]
            first, second = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
            use = (a != b) & ~gone[second]
            pair = np.unique(first[use] * len(distinct) + second[use])
            first, second = pair // len(distinct), pair % len(distinct)
            ok = lines.may_match(first, second, edits)
            first, second = first[ok], second[ok]
            while len(first):  # the likeliest earlier line first; most lines need no other
                differ = np.bitwise_count(lines.marks[first] ^ lines.marks[second]).sum(axis=1)
                order = np.lexsort((differ, second))
                lead = np.ones(len(order), dtype=bool)
                lead[1:] = second[order][1:] != second[order][:-1]
                now = order[lead]
                gone[second[now[lines.within(first[now], second[now], edits)]]] = True
                rest = np.ones(len(first), dtype=bool)
                rest[now] = False
                rest &= ~gone[second]
                first, second = first[rest], second[rest]

        for step in range(1, 16):
            if step < len(group):
                x = np.flatnonzero((group[:-step] == group[step:]) & small[group[:-step]])
                x = x[(i[x] == j[x]) | (salt[x] != salt[x + step])]
                test(x, x + step)
        for k in np.flatnonzero(~small):
            lo, hi = int(starts[k]), int(ends[k])
            rows = np.arange(lo, hi)
            for part in np.array_split(rows, max(1, len(rows) // 256)):
                x, y = np.repeat(part, len(rows)), np.tile(rows, len(part))
                ok = (rank[code[x]] < rank[code[y]]) & ~gone[code[y]]
                if i[lo] != j[lo]:
                    ok &= salt[x] != salt[y]
                test(x[ok], y[ok])
        return distinct[gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def starts(t: pa.Table) -> np.ndarray:
            change = np.ones(t.num_rows, dtype=bool)
            cols = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            return np.flatnonzero(change)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 10_000:
                t = pa.Table.from_batches(held).combine_chunks()
                at = starts(t)
                if at[-1] > 0:
                    yield pa.RecordBatch.from_arrays([pa.array(work(t.slice(0, int(at[-1])), at[:-1]))], ["line"])
                    t = t.slice(int(at[-1])).combine_chunks()
                held, size = t.to_batches(), 0
        if size or held:
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(work(t, starts(t)))], ["line"])
    return run


def _few(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is among ``ids``, which are broadcast if they are few."""
    return rows.join(F.broadcast(ids) if at_most(ids, BROADCAST_IDS) else ids, column, "left_semi")


def _removed(docs: DataFrame, key: str, text: str, edits: int, min_chars: int) -> DataFrame:
    """``uid``, the ``numbers`` of the lines that go and ``n_long``, how many of them reach ``min_chars``; documents that lose none are left out."""
    body = docs.select(F.coalesce(docs[key].cast("long"), F.lit(int(NULL_KEY))).alias("doc"), docs[text].alias("body"),
                       F.xxhash64(docs[key], docs[text]).alias("uid"))
    lines = cut(body.select("uid", "doc", "body").mapInArrow(_all_lines(min_chars),
                                                                "line long, check long, doc long, uid long, number long, short boolean"))
    place = F.struct("doc", "uid", "number")
    firsts = lines.groupBy("line", "check").agg(F.min(place).alias("first"))
    met = (body.select("body").mapInArrow(_segments(edits, min_chars), "key long, line long, filed boolean").repartition("key")
           .selectExpr("key", "line", "min(line) OVER (PARTITION BY key) <> max(line) OVER (PARTITION BY key) "
                       "AND bool_or(filed) OVER (PARTITION BY key) AS met"))
    met = cut(met.filter("met").select("key", "line").distinct())
    wanted = cut(met.select("line").distinct())
    placed = cut(_few(firsts.groupBy("line").agg(F.min("first").alias("first")), wanted, "line").select("line", "first.*"))
    texts = cut(_few(_few(body, placed.select("uid").distinct(), "uid").select("body").mapInArrow(_texts(min_chars), "line long, body string"), wanted, "line")
                .groupBy("line").agg(F.first("body").alias("body")))
    known = texts.join(placed, "line").select("line", "body", "doc", "uid", "number")
    parts = met.groupBy("key").agg(F.expr(f"CAST(ceil(count(1) / {BLOCK}) AS BIGINT)").alias("parts"))
    later = (dealt(met, "key", "line", parts).join(known, "line").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
             .mapInArrow(_later_ones(edits), "line long").distinct())
    fate = firsts.join(later.withColumn("near", F.lit(True)), "line", "left")
    return (lines.join(fate, ["line", "check"]).filter(F.col("near") | (place != F.col("first")))
            .groupBy("uid").agg(F.array_sort(F.collect_set("number")).alias("numbers"), F.count_if(~F.col("short")).alias("n_long")))


def line_report(docs: DataFrame, *, edits: int = EDITS, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_lines`` (of the whole text, split at line feeds), ``n_removed`` and ``removed_lines`` (their numbers, from 0)."""
    slim = docs.select(docs[key].alias("k0"), F.xxhash64(docs[key], docs[text]).alias("uid"),
                       F.coalesce(F.size(F.split(docs[text], "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    numbers = F.coalesce("numbers", F.array().cast("array<long>"))
    return (slim.join(_removed(docs, key, text, edits, min_chars), "uid", "left")
            .select(F.col("k0").alias(key), "n_lines", F.size(numbers).cast("long").alias("n_removed"), numbers.alias("removed_lines")))


def without_repeated_lines(docs: DataFrame, *, edits: int = EDITS, min_chars: int = MIN_CHARS, drop_emptied: bool = False, key: str = "doc_id",
                           text: str = "text") -> DataFrame:
    """The documents in their own columns, without the lines that go; what loses no line stays as it is.

    With ``drop_emptied`` a document goes as a whole if every line of it that has a word goes, as in a copy of others, or if it loses
    lines of ``min_chars`` or more and what is left holds less than half of its words, as in a near copy: that is no document.
    """
    gone = _removed(docs, key, text, edits, min_chars)
    names = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    slim = docs.select(*[docs[c].alias(k) for c, k in names.items()], F.xxhash64(docs[key], docs[text]).alias("uid"))
    at = docs.columns.index(text)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stays = [], []
            for t, n, n_long in zip(*(batch.column(k).to_pylist() for k in (at, len(names), len(names) + 1))):
                if not n:
                    texts.append(None)
                    stays.append(True)
                    continue
                out = set(n)
                texts.append("\n".join([x for k, x in enumerate(t.split("\n")) if k not in out]))
                own = len(texts[-1].encode().split())
                stays.append(own > 0 and (not n_long or 2 * own >= len(t.encode().split())))
            cols = batch.columns[:len(names)]
            cols[at] = pc.coalesce(pa.array(texts, pa.string()), cols[at])
            out = pa.RecordBatch.from_arrays(cols, batch.schema.names[:len(names)])
            yield out.filter(pa.array(stays, pa.bool_())) if drop_emptied else out

    rows = slim.join(gone, "uid", "left").select(*names.values(), "numbers", "n_long")
    rows = rows.mapInArrow(left, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:len(names)]))
    return rows.select(*[F.col(k).alias(c) for c, k in names.items()])
