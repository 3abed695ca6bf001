"""Word runs of one length around content-selected anchors: which occur again, and what is left without the later ones.

Shared by the operators that look for repeated passages; they differ in how they find the anchors worth a look.
Every run belongs to one anchor, so the runs of an anchor travel in one row: their hashes, and as bits those
already settled inside the slice of text.  Anchors that are frequent in the corpus would gather many rows under
one key; their runs travel one by one, under the hash of the run.

Where links are asked for, each removed run is traced to the document that holds its first copy in the corpus.  A run settled
inside a slice of text asks the document with the slice's first copy, in stretches, and gets what that document's own runs
were traced to.  So the links do not depend on slices and partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.words import Words, anchors, mix, slices, texts_of

#: Anchors that count as frequent: at least so many rows, the most frequent ones; half a megabyte in the broadcast.
FREQUENT, FREQUENT_LISTED = 2_000, 1 << 16
NULL_KEY = np.iinfo(np.int64).min
#: What rows of runs have besides if documents are linked: ``n`` runs whose first copies in the slice start at ``head_start``.
LINKS = ("shared", "head", "head_doc", "head_start", "n")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def frequent_anchors(body: DataFrame, short: int, reach: int) -> np.ndarray:
    """Sorted hashes of the frequent anchors of ``body`` (column ``body``); only how rows travel depends on them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch.column(0))
            for i, j in slices(off):
                h, n = np.unique(anchors(Words(data, off, i, j), short, reach)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(h[n > 3]), pa.array(n[n > 3])], ["h", "n"])

    top = (body.select("body").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
           .orderBy(F.desc("n"), "h").limit(FREQUENT_LISTED).collect())
    return np.sort(np.array([r.h for r in top], dtype=np.int64).view(np.uint64))


def _split_hot(key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(key), dtype=bool)
    return hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key


def _leaders(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For sorted items, the first item of each one's class."""
    return order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order


def runs_around(size: int, short: int, reach: int, worth: Callable[[np.ndarray, np.ndarray], np.ndarray], hot, links: bool) -> Callable:
    """From (uid, doc, body, places) to rows of runs.  A run's anchor is among its first ``reach`` short windows.

    ``worth`` says from the anchor's shift in the run and its flags whether the run can be repeated at all; a place
    is 4 * word number + flags.
    """
    def work(uid, doc, data, off, i, j, marks, mark_off):
        words = Words(data, off, i, j)
        starts, owner, _, _ = anchors(words, short, reach)
        if not len(starts):
            return
        flags = np.zeros(len(words), dtype=np.int64)
        for r in range(j - i):
            m = marks[mark_off[i + r]:mark_off[i + r + 1]]
            m = m[(m >> 2) < words.counts[r]]
            np.bitwise_or.at(flags, words.first[r] + (m >> 2), 4 | (m & 3))
        flag = flags[owner]
        ok = ((flag & 4) > 0) & (starts + size <= words.first[words.row[starts] + 1])
        ok &= worth(owner - starts, flag)
        starts, owner = starts[ok], owner[ok]
        if not len(starts):
            return
        full = words.span_hash(starts, size)
        row = words.row[starts]
        at, own, of = starts - words.first[row], uid[i + row], doc[i + row]
        order = np.lexsort((at, own, of, full))
        new = np.ones(len(order), dtype=bool)
        new[1:] = full[order][1:] != full[order][:-1]
        head = np.zeros(len(order), dtype=np.int64)
        head[order] = _leaders(order, new)
        first = (own == own[head]) & (of == of[head]) & (at == at[head])  # also where a document is given twice
        leads = np.zeros(len(order), dtype=bool)
        leads[head[~first]] = True
        anchor = words.span_hash(owner, short)
        alone = _split_hot(anchor, hot.value) & first
        # one row for each anchor; the runs of a frequent anchor that are still open get their own
        change = np.ones(len(owner), dtype=bool)
        change[1:] = (owner[1:] != owner[:-1]) | alone[1:] | alone[:-1]
        groups = np.flatnonzero(change)
        base = np.repeat(starts[groups], np.diff(np.append(groups, len(owner))))
        bit = np.left_shift(np.uint64(1), (starts - base).astype(np.uint64))
        none = np.uint64(0)
        asked, gone, shared = (np.bitwise_or.reduceat(np.where(x, bit, none), groups) for x in (first, ~first, leads))
        n_open = np.add.reduceat(first.astype(np.int64), groups)
        key = np.where(n_open > 0, np.where(alone[groups], full[groups], anchor[groups]),
                       mix(own[groups].view(np.uint64) ^ mix(starts[groups].astype(np.uint64))))
        ends = np.concatenate([[0], np.cumsum(n_open)]).astype(np.int32)
        cols = [signed(key), pa.array(own[groups]), pa.array(of[groups]), pa.array(at[groups]), signed(asked), signed(gone),
                pa.ListArray.from_arrays(pa.array(ends), signed(full[first]))]
        names = ["key", "uid", "doc", "start", "asked", "gone", "hashes"]
        if not links:
            yield pa.RecordBatch.from_arrays(cols, names)
            return
        zeros = pa.array(np.zeros(len(groups), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*cols, signed(shared), zeros, zeros, zeros, zeros], [*names, *LINKS])
        # stretches of runs settled here, each with the place of its first copy in this slice
        f = np.flatnonzero(~first)
        if len(f):
            h = head[f]
            change = np.ones(len(f), dtype=bool)
            change[1:] = (np.diff(row[f]) != 0) | (np.diff(at[f]) != 1) | (np.diff(row[h]) != 0) | (np.diff(at[h]) != 1)
            begin = np.flatnonzero(change)
            n, f, h = np.diff(np.append(begin, len(f))), f[begin], h[begin]
            zeros = pa.array(np.zeros(len(f), dtype=np.int64))
            key = mix(own[f].view(np.uint64) ^ mix(starts[f].astype(np.uint64)))
            hashes = pa.ListArray.from_arrays(pa.array(np.zeros(len(f) + 1, dtype=np.int32)), pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([signed(key), pa.array(own[f]), pa.array(of[f]), pa.array(at[f]), zeros, zeros, hashes, zeros,
                                              pa.array(own[h]), pa.array(of[h]), pa.array(at[h]), pa.array(n)], [*names, *LINKS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, off = texts_of(batch.column(2))
            places = batch.column(3)
            marks, mark_off = places.values.to_numpy(zero_copy_only=False), places.offsets.to_numpy()
            for i, j in slices(off):
                yield from work(uid, doc, data, off, i, j, marks, mark_off)
    return run


def _settled(pieces: list[pa.RecordBatch], links: bool) -> pa.RecordBatch:
    """Which runs of the rows, whole groups by key, start later than an equal one."""
    t = pa.Table.from_batches(pieces).combine_chunks()
    uid, doc, start, key = (t.column(n).to_numpy() for n in ("uid", "doc", "start", "key"))
    asked, gone = (t.column(n).to_numpy().view(np.uint64).copy() for n in ("asked", "gone"))
    hashes = t.column("hashes").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int64()))
    full = hashes.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(key)), np.diff(hashes.offsets.to_numpy()))
    bits = np.unpackbits(asked.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    place = np.nonzero(bits)[1]
    at = start[row] + place
    order = np.lexsort((at, uid[row], doc[row], full, key[row]))
    r, f = row[order], full[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (f[1:] != f[:-1]) | (key[r][1:] != key[r][:-1])
    head = np.zeros(len(order), dtype=np.int64)
    head[order] = _leaders(order, new)
    first = (doc[row[head]] == doc[row]) & (uid[row[head]] == uid[row]) & (at[head] == at)
    bit = np.left_shift(np.uint64(1), place.astype(np.uint64))
    np.bitwise_or.at(gone, row[~first], bit[~first])
    if not links:
        some = gone != 0
        return pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(doc[some]), pa.array(start[some]), signed(gone[some])],
                                          ["uid", "doc", "start", "gone"])
    shared = t.column("shared").to_numpy().view(np.uint64).copy()
    leads, later = head[~first], row[~first]
    np.bitwise_or.at(shared, row[leads], bit[leads])
    # the first copy's document for each bit of ``told``; one for all where they agree
    told = np.zeros(len(key), dtype=np.uint64)
    np.bitwise_or.at(told, later, bit[~first])
    source = doc[row[leads]]
    fresh = np.ones(len(later), dtype=bool)
    fresh[1:] = later[1:] != later[:-1]
    alike = np.ones(len(key), dtype=bool)
    alike[later[1:][~fresh[1:] & (source[1:] != source[:-1])]] = False
    listed = fresh | ~alike[later]
    ends = np.concatenate([[0], np.cumsum(np.bincount(later[listed], minlength=len(key)))]).astype(np.int32)
    sources = pa.ListArray.from_arrays(pa.array(ends), pa.array(source[listed]))
    asks = [t.column(c).combine_chunks() for c in LINKS[1:]]
    some = pa.array(((gone | shared) != 0) | (t.column("n").to_numpy() > 0))
    return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(doc), pa.array(start), signed(gone), signed(shared), signed(told), sources, *asks],
                                      ["uid", "doc", "start", "gone", "shared", "told", "sources", *LINKS[1:]]).filter(some)


def settle(links: bool) -> Callable:
    """Over rows sorted by key: whole groups at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            if size >= 20_000 and (key[0] != last or key[-1] != last):
                edge = 0 if key[0] != last else int(np.argmax(key != last))
                yield _settled([*held, batch.slice(0, edge)], links)
                held, size, batch = [], 0, batch.slice(edge)
            held.append(batch)
            size += batch.num_rows
            last = key[-1]
        if held:
            yield _settled(held, links)
    return run


def _bits(field: int) -> Iterator[int]:
    bits = field & 0xFFFFFFFFFFFFFFFF
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (asks, told) of the documents asked to (uid, doc, sources) of those that ask."""
    for batch in batches:
        uids, docs, sources = [], [], []
        for asks, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for head in {a["head_doc"] for a in asks}:
                own = [a for a in asks if a["head_doc"] == head]
                source = np.full(max(a["head_start"] + a["n"] for a in own), head, dtype=np.int64)  # a run that was not traced is the first copy
                for g in told or ():
                    if g["doc"] == head:
                        for k, b in enumerate(_bits(g["told"])):
                            if g["start"] + b < len(source):
                                source[g["start"] + b] = g["sources"][k if len(g["sources"]) > 1 else 0]
                for a in own:
                    uids.append(a["uid"])
                    docs.append(a["doc"])
                    sources.append(np.unique(source[a["head_start"]:a["head_start"] + a["n"]]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(docs, pa.int64()), pa.array(sources, pa.list_(pa.int64()))],
                                         ["uid", "doc", "sources"])


def _linked(found: DataFrame) -> DataFrame:
    """Settled runs with the ``sources`` of all of them, those settled inside a slice included."""
    told = found.filter("told <> 0").groupBy("uid").agg(F.collect_list(F.struct("doc", "start", "told", "sources")).alias("told"))
    asks = found.filter("n > 0").groupBy("head").agg(F.collect_list(F.struct("uid", "doc", "head_doc", "head_start", "n")).alias("asks"))
    answers = (asks.join(told, asks["head"] == told["uid"], "left").select("asks", "told")
               .mapInArrow(_answers, "uid long, doc long, sources array<long>"))
    names = ["uid", "doc", "start", "gone", "shared", "sources"]
    return (found.filter("gone <> 0 OR shared <> 0").select(*names)
            .unionByName(answers.selectExpr("uid", "doc", "0L AS start", "0L AS gone", "0L AS shared", "sources")))


def _words_of(rows: list[dict], field: str, doc: int, size: int, n: int) -> np.ndarray:
    """Which words lie in the runs that the bits of ``field`` name."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for g in rows:
        for b in _bits(g[field]) if g["doc"] == doc else ():
            edge[g["start"] + b] += 1
            edge[g["start"] + b + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def spans_of(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"from": int(a), "to": int(b)} for a, b in zip(edge[::2], edge[1::2])]


SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def kept(size: int, texts: bool, links: bool) -> Callable:
    """From (k0, body, doc, gone) to what is left of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, order, found = batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n_words, n_removed, digests, left_texts, n_repeated, spans, sources = [], [], [], [], [], [], []
            for r in range(batch.num_rows):
                words = (bodies[r].as_py() or "").encode("utf-8").split()  # exactly the separators of ``SPACES``
                rows = found[r] or []
                stay = words
                out = _words_of(rows, "gone", order[r], size, len(words)) if rows else np.zeros(len(words), dtype=bool)
                if rows:
                    stay = [w for w, x in zip(words, out.tolist()) if not x]
                left = b" ".join(stay)
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
                digests.append(hashlib.sha256(left).hexdigest())
                if texts:
                    left_texts.append(left.decode("utf-8"))
                if links:
                    n_repeated.append(int((out | _words_of(rows, "shared", order[r], size, len(words))).sum()) if rows else 0)
                    spans.append(spans_of(out))
                    sources.append(sorted({s for g in rows if g["doc"] == order[r] for s in g["sources"]} - {int(NULL_KEY)}))
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["k0", "n_words", "n_removed", "kept_sha256"]
            if texts:
                cols.append(pa.array(left_texts, pa.string()))
                names.append("kept_text")
            if links:
                cols += [pa.array(n_repeated, pa.int64()), pa.array(spans, SPANS), pa.array(sources, pa.list_(pa.int64()))]
                names += ["n_repeated", "removed_spans", "earlier_docs"]
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def bodies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k0`` the key, ``body`` the text, ``uid`` a hash of both."""
    return docs.select(docs[key].alias("k0"), docs[text].alias("body")).withColumn("uid", F.xxhash64("k0", "body"))


def without_repeats(body: DataFrame, repeated: DataFrame, size: int, short: int, reach: int, worth: Callable, *, texts: bool, links: bool,
                    key: str) -> DataFrame:
    """The later copies of runs of ``size`` words go.  ``repeated``: ``uid`` and the ``places`` of anchors worth a look."""
    doc = F.coalesce(F.col("k0").cast("long"), F.lit(int(NULL_KEY))).alias("doc")  # the key's place in the order, null first
    # Both joins ask for the same three columns of the texts, so Spark shuffles them once.
    hot = body.sparkSession.sparkContext.broadcast(frequent_anchors(body, short, reach))
    asks = ", head long, head_doc long, head_start long, n long"
    more, traced = (", shared long" + asks, ", shared long, told long, sources array<long>" + asks) if links else ("", "")
    runs = (body.join(repeated, "uid").select("uid", doc, "body", "places")
            .mapInArrow(runs_around(size, short, reach, worth, hot, links), f"key long, uid long, doc long, start long, asked long, gone long, hashes array<long>{more}"))
    found = runs.repartition("key").sortWithinPartitions("key").mapInArrow(settle(links), f"uid long, doc long, start long, gone long{traced}")
    found = _linked(found) if links else found
    gone = found.groupBy("uid").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "uid"])).alias("gone"))
    schema = f"k0 {body.schema['k0'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    schema += ", kept_text string" * texts + ", n_repeated long, removed_spans array<struct<from:long,to:long>>, earlier_docs array<long>" * links
    return body.join(gone, "uid", "left").select("k0", "body", doc, "gone").mapInArrow(kept(size, texts, links), schema).withColumnRenamed("k0", key)
