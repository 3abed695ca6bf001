"""Grouped prefix join on word shingles: which documents have nearly the same shingle set, and their components.

A document's shingles are put in one order for all: common ones last, then by hash.  Sets that reach the
similarity share a token in their first few (the prefix).  Documents with the same prefix and the same set size
form one group, and the join runs over groups: those that share a prefix token and fit in size are expanded to
their members, which are compared by parity bitmaps of their whole sets, an upper bound of the overlap.  What passes
ties documents together; within each tied set the whole shingle sets are verified.

Only buckets of a few documents list their pairs.  A larger bucket or tied set is searched for a spanning forest: each
member is compared with those not yet reached, once.  Beyond a size it is dealt into blocks, and every pair of blocks
is a task of its own, so a hot token or a group of copies never sits in one task.  Equal sets count once.

The order by frequency is found by a pass over all documents that keeps the tokens frequent within a slice of text; the
``ORDERED_TOKENS`` most frequent are broadcast.  Any order gives the same result; this one keeps buckets small.

Words lower-case A-Z.  A document with fewer words than a shingle has its whole word sequence as one shingle; null
and empty texts have none and link with nothing.  Rows with the same key are one document, linked by any of their
texts.  A null key has a null component unless linked.  Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.graph import components
from tidemeter.llm.words import Words, mix, slices, texts_of
from tidemeter.session import at_most, cut

#: Tokens whose frequency class takes part in the order, the most frequent ones: a megabyte in the broadcast.
ORDERED_TOKENS = 1 << 16
#: A token counts as common from so many documents.
COMMON = 32
#: Documents up to which a token's bucket lists its pairs, and in one block of a larger one.
FEW, BLOCK = 8, 512
#: Documents and shingles in one block of a tied set.
MEMBERS, SHINGLES = 1024, 1_000_000
#: Ids that may be broadcast instead of shuffling the texts to them: 16 MB.
BROADCAST_IDS = 1_000_000
_NULL_KEY = np.iinfo(np.int64).min


def prefix_size(n, num: int, den: int):
    """Tokens among which two sets of similarity ``num / den`` share one."""
    return n - (n * num + den - 1) // den + 1


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle) of a slice, sorted by row and hash."""
    at, h = words.windows(size)
    row = words.row[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        h = np.concatenate([h, words.span_hash(words.first[short], words.counts[short])])
        row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _frequent(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch.column(0))
            for i, j in slices(off):
                _, h = shingles(Words(data, off, i, j, lower=True), size)
                token, n = np.unique(h, return_counts=True)
                token, n = token[n > 2], n[n > 2]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])
    return run


def token_order(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Sorted common tokens and their frequency classes, as two rows."""
    top = (docs.select(docs[text].alias("body")).mapInArrow(_frequent(size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
           .filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(ORDERED_TOKENS).collect())
    token = np.array([r.token for r in top], dtype=np.int64).view(np.uint64)
    level = np.log2(np.array([r.n for r in top], dtype=float)).astype(np.uint64) if len(top) else np.zeros(0, np.uint64)
    order = np.argsort(token)
    return np.stack([token[order], level[order]])


def _bitmap_bits(n: int) -> int:
    """Bits of the parity bitmap for sets of ``n``: a power of two of at least the set's size, 512 to 65,536."""
    return 1 << min(16, max(9, (n - 1).bit_length()))


def _sum_hash(tokens: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each row's token set; row r has the tokens from ``first[r]`` to ``first[r + 1]``."""
    sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(mix(tokens ^ np.uint64(seed)), out=sums[1:])
    return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def _signatures(size: int, num: int, den: int, common) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, levels = common.value
        for batch in batches:
            data, off = texts_of(batch.column(1))
            for i, j in slices(off):
                row, h = shingles(Words(data, off, i, j, lower=True), size)
                n = np.bincount(row, minlength=j - i)
                level = np.zeros(len(h), dtype=np.uint64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                    level = np.where(tokens[at] == h, levels[at], 0).astype(np.uint64)
                order = np.lexsort((h, level, row))
                h = h[order]
                first = np.concatenate([[0], np.cumsum(n)])
                a, b = (_sum_hash(h, first, s) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
                p = np.where(n > 0, prefix_size(n, num, den), 0)
                inside = np.arange(len(h)) - first[row] < p[row]
                token, owner = h[inside], row[inside]
                cut_ = np.concatenate([[0], np.cumsum(p)])
                pa_, pb = (_sum_hash(token, cut_, s) for s in (0x2545F4914F6CDD1D, 0x27BB2EE687B0B0FD))
                bits = []
                for r in range(j - i):
                    width = _bitmap_bits(int(n[r])) if n[r] else 64
                    odd = np.bincount((mix(h[first[r]:first[r + 1]]) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                    bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(a), pa.array(b), pa.array(pa_), pa.array(pb),
                     pa.ListArray.from_arrays(pa.array(cut_.astype(np.int32)), pa.array(token.view(np.int64))), pa.array(bits, pa.binary())],
                    ["id", "n", "a", "b", "pa", "pb", "prefix", "bits"])
    return run


def _whole_groups(work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], n_keys: int, rows: int = 20_000) -> Callable:
    """Feeds ``work`` with whole groups of rows sorted by their first columns, and where the groups start."""
    def starts(t: pa.Table) -> np.ndarray:
        change = np.ones(t.num_rows, dtype=bool)
        if t.num_rows:
            change[1:] = False
            for k in range(n_keys):
                c = t.column(k).to_numpy()
                change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                t = pa.Table.from_batches(held).combine_chunks()
                at = starts(t)
                if at[-1] > 0:
                    yield from work(t.slice(0, int(at[-1])), at[:-1])
                    t = t.slice(int(at[-1])).combine_chunks()
                held, size = t.to_batches(), 0
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from work(t, starts(t))
    return run


class _Bound:
    """Whether two sets can share enough: sizes and parity bitmaps of a table of documents."""

    def __init__(self, n: np.ndarray, bits: list[bytes], num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.width = np.array([len(b) * 8 for b in bits])
        self.rows: dict[int, np.ndarray] = {}
        self.maps: dict[int, np.ndarray] = {}
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width == w)
            self.rows[int(w)] = at
            self.maps[int(w)] = np.frombuffer(b"".join([bits[k] for k in at]), dtype=np.uint64).reshape(len(at), -1)
        self.place = np.zeros(len(n), dtype=np.int64)
        for at in self.rows.values():
            self.place[at] = np.arange(len(at))

    def _at(self, rows: np.ndarray, width: int, to: int) -> np.ndarray:
        m = self.maps[width][self.place[rows]]
        while width > to:  # parity folds: bit numbers are the hash modulo the width
            half = m.shape[1] // 2
            m, width = m[:, :half] ^ m[:, half:], width // 2
        return m

    def passes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs of rows; a false answer is certain."""
        nx, ny = self.n[x], self.n[y]
        ok = (np.minimum(nx, ny) * self.den >= self.num * np.maximum(nx, ny))
        most = nx + ny - 2 * -(-self.num * (nx + ny) // (self.num + self.den))  # tokens in one set only
        where = np.flatnonzero(ok)
        wx, wy = self.width[x[where]], self.width[y[where]]
        for a, b in {(int(a), int(b)) for a, b in zip(*np.unique(np.stack([wx, wy]), axis=1))} if len(where) else ():
            part = where[(wx == a) & (wy == b)]
            to = min(a, b)
            for lo in range(0, len(part), 8192):
                q = part[lo:lo + 8192]
                differ = np.bitwise_count(self._at(x[q], a, to) ^ self._at(y[q], b, to)).sum(axis=1, dtype=np.int64)
                ok[q] = differ <= most[q]
        return ok


def _forest(n: int, side: np.ndarray | None, reach: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest: each member asks once which of those not yet reached it is tied to.

    With ``side`` only members of different sides are compared.
    """
    left, right = [], []
    open_ = np.ones(n, dtype=bool)
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(open_ if side is None else open_ & (side != side[x]))
            if not len(rest):
                continue
            hit = rest[reach(x, rest)]
            open_[hit] = False
            left += [x] * len(hit)
            right += hit.tolist()
            queue += hit.tolist()
    return left, right


def _met(num: int, den: int) -> Callable:
    """From rows sorted by token: pairs of groups in small buckets; the rows of large ones."""
    def work(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, gid, n, members, size = (t.column(c).to_numpy() for c in ("token", "gid", "n", "members", "size"))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(token))))
        few = size <= FEW
        same = np.flatnonzero(few & (members > 1))
        left, right = [gid[same]], [gid[same]]
        for step in range(1, FEW):
            if step < len(group):
                x = np.flatnonzero((group[:-step] == group[step:]) & few[:-step])
                x = x[np.minimum(n[x], n[x + step]) * den >= num * np.maximum(n[x], n[x + step])]
                left.append(np.minimum(gid[x], gid[x + step]))
                right.append(np.maximum(gid[x], gid[x + step]))
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        many = np.flatnonzero(~few)
        none = np.zeros(pairs.shape[1], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[0], gid[many]])), pa.array(np.concatenate([pairs[1], gid[many]])),
                                          pa.array(np.concatenate([none, token[many]])), pa.array(np.concatenate([none, size[many]]))],
                                         ["a", "b", "token", "size"])
    return _whole_groups(work, 1)


def _tie_pairs(num: int, den: int) -> Callable:
    """Pairs of documents that pass the bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            k = batch.num_rows
            both = _Bound(np.concatenate([col["xn"].to_numpy(), col["yn"].to_numpy()]), col["xbits"].to_pylist() + col["ybits"].to_pylist(), num, den)
            ok = pa.array(both.passes(np.arange(k), np.arange(k, 2 * k)))
            yield pa.RecordBatch.from_arrays([col["xrep"].filter(ok), col["yrep"].filter(ok)], ["a", "b"])
    return run


def _tie_buckets(num: int, den: int) -> Callable:
    """Forest edges between the documents of a bucket that pass the bound."""
    def work(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, salt, rep, n = (t.column(c).to_numpy() for c in ("i", "j", "salt", "rep", "n"))
        bound = _Bound(n, t.column("bits").to_pylist(), num, den)
        left, right = [], []
        for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(rep)).tolist()):
            a, b = _forest(hi - lo, None if i[lo] == j[lo] else salt[lo:hi],
                           lambda x, rest: bound.passes(np.full(len(rest), lo + x), lo + rest))
            left += [lo + x for x in a]
            right += [lo + x for x in b]
        a, b = rep[left], rep[right]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
    return _whole_groups(work, 3)


def _verify(size: int, num: int, den: int) -> Callable:
    """Forest edges between members whose whole shingle sets reach the similarity."""
    def work(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, salt, key = (t.column(c).to_numpy() for c in ("i", "j", "salt", "rep"))
        data, off = texts_of(t.column("body"))
        ends = np.append(starts[1:], t.num_rows)
        left, right = [], []
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            row, h = shingles(Words(data, off, lo, hi, lower=True), size)
            n = np.bincount(row, minlength=hi - lo)
            _, token = np.unique(h, return_inverse=True)
            first = np.concatenate([[0], np.cumsum(n)])
            mark = np.zeros(int(token.max()) + 1 if len(token) else 1, dtype=np.int64)

            def reach(x: int, rest: np.ndarray) -> np.ndarray:
                fits = (np.minimum(n[rest], n[x]) * den >= num * np.maximum(n[rest], n[x])) & (n[rest] > 0)
                out = np.zeros(len(rest), dtype=bool)
                near = rest[fits]
                if len(near):
                    own = token[first[x]:first[x + 1]]
                    mark[own] = 1
                    counts = n[near]
                    ends_ = np.cumsum(counts)
                    take = np.arange(ends_[-1]) - np.repeat(ends_ - counts, counts) + np.repeat(first[near], counts)
                    both = np.add.reduceat(mark[token[take]], ends_ - counts)
                    mark[own] = 0
                    out[fits] = both * (num + den) >= num * (counts + n[x])
                return out

            a, b = _forest(hi - lo, None if i[lo] == j[lo] else salt[lo:hi], reach)
            left += [lo + x for x in a]
            right += [lo + x for x in b]
        yield pa.RecordBatch.from_arrays([pa.array(key[left]), pa.array(key[right])], ["a", "b"])
    return _whole_groups(work, 3, 2_000)


def _blocks(df: DataFrame, parts, unit: str) -> DataFrame:
    """Deals each row to the pairs of blocks it takes part in: ``i`` <= ``j``, its own block ``salt``; ``parts`` blocks in its bucket."""
    return (df.withColumn("parts", parts).withColumn("salt", F.expr(f"pmod(xxhash64({unit}), parts)"))
            .withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
            .withColumns({"i": F.least("salt", "other"), "j": F.greatest("salt", "other")}).drop("other", "parts"))


def near_duplicates(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` (an integer), ``n_shingles`` and ``component_id`` of every row.

    Two documents link when den * intersection >= num * union of their sets of ``size``-word shingles;
    ``component_id`` is the smallest key reachable by links, itself included.
    """
    sc = docs.sparkSession.sparkContext
    body = docs.select(F.coalesce(docs[key].cast("long"), F.lit(int(_NULL_KEY))).alias("id"), docs[text].alias("body"))
    common = sc.broadcast(token_order(docs, text, size))
    signed = cut(body.mapInArrow(_signatures(size, num, den, common), "id long, n long, a long, b long, pa long, pb long, prefix array<long>, bits binary"))
    some = signed.filter("n > 0")
    # equal sets count once, equal prefixes with equal size are one group
    classes = cut(some.groupBy("n", "a", "b", "pa", "pb").agg(F.min("id").alias("rep")))
    groups = classes.groupBy("n", "pa", "pb").agg(F.min("rep").alias("gid"), F.count("*").alias("members"))
    members = cut(some.join(classes.join(groups, ["n", "pa", "pb"]).select(F.col("rep").alias("id"), "a", "b", "gid", "members"), ["id", "a", "b"])
                  .dropDuplicates(["id", "a", "b"]).select(F.col("id").alias("rep"), "gid", "members", "n", "prefix", "bits"))
    tokens = members.filter("rep = gid").select("gid", "n", "members", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    shared = (tokens.withColumns({"groups": F.expr("count(1) OVER (PARTITION BY token)"), "size": F.expr("sum(members) OVER (PARTITION BY token)")})
              .filter("groups > 1 OR (size > 1 AND pos = 0)"))
    met = cut(shared.select("token", "gid", "n", "members", "size").sortWithinPartitions("token").mapInArrow(_met(num, den), "a long, b long, token long, size long"))
    slim = members.select("gid", "rep", "n", "bits")
    x, y = (slim.select(*[F.col(c).alias(f"{side}{c}") for c in slim.columns]) for side in "xy")
    pairs = (met.filter("size = 0").select("a", "b").distinct().join(x, F.col("a") == F.col("xgid")).join(y, F.col("b") == F.col("ygid"))
             .filter("a <> b OR xrep < yrep").select("xrep", "xn", "xbits", "yrep", "yn", "ybits"))
    large = _blocks(met.filter("size > 0").select("token", "size", F.col("a").alias("gid")).join(slim, "gid"), F.expr(f"CAST(ceil(size / {BLOCK}) AS BIGINT)"), "rep")
    large = large.select("token", "i", "j", "salt", "rep", "n", "bits").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    tied = components(pairs.mapInArrow(_tie_pairs(num, den), "a long, b long").union(large.mapInArrow(_tie_buckets(num, den), "a long, b long")))
    sets = members.select("rep", "n").join(tied.withColumnRenamed("node", "rep"), "rep")
    weight = sets.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).filter("size > 1")
    asked = cut(_blocks(sets.join(weight, "root"), F.expr(f"CAST(greatest(ceil(size / {MEMBERS}), ceil(weight / {SHINGLES})) AS BIGINT)"), "rep")
                .select("root", "i", "j", "salt", "rep"))
    ids = F.broadcast(asked) if at_most(asked, BROADCAST_IDS) else asked
    links = (body.join(ids, body["id"] == ids["rep"]).select("root", "i", "j", "salt", "rep", "body")
             .repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verify(size, num, den), "a long, b long"))
    found = components(links)
    kind = docs.schema[key].dataType.simpleString()
    named = (signed.select("id", "n", "a", "b").join(classes.select("n", "a", "b", "rep"), ["n", "a", "b"], "left")
             .join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("root", "rep", "id")))
    # texts under one key are one document
    doubled = signed.groupBy("id").agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low <> high")
    if not doubled.isEmpty():
        merged = components(named.join(doubled, "id", "left_semi").select(F.col("id").alias("a"), F.col("component").alias("b")))
        named = (named.join(merged.select(F.col("node").alias("component"), F.col("root").alias("merged")), "component", "left")
                 .withColumn("component", F.coalesce("merged", "component")))

    def real(c: str):
        return F.when(F.col(c) != int(_NULL_KEY), F.col(c)).cast(kind)

    return named.select(real("id").alias(key), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def one_of_each(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every component the rows whose key is the component's smallest, in their own columns; null keys stay unless linked.

    Rows that repeat under one key are one document and stay or go together.
    """
    found = near_duplicates(docs, size=size, num=num, den=den, key=key, text=text)
    gone = found.filter(~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__key")).distinct()
    return docs.join(gone, docs[key].eqNullSafe(gone["__key"]), "left_anti")
