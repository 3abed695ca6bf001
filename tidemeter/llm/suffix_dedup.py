"""Deduplication of long passages by sparse suffixes, grouped by hash in place of a suffix sort.

Of all suffixes of all texts only those are kept that start at a minimiser: the short window of least hash among
its neighbours, chosen by content and so at the same places in every copy of a passage.  The suffixes are
grouped by a hash of their first words; those that share it with another are the candidates.  Every passage of ``size``
words around a candidate's start is then compared by hash, and passages that occur more than once are repeats; no common
lengths are computed.  Overlapping repeats add up, so a longer
passage is found at its full length.  The first copy (smallest document key, then place) stays, later ones go.

A passage of ``size`` words has a minimiser within its first half, so nothing is missed; results are exact up to
collisions of 64-bit hashes.  Suffixes that start alike inside one slice of text stand for each other in the groups.

Rows with equal key and text are one document and all get its result; rows with equal key and different texts
are different documents.  Null and empty texts have no words, null keys come first and are not listed as sources.
Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.repeats import bodies, signed, without_repeats
from tidemeter.llm.words import Words, anchors, mix, slices, texts_of

#: Words of the short windows whose hashes choose the minimisers.
SHORT = 5


def _suffixes(size: int) -> Callable:
    """Suffixes at minimisers: hashes of their first words and of as many after these."""
    reach = size // 2
    half = size - reach + 1  # words that a passage has at least from its minimiser on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch.column(1))
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                words = Words(data, off, i, j)
                at = anchors(words, SHORT, reach)[2]
                at = at[at + half <= words.first[words.row[at] + 1]] if len(at) else at
                if not len(at):
                    continue
                row = words.row[at]
                head = words.span_hash(at, half)
                rest = np.minimum(half, words.first[row + 1] - at - half)
                then = words.span_hash(at + half, rest)
                _, which, n = np.unique(head, return_inverse=True, return_counts=True)
                alike = n[which] > 1
                lead = np.zeros(len(at), dtype=bool)
                lead[np.unique(head, return_index=True)[1]] = True
                own = uid[i + row]
                key = np.where(alike & ~lead, mix(own.view(np.uint64) ^ mix(at.astype(np.uint64))), head)
                yield pa.RecordBatch.from_arrays([signed(key), signed(then), pa.array(own), pa.array((at - words.first[row]) * 4 + alike)],
                                                 ["key", "then", "uid", "place"])
    return run


def dedup(docs: DataFrame, *, size: int = 50, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """``key`` (an integer), ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by one space), ``n_repeated`` (words in
    repeated passages, first copies included), ``removed_spans`` (word numbers) and ``earlier_docs`` (keys of the
    documents that hold the corpus's first copy of a passage of ``size`` words that is removed here, its own key too if it repeats
    itself, null keys left out) of every document; with ``texts`` also ``kept_text``."""
    if not 2 * SHORT + 2 <= size <= 120:
        raise ValueError("passages have 12 to 120 words")
    body = bodies(docs, key, text)
    suffixes = body.select("uid", "body").mapInArrow(_suffixes(size), "key long, then long, uid long, place long")
    beside = "OVER (PARTITION BY key ORDER BY then, uid, place)"
    candidates = (suffixes.repartition("key").select("uid", "place", F.expr(f"lag(place) {beside} IS NOT NULL OR lead(place) {beside} IS NOT NULL").alias("met"))
                  .filter("met OR (place & 3) = 1").groupBy("uid").agg(F.collect_list("place").alias("places")))
    return without_repeats(body, candidates, size, SHORT, size // 2, lambda shift, flag: flag > 0, texts=texts, links=True, key=key)
