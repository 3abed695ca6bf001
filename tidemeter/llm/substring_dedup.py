"""Substring deduplication by level-wise doubling of repeated word windows.

A window of ``size`` words can only be repeated if the shorter windows in it are.  So the search starts with
windows of a quarter of the size, at content-selected places: of all short windows inside a long one, that of
least hash, which is the same one in every copy.  Short windows that are repeated, and they alone, are extended
to twice their length, to the right and to the left; where that is repeated too, the long windows around it are
compared, by 128 bits of hash.  Of equal long windows the one that starts first (document key, then place)
stays, and the words of all others go.

Shuffles: one slim row for each short window (about an eighth of the words), the texts once, by a hash of the row (both later
passes read that one exchange), and the hashes of the long windows that survive.  What repeats inside one slice of text is
settled there, so a passage that a third of all documents share sends one row a slice, not one a document.

Rows with equal key and text are one document and all get its result; rows with equal key and different texts
are different documents, ordered by a hash of the text.  Null and empty texts have no words, null keys come
first.  Texts shorter than a window lose nothing.  Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.repeats import bodies, signed, without_repeats
from tidemeter.llm.words import Words, anchors, mix, slices, texts_of


class Levels:
    """Lengths of the search: short windows, their doubles, and the windows asked for."""

    def __init__(self, size: int):
        if not 4 <= size <= 80:
            raise ValueError("windows have 4 to 80 words")
        self.size, self.short = size, size // 4
        self.double = 2 * self.short
        self.reach = size - self.short + 1


def _counts(keys: np.ndarray) -> np.ndarray:
    _, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[which]


def _short_windows(levels: Levels) -> Callable:
    """First pass: the selected short windows with both doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch.column(1))
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                words = Words(data, off, i, j)
                _, _, at, h = anchors(words, levels.short, levels.reach)
                if not len(at):
                    continue
                row = words.row[at]
                ends, begins = words.first[row + 1], words.first[row]
                right_fits, left_fits = at + levels.double <= ends, at + levels.short - levels.double >= begins
                right = np.where(right_fits, mix(h ^ words.span_hash(np.minimum(at, len(words) - levels.double), levels.double)), 0)
                left = np.where(left_fits, mix(h ^ ~words.span_hash(np.maximum(at + levels.short - levels.double, 0), levels.double)), 0)
                again_right, again_left = (_counts(right) > 1) & right_fits, (_counts(left) > 1) & left_fits
                # of windows whose doubles are both known to be repeated, the first stands for all in the shuffle
                first = np.zeros(len(at), dtype=bool)
                first[np.unique(mix(right ^ mix(left)), return_index=True)[1]] = True
                known = (again_right | ~right_fits) & (again_left | ~left_fits) & ~first
                own = uid[i + row]
                key = np.where(known, mix(own.view(np.uint64) ^ mix(at.astype(np.uint64))), h)
                place = at - begins
                yield pa.RecordBatch.from_arrays(
                    [signed(key), pa.array(right.view(np.int64), mask=~right_fits), pa.array(left.view(np.int64), mask=~left_fits), pa.array(own),
                     pa.array(place * 4 + again_right * 2 + again_left)], ["key", "right", "left", "uid", "place"])
    return run


def dedup(docs: DataFrame, *, size: int = 20, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """``key`` (an integer), ``n_words``, ``n_removed`` and ``kept_sha256`` (kept words joined by one space) of every
    document; with ``texts`` also ``kept_text``."""
    levels = Levels(size)
    body = bodies(docs, key, text)
    short = body.select("uid", "body").mapInArrow(_short_windows(levels), "key long, `right` long, `left` long, uid long, place long")

    def times(side: str):
        return F.expr(f"`{side}` IS NOT NULL AND count(1) OVER (PARTITION BY key, `{side}`) > 1")

    repeated = (short.repartition("key").select("uid", "place", times("right").alias("on_right"), times("left").alias("on_left"))
                .select("uid", F.expr("place | if(on_right, 2, 0) | if(on_left, 1, 0)").alias("place"))
                .filter("(place & 3) != 0").groupBy("uid").agg(F.collect_list("place").alias("places")))

    def worth(shift: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """Every double inside the window is repeated."""
        return ((shift + levels.double > levels.size) | ((flag & 2) > 0)) & ((shift < levels.double - levels.short) | ((flag & 1) > 0))

    return without_repeats(body, repeated, size, levels.short, levels.reach, worth, texts=texts, links=False, key=key)
