"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes keep, drop or nothing on a document.  All documents' vote patterns are counted in Spark; with R
rules there are at most 3**R patterns, whatever the corpus, and only these counts reach the driver.  There
expectation-maximisation estimates, without labels, how often each rule votes which way on good and on bad
documents, and so the probability that a document with a given pattern is good.  That probability replaces the
demand that every rule passes.

Null and empty texts have no words.  Repeated rows are judged each and weigh each.  An empty table gives an empty
result.  Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.stopwords import STOP_WORDS
from tidemeter.llm.words import SPACES, Words, byte_set, mix, slices, texts_of
from tidemeter.session import cut

_SYMBOLS = byte_set(b"#*$%&|<>")
_NEWLINE = byte_set(b"\n")
_UPPER, _LETTER = byte_set(range(65, 91)), byte_set([*range(65, 91), *range(97, 123), *range(128, 256)])
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_upper", "n_letters")

KEEP, DROP, ABSTAIN = 1, -1, 0
#: Passes over the pattern counts; they stop earlier when nothing moves by more than 1e-9.
EM_PASSES = 500


def _stop_hashes() -> np.ndarray:
    forms = sorted({f.encode("utf-8") for w in STOP_WORDS for f in (w, w.capitalize())})
    data = b" ".join(forms)
    return np.sort(Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), 0, 1).hash)


def _per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]


def _slice_features(data: np.ndarray, off: np.ndarray, i: int, j: int, stops: np.ndarray) -> list[np.ndarray]:
    words = Words(data, off, i, j)
    body, rows = words.data, j - i
    inside = ~SPACES[body]
    chars = _per_row(inside & ((body & 0xC0) != 0x80), words.off)
    # words in three-word windows that occur twice or more in the same row
    at, h = words.windows(3)
    repeated = np.zeros(rows, dtype=np.int64)
    if len(at):
        _, which, times = np.unique(mix(h ^ mix(words.row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
        twice = at[times[which] > 1]
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        edge[twice] += 1  # no two windows start at one word
        edge[twice + 3] -= 1
        repeated = np.bincount(words.row, weights=np.cumsum(edge[:-1]) > 0, minlength=rows).astype(np.int64)
    lines = Words(data, off, i, j, _NEWLINE)
    full = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    row = lines.row[full]
    n_lines = np.bincount(row, minlength=rows)
    if len(row):
        keys, first = np.unique(mix(lines.hash[full] ^ mix(row.astype(np.uint64))), return_index=True)
        distinct = np.bincount(row[first], minlength=rows)
    else:
        distinct = n_lines
    place = np.minimum(np.searchsorted(stops, words.hash), len(stops) - 1)
    stop = np.bincount(words.row, weights=stops[place] == words.hash, minlength=rows).astype(np.int64)
    return [words.counts, chars, _per_row(_SYMBOLS[body], words.off), n_lines - distinct, repeated, n_lines, stop,
            _per_row(_UPPER[body], words.off), _per_row(_LETTER[body] & ((body & 0xC0) != 0x80), words.off)]


def _with_features(docs: DataFrame, text: str) -> DataFrame:
    """All columns as ``k0``, ``k1`` ..., whatever their names, and ``FEATURES``; a narrow map."""
    held = [f"k{i}" for i in range(len(docs.columns))]
    slim = docs.select(*[docs[c].alias(k) for c, k in zip(docs.columns, held)])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = _stop_hashes()
        for batch in batches:
            data, off = texts_of(batch.column(at))
            parts = [_slice_features(data, off, i, j, stops) for i, j in slices(off)]
            cols = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*held, *FEATURES])

    return slim.mapInArrow(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in slim.schema], *[f"{f} long" for f in FEATURES]]))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts over each whole text: ``key`` and ``FEATURES``."""
    return _with_features(docs.select(docs[key].alias("key"), docs[text].alias("body")), "body").select(F.col("k0").alias(key), *FEATURES)


def default_rules() -> dict[str, Column]:
    """Rules over ``FEATURES``; each gives KEEP, DROP or ABSTAIN.  All are shares of the text, so length alone decides little."""
    c = F.col

    def vote(drop: Column, keep: Column) -> Column:
        return F.when(drop, DROP).when(keep, KEEP).otherwise(ABSTAIN)

    words = F.greatest(c("n_words"), F.lit(1))
    return {
        "symbols": vote(c("n_symbols") > 0.1 * words, c("n_symbols") <= 0.01 * words),
        "stop_words": vote(c("n_stop_words") < 0.05 * words, c("n_stop_words") >= 0.15 * words),
        "word_length": vote((c("word_chars") < 2 * words) | (c("word_chars") > 12 * words), c("word_chars").between(3 * words, 9 * words)),
        "repeated_words": vote(c("n_repeat_words") > 0.3 * words, c("n_repeat_words") <= 0.1 * words),
        "repeated_lines": vote(c("n_dup_lines") > 0.3 * c("n_lines"), F.lit(False)),
        "capitals": vote(c("n_upper") > 0.4 * c("n_letters"), c("n_upper") <= 0.1 * c("n_letters")),
        "letters": vote(c("n_letters") < 0.6 * c("word_chars"), c("n_letters") >= 0.8 * c("word_chars")),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, *, good_share: float = 0.8, accuracy: float = 0.8) -> dict[tuple[int, ...], float]:
    """Probability of being good for each vote pattern, from the patterns' counts.

    The rules are taken as independent given the class.  Start: every rule that votes is right ``accuracy`` of
    the time.  Counts are smoothed by that start as one observation, and a rule never counts as more often wrong
    than right: a keep vote never speaks against a document nor a drop vote for it.
    """
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns]).reshape(len(patterns), n_rules)
    weight = np.array([n for _, n in patterns], dtype=float)
    hot = np.stack([votes == DROP, votes == ABSTAIN, votes == KEEP], axis=-1).astype(float)  # pattern, rule, vote
    share = np.einsum("prv,p->rv", hot, weight) / weight.sum()
    lean = np.array([[1 - accuracy, 0.5, accuracy], [accuracy, 0.5, 1 - accuracy]])[:, None, :]  # good, bad
    start = np.maximum(share, 1e-6)[None] * lean
    start /= start.sum(-1, keepdims=True)
    table, prior = start, good_share
    good = np.full(len(votes), prior)
    for _ in range(EM_PASSES):
        like = np.einsum("prv,crv->cp", hot, np.log(table)) + np.log([prior, 1 - prior])[:, None]
        new = 1 / (1 + np.exp(np.clip(like[1] - like[0], -700, 700)))
        both = np.stack([new, 1 - new]) * weight
        table = np.einsum("cp,prv->crv", both, hot) + start
        table /= table.sum(-1, keepdims=True)
        for v, better in ((2, 0), (0, 1)):  # a keep vote is likelier on good documents, a drop vote on bad ones
            worse = 1 - better
            low = table[better, :, v] < table[worse, :, v]
            level = (table[0, :, v] + table[1, :, v]) / 2
            table[:, low, v] = level[low]
        table /= table.sum(-1, keepdims=True)
        prior = float(np.clip((both[0].sum() + good_share) / (weight.sum() + 1), 1e-6, 1 - 1e-6))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return {tuple(p): float(g) for (p, _), g in zip(patterns, good)}


def _verdicts(voted: DataFrame, names: list[str]) -> DataFrame:
    """The vote patterns that occur, at most 3 ** len(names), each with ``p_good``."""
    counts = voted.groupBy(*names).count().collect()
    good = estimate(sorted((tuple(r[:-1]), r[-1]) for r in counts), len(names))
    return voted.sparkSession.createDataFrame([(*p, g) for p, g in good.items()], ", ".join([*[f"{n} int" for n in names], "p_good double"]))


def judged(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: dict[str, Column] | None = None, threshold: float = 0.5,
           base: bool = False) -> DataFrame:
    """``key``, the features, each rule's vote (``vote_<rule>``), ``p_good`` and ``kept`` (see ``passes``)."""
    rules = rules if rules is not None else default_rules()
    names = [f"vote_{r}" for r in rules]
    voted = cut(features(docs, key, text).withColumns({f"vote_{r}": c.cast("int") for r, c in rules.items()}))
    return (voted.join(F.broadcast(_verdicts(voted, names)), names, "left")
            .select(key, *FEATURES, *names, "p_good", passes(threshold, base).alias("kept")))


def kept_documents(docs: DataFrame, *, text: str = "text", rules: dict[str, Column] | None = None, threshold: float = 0.5, base: bool = False) -> DataFrame:
    """The documents that pass (see ``passes``), in their own columns; texts are not shuffled."""
    rules = rules if rules is not None else default_rules()
    names = [f"vote_{r}" for r in rules]
    votes = {f"vote_{r}": c.cast("int") for r, c in rules.items()}
    verdicts = _verdicts(features(docs.select(docs[text].alias("body")), "body", "body").select(*[v.alias(n) for n, v in votes.items()]), names)
    return (_with_features(docs, text).withColumns(votes).join(F.broadcast(verdicts), names, "left").filter(passes(threshold, base))
            .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)]))


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def passes(threshold: float, base: bool) -> Column:
    """The one verdict on a document: ``p_good`` is at least ``threshold`` and, with ``base``, it is neither too short nor mostly repeated."""
    good = F.col("p_good") >= threshold
    return ~base_failed() & good if base else good
