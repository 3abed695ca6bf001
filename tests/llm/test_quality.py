import collections
import random

import pytest

from tests.llm.brute import CLASHES, WORD, odd_documents, odd_rows, prose
from tidemeter.llm import quality


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    triples = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_features_as_by_brute_force(spark):
    rows = odd_rows() + [(50, "a | b *** c\na | b *** c\n\n a | b *** c\r\n" * 4), (51, "x x x x"), (52, "é漢 " * 5)]
    got = quality.features(odd_documents(spark, rows).repartition(2)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((d or 0, *plain(t)) for d, t in rows)
    assert quality.features(odd_documents(spark, [])).count() == 0


def test_estimation_finds_the_classes():
    r = random.Random(2)
    truth, counts = collections.defaultdict(list), collections.Counter()
    accuracy = [0.9, 0.8, 0.85, 0.7, 0.95]
    for _ in range(5000):
        good = r.random() < 0.7
        votes = tuple(0 if r.random() < 0.3 else (1 if (r.random() < a) == good else -1) for a in accuracy)
        counts[votes] += 1
        truth[votes].append(good)
    p = quality.estimate(sorted(counts.items()), 5)
    right = sum((p[v] >= 0.5) == g for v, gs in truth.items() for g in gs)
    assert right / 5000 > 0.9
    assert p[(1,) * 5] > p[(1, 1, 1, 1, -1)] and p[(-1,) * 5] < 0.05
    assert quality.estimate([], 5) == {}


def test_kept_documents(spark):
    good = [(k, " ".join(random.Random(k).choice(["the", "of", "and", "house", "river", "in", "stone", "wind", "they", "went"]) for _ in range(120))) for k in range(40)]
    junk = [(100 + k, ("BUY!! NOW!! $$$ *** ### " * 30)) for k in range(8)]
    docs = odd_documents(spark, good + junk + [good[0]])
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([0, *range(40)])
    judged = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert {d for d, r in judged.items() if r.kept} == set(range(40)) and all(0 <= r.p_good <= 1 for r in judged.values())
    assert quality.kept_documents(odd_documents(spark, [])).count() == 0
    assert quality.judged(odd_documents(spark, [(1, None), (2, "")])).count() == 2
    assert set(CLASHES) <= set(kept.columns)


@pytest.mark.parametrize("seed", [1, 2])
def test_prose_alone_is_not_thrown_away(spark, seed):
    docs = odd_documents(spark, [(k, "the of " + prose(100 * seed + k, 100)) for k in range(30)])
    assert quality.kept_documents(docs).count() >= 27
