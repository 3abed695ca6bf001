import random

import pytest

from tests.llm.brute import WORD, odd_documents, odd_rows, order_of, repeats, sha
from tidemeter.llm import repeats as runs
from tidemeter.llm import substring_dedup, suffix_dedup

#: Rows whose order does not depend on a hash: no two texts under one key.
ROWS = [r for r in odd_rows() if r != (13, odd_rows()[15][1])]


@pytest.mark.parametrize("frequent", [2000, 3])
@pytest.mark.parametrize("size", [20, 5])
def test_substrings_as_by_brute_force(spark, monkeypatch, size, frequent):
    monkeypatch.setattr(runs, "FREQUENT", frequent)
    got = substring_dedup.dedup(odd_documents(spark, ROWS).repartition(3), size=size, texts=True).collect()
    want = repeats(ROWS, size)
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got)
    assert rows == sorted((d is not None, d or 0, *want[d, t][:2], sha(want[d, t][3].encode()), want[d, t][3]) for d, t in ROWS)


@pytest.mark.parametrize("size", [50, 13])
def test_passages_as_by_brute_force(spark, size):
    got = suffix_dedup.dedup(odd_documents(spark, ROWS).repartition(3), size=size).collect()
    want = repeats(ROWS, size)
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.n_repeated, r.kept_sha256) for r in got)
    assert rows == sorted((d is not None, d or 0, *want[d, t][:3], sha(want[d, t][3].encode())) for d, t in ROWS)
    for r in got:
        assert sum(s["to"] - s["from"] for s in r.removed_spans) == r.n_removed
        assert bool(r.earlier_docs) == (r.n_removed > 0) or r.doc_id is None or None in [d for d, _ in ROWS]


def test_two_texts_under_one_key_are_two_documents(spark):
    got = suffix_dedup.dedup(odd_documents(spark, odd_rows()), size=50).filter("doc_id = 13").collect()
    assert sorted(r.n_words for r in got) == sorted(len((t or "").split()) for d, t in odd_rows() if d == 13)


def test_empty_tables(spark):
    for op in (substring_dedup, suffix_dedup):
        assert op.dedup(odd_documents(spark, [])).count() == 0
        got = op.dedup(odd_documents(spark, [(1, None), (2, "")])).collect()
        assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == [(0, 0, sha(b""))] * 2


def earlier(rows, size):
    """For each distinct row, the keys of the first copies of its removed windows."""
    first, out = {}, {}
    for row in sorted(set(rows), key=lambda r: (order_of(r), r[1] or "")):
        words = WORD.findall(row[1] or "")
        places = [(row, i) for i in range(len(words) - size + 1)]
        found = {first[w][0][0] for p in places for w in [tuple(words[p[1]:p[1] + size])] if first.setdefault(w, p) != p}
        out[row] = sorted(found - {None})
    return out


@pytest.mark.parametrize("frequent", [2000, 3])
@pytest.mark.parametrize("parts", [1, 3, 16])
def test_earlier_documents_as_by_brute_force(spark, monkeypatch, parts, frequent):
    monkeypatch.setattr(runs, "FREQUENT", frequent)
    r = random.Random(3)
    pieces = [[f"p{k}w{i}" for i in range(r.randint(8, 40))] for k in range(12)]
    rows = [(d, " ".join(w for k in r.choices(range(12), k=6) for w in pieces[k][r.randint(0, 3):])) for d in r.sample(range(1000), 60)]
    rows += ROWS + rows[:3] + [(None, " ".join(pieces[0] + pieces[1]))]
    for size in (13, 20):
        want = earlier(rows, size)
        assert max(map(len, want.values())) > 5
        got = suffix_dedup.dedup(odd_documents(spark, rows).repartition(parts), size=size, texts=True).collect()
        words = {(d, sha(repeats_of[d, t].encode())): want[d, t] for repeats_of in [{k: v[3] for k, v in repeats(rows, size).items()}] for d, t in want}
        assert len(got) == len(rows) and all(r.earlier_docs == words[r.doc_id, r.kept_sha256] for r in got)
