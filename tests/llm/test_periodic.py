import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.brute import WORD, odd_documents, odd_rows, order_of, prose, sha
from tidemeter.llm import periodic_runs as runs
from tidemeter.llm import queries
from tidemeter.llm.words import Words, texts_of


def plain_runs(w, least=12):
    """Every lag, every stretch; of equal stretches the smallest period."""
    found = {}
    for q in range(len(w) - 1, 0, -1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(least, 2 * q):
                found[start, length] = q
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_report(doc_id, text, tails):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if tails and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = set()
    for s, m, q in found:
        gone.update(range(s + q, s + m))
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()))


def runs_in(text, least=12):
    data, off = texts_of(pa.array([text]))
    return runs.runs_of(Words(data, off, 0, 1), least).get(0, [])


@pytest.mark.parametrize("seed", range(60))
def test_runs_as_by_brute_force_on_words_of_few_kinds(seed):
    r = random.Random(seed)
    for _ in range(12):
        kind = r.randint(0, 4)
        w = [r.choice("ab"[:r.randint(1, 2)] if kind == 0 else "abc") for _ in range(r.randint(0, 90))]
        if kind >= 2:  # powers of powers, with faults
            for _ in range(r.randint(1, 3)):
                w = (w[:r.randint(1, 9)] * r.randint(2, 9) + [r.choice("abcd")] * r.randint(0, 3))[:150] or ["a"]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "x"
            if kind == 4:
                w = (w * 5)[:r.randint(60, 400)]
        assert runs_in(" ".join(w)) == plain_runs(w)


def test_fibonacci_words_and_long_periods():
    a, b = ["a"], ["a", "b"]
    while len(b) < 700:
        a, b = b, b + a
    assert runs_in(" ".join(b)) == plain_runs(b)
    r = random.Random(1)
    block = [str(r.randrange(50)) for _ in range(301)]
    for w in (block * 3, block * 2, block * 2 + block[:-1], block[:-1] + block * 4 + block[:17]):
        assert runs_in(" ".join(w)) == plain_runs(w)


@pytest.mark.parametrize("text, expected", [
    ("a " * 300_000, [(0, 300_000, 1)]),
    ("a b " * 100_000, [(0, 200_000, 2)]),
    (("a " * 13 + "b ") * 8_000, [(0, 112_000, 14)]),
])
def test_one_word_or_few_repeated_take_no_quadratic_time(text, expected):
    import time

    t = time.perf_counter()
    found = runs_in(text)
    assert time.perf_counter() - t < 20
    assert sorted(found, key=lambda r: -r[1])[:1] == expected


@pytest.mark.parametrize("tails", [False, True])
@pytest.mark.parametrize("parts", [1, 5])
def test_documents_as_by_brute_force(spark, tails, parts):
    rows = [(d, " ".join((t or "").split(" ")[:400]) if t else t) for d, t in odd_rows()]
    rows += [(d, prose(d, 3 + d % 70)) for d in range(100, 260)] + [(300, "x " * 40), (301, "go on and " * 9 + "x"), (302, "a b c " * 4), (302, "a b c " * 4)]
    docs = odd_documents(spark, rows).repartition(parts)
    if tails:
        docs = runs.with_periodic_tails(docs)
    got = runs.periodic_runs(docs, collapsed=True).collect()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = [(order_of((d,)), *plain_report(d, t, tails)) for d, t in rows]
    assert sorted(map(repr, ((order_of((r.doc_id,)), *[r[c] for c in names]) for r in got))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > (10 if tails else 3)
    for r in got:
        assert sha(r.collapsed.encode()) == r.collapsed_sha256 and len(r.runs) == r.n_runs


def test_empty_tables(spark):
    assert runs.periodic_runs(runs.with_periodic_tails(odd_documents(spark, []))).count() == 0
    got = runs.periodic_runs(odd_documents(spark, [(None, None), (2, "")])).collect()
    assert [(r.n_runs, r.start, r.collapsed_sha256) for r in got] == [(0, None, sha(b""))] * 2


def test_query_as_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert all(got[r.doc_id] == plain_report(r.doc_id, r.text, True) for r in rows)
    assert len(got) >= len(rows) > 100 and np.mean([v[0] > 0 for v in got.values()]) > 0.05
