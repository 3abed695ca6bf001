import collections
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import BENCH_WORD, low, odd_documents, odd_rows, prose, sha
from tidemeter.llm import decontaminate


def plain(text, items, window):
    w = BENCH_WORD.findall(low(text or ""))
    runs = collections.defaultdict(set)
    for name, body in items:
        words = BENCH_WORD.findall(low(body or ""))
        for k in range(max(1, len(words) - window + 1)):
            if words:
                runs[tuple(words[k:k + window])].add(str(name))
    hit, names = set(), set()
    for size in {len(r) for r in runs}:
        for k in range(len(w) - size + 1):
            if (found := runs.get(tuple(w[k:k + size]))):
                hit |= set(range(k, k + size))
                names |= found
    return len(w), len(hit), sorted(names)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5))
def test_automaton_as_by_brute_force(items, words, window):
    named = [(str(k), [x.encode() for x in w]) for k, w in enumerate(items)]
    auto = decontaminate.SuffixAutomaton(named, window)
    ids = [auto.vocabulary.index(w.encode()) if w.encode() in auto.vocabulary else -1 for w in words]
    spans, found = auto.run(ids)
    want = plain(" ".join(words), [(k, " ".join(w)) for k, w in enumerate(items)], window)
    assert len({x for a, b in spans for x in range(a, b)}) == want[1] and sorted(auto.names[k] for k in found) == want[2]


def cases():
    r = random.Random(9)
    docs = odd_rows()
    words = BENCH_WORD.findall(docs[0][1])
    items = [(1, " ".join(words[5:30])), (2, " ".join(words[20:33]).upper()), (3, None), (4, "!!"), (5, "one"), (10, " ".join(words[60:64])), (11, prose(200, 30)), (5, "One two"),
             (None, " ".join(words[100:115])),
             (12, " ".join(words[35:120]) + "|" + BENCH_WORD.findall(docs[1][1])[0])]  # longer than a part of the smaller size
    docs += [(200 + k, " ".join(r.choice(words[:40]) for _ in range(20)) + "-" + "/".join(words[8:8 + k])) for k in range(12)]
    return docs, items


@pytest.mark.parametrize("part", [200_000, 20])
def test_documents_as_by_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    docs, items = cases()
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, spans string")
    got = decontaminate.benchmark_hits(odd_documents(spark, docs), table, window=10).withColumn("sha", decontaminate.items_digest("items")).collect()
    found = [(d or 0, *plain(t, items, 10)) for d, t in docs]
    want = sorted((d, n, hit, [x for x in names if x != "None"]) for d, n, hit, names in found)
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert all(r.sha == sha(",".join(r["items"]).encode()) and sum(s["to"] - s["from"] for s in r.spans) == r.n_hit for r in got)


def test_cleaned_documents(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, f"Before, it. {item.upper()}! after: all  this"), (2, item), (3, f"{item} x"), (4, "clean,  text\n"), (5, None), (6, ""),
            (7, f"{' '.join(f'w{k}' for k in range(30))} ({item}, mu)")]
    docs = odd_documents(spark, rows)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got == {4: "clean,  text\n", 5: None, 6: "", 7: f"{' '.join(f'w{k}' for k in range(30))} (mu)"}
    assert decontaminate.decontaminated(docs, items, max_coverage=1.0).count() == 7
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == 7
    assert decontaminate.decontaminated(docs.limit(0), items).count() == 0
