import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import components, distance, lines_gone, odd_documents, odd_rows, order_of, prose, shingle_set
from tidemeter.llm import graph, jaccard_join, line_dedup


@pytest.mark.parametrize("size, num, few, block", [(4, 85, 8, 512), (5, 80, 2, 3), (1, 50, 2, 4)])
def test_components_as_by_brute_force(spark, monkeypatch, size, num, few, block):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "MEMBERS", block)
    monkeypatch.setattr(jaccard_join, "COMMON", few)
    base = prose(50, 120).split(" ")
    rows = odd_rows() + [(100 + k, " ".join(w if (j * 7 + k * 13) % 97 > k % 9 else f"e{k}" for j, w in enumerate(base))) for k in range(30)]
    got = jaccard_join.near_duplicates(odd_documents(spark, rows).repartition(3), size=size, num=num, den=100).collect()
    want = components(rows, size, num, 100)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in got) == sorted(
        (order_of((d,)), len(shingle_set(t, size)), want[d] or 0) for d, t in rows)


def test_one_of_each_component_stays(spark):
    docs = odd_documents(spark)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    want = components(odd_rows(), 5, 80, 100)
    assert ids == sorted(d or 0 for d, _ in odd_rows() if want[d] == d)
    assert jaccard_join.one_of_each(odd_documents(spark, [])).count() == 0
    assert jaccard_join.one_of_each(odd_documents(spark, [(1, None), (2, ""), (3, None)])).count() == 3


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(9, k) for k in range(200, 230)] + [(5, 5), (7, 3), (3, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 9 for k in (9, *range(200, 230))}, 3: 3, 7: 3}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc漢", min_size=4, max_size=24), st.text("abc漢", min_size=4, max_size=24)), min_size=1, max_size=8), st.integers(1, 3))
def test_banded_distance(pairs, edits):
    pairs = pairs + [(a, a[:3] + "b" + a[4:]) for a, _ in pairs]
    lines = line_dedup.Bodies([x for p in pairs for x in p])
    x = np.arange(0, 2 * len(pairs), 2)
    true = [distance(*p) <= edits for p in pairs]
    assert lines.within(x, x + 1, edits).tolist() == true
    assert not (np.array(true) & ~lines.may_match(x, x + 1, edits)).any()


@pytest.mark.parametrize("edits, least, block", [(2, 20, 512), (1, 4, 3)])
def test_lines_as_by_brute_force(spark, monkeypatch, edits, least, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    line = prose(70, 12).replace("\n", " ")
    rows = [r for r in odd_rows() if r[0] not in (13, 14, 15)] + [
        (100 + k, f"{line[:k]}Q{line[k:]}\nshort\n\n{line}\n{line[:-1]}\n" + prose(80 + k, 10)) for k in range(25)] + [(99, line + "\n" + line + "zz\r")]
    docs = odd_documents(spark, rows)
    got = line_dedup.line_report(docs.repartition(3), edits=edits, min_chars=least).collect()
    want = lines_gone(rows, edits, least)
    assert sorted((order_of(r), r.n_lines, r.n_removed, r.removed_lines) for r in got) == sorted(
        (order_of((d,)), 0 if t is None else t.count("\n") + 1, len(want[d, t]), want[d, t]) for d, t in rows)
    clean = line_dedup.without_repeated_lines(docs, edits=edits, min_chars=least)
    assert clean.columns == docs.columns
    assert sorted((order_of(r), r.text or "") for r in clean.collect()) == sorted(
        (order_of((d,)), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in want[d, t])) for d, t in rows)


def test_no_lines(spark):
    assert line_dedup.line_report(odd_documents(spark, [])).count() == 0
    got = line_dedup.line_report(odd_documents(spark, [(1, None), (2, ""), (None, "\n\n")])).collect()
    assert sorted((r.n_lines, r.n_removed) for r in got) == [(0, 0), (1, 0), (3, 0)]


def test_only_texts_with_lines_that_met_are_read_again(spark, monkeypatch):
    line = prose(70, 12).replace("\n", " ")
    rows = [(1, line), (2, line + "Q"), (3, line)] + [(10 + k, prose(200 + k, 12)) for k in range(20)]
    few, seen = line_dedup._few, []

    def spy(*given):
        found = few(*given)
        seen.append(found.count())
        return found
    monkeypatch.setattr(line_dedup, "_few", spy)
    got = line_dedup.line_report(odd_documents(spark, rows)).collect()
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == {2: 1, 3: 1}
    assert seen == [2, 2, 2]  # lines that met, the documents that have them first, their texts


def test_codes_of_code_points():
    points = np.array([0, 10, 97, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF], dtype=np.uint32)
    assert line_dedup.point_codes(points).tolist() == line_dedup.mix(points.astype(np.uint64) + np.uint64(1)).tolist()
