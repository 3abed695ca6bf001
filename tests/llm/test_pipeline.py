import random

import corpus_pipeline
import pytest

from tests.llm.brute import odd_documents, prose, sha
from tidemeter.llm import quality

FAIR = "the of and house river in stone wind they went over hill to a garden that was wide".split()


def fair(seed, n=90):
    r = random.Random(seed)
    return " ".join(r.choice(FAIR) + (f"{seed}x{k}" if k % 3 == 0 else "") for k in range(n))


@pytest.fixture()
def home(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(14))
    near = fair(7).split(" ")
    near[50] = "otherwise"
    rows = [(k, fair(k)) for k in range(12)] + [
        (20, fair(3)), (21, " ".join(near)), (22, "a first line of it\n" + fair(30) + "\n" + fair(5)), (23, fair(31) + " " + item + " " + fair(32)), (24, item + " " + fair(33, 4)),
        (25, "BUY!! NOW!! $$$ *** ### " * 25), (26, None), (27, ""), (None, fair(40)), (28, fair(41)), (28, fair(41))]
    odd_documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_each_stage_takes_effect(spark, home):
    docs = spark.read.parquet(f"{home}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, home)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    rules, lines, near, clean = (seen[n] for n, _ in corpus_pipeline.STAGES[:-1])
    assert 25 not in rules and {*range(12), 20, 21, 22, 23, 28} <= set(rules)
    assert 20 not in lines and lines[22] == "a first line of it\n" + fair(30) and lines[3] == fair(3)  # a copy goes, its lines are all there
    assert 21 not in near and {*range(12), 22, 23} <= set(near)
    assert clean[23] == fair(31) + " " + fair(32) and 24 not in clean and clean[5] == fair(5)
    tokens = {r.doc_id: r for r in corpus_pipeline.run(spark, home).collect()}
    assert set(tokens) == set(clean)
    assert all(tokens[d].decoded_sha256 == sha((t or "").encode()) and len(tokens[d].ids) == 4 * tokens[d].n_tokens for d, t in clean.items())


def test_empty_documents(spark, tmp_path):
    odd_documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_prose_passes_whole(spark, tmp_path):
    rows = [(k, "the of and in " + prose(900 + k, 120)) for k in range(20)]
    odd_documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of it at all stands here but these few words more")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 18


def test_a_copy_with_a_short_line_goes_whole(spark):
    text = "Title 1\n" + fair(1) + "\n\nShort end."
    rows = [(1, text), (2, text), (3, "Short end.\n" + fair(1)), (4, "Own end.\n" + fair(1)), (5, "Title 1\n" + fair(5)), (6, "Title 1\n\n\tShort end."), (7, "Title 1"),
            (8, None), (9, " \n"), (10, "Not yet"), (11, "Twice\nTwice"), (None, "Title 1")]
    docs = odd_documents(spark, rows)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert got == {None: "Title 1", 1: text[8:], 5: fair(5), 6: "\n\tShort end.", 8: None, 9: " \n", 10: "Not yet", 11: "Twice"}


def test_near_copies_leave_no_stubs(spark):
    """Copies of texts of many lines, with some words changed, through both stages: none stays, whole or in part; texts that share less stay."""
    r, rows = random.Random(2), []
    for k in range(30):
        lines = [fair(1000 * k + i, r.randint(8, 16)) for i in range(r.randint(8, 20))]
        rows.append((k, "\n".join(lines)))
        near = [line.split(" ") for line in lines]
        for _ in range(r.randint(1, 3)):  # each changed word takes five shingles
            near[r.randrange(len(near))][r.randint(0, 7)] = f"changed{k}"
        rows.append((100 + k, "\n".join(map(" ".join, near))))
        rows.append((200 + k, "\n".join([lines[0], fair(5000 + k), fair(7000 + k), lines[1]])))
    docs = odd_documents(spark, rows)
    left = corpus_pipeline.line_dedup_stage(spark, docs, "")
    left = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(left.collect(), docs.schema), "")
    got = {x.doc_id: x.text for x in left.collect()}
    assert not [d for d in got if 100 <= d < 200] and {*range(30), *range(200, 230)} == set(got)
    assert all(got[200 + k] == "\n".join([fair(5000 + k), fair(7000 + k)]) for k in range(30))


def test_the_stage_drops_what_the_operator_drops(spark):
    rows = [(k, fair(k)) for k in range(20)] + [(50, fair(50, 49)), (51, fair(51, 50)), (52, fair(52, 8) + " " + " ".join([fair(53, 10)] * 8)), (53, None)]
    docs = odd_documents(spark, rows)
    got = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert got == {*range(20), 51} == {r.doc_id for r in quality.judged(docs, base=True).collect() if r.kept}
