import random

import pyarrow as pa
import pytest

from tests.llm.brute import odd_documents, odd_rows, order_of, prose, sha
from tidemeter.llm import phrase_prints as prints

MASK = 2**64 - 1


def mix(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * by & MASK
    return x ^ x >> 31


def toss(values):
    out = []
    for i, v in enumerate(values):
        differ = v ^ (values[i - 1] if i else v ^ 1)
        bit = (differ & -differ).bit_length() - 1
        out.append(2 * bit + (v >> bit & 1))
    return out


def plain_names(data):
    """Names of the phrases from the third level on and of the whole, one symbol after the other."""
    symbols, out, level = list(data), [], 0
    while symbols:
        groups = []
        for s in symbols:
            if groups and groups[-1][0] == s:
                groups[-1][1] += 1
            else:
                groups.append([s, 1])
        names = [int(prints._CODES[s]) if not level else s for s, _ in groups]
        names = [mix(x + n * int(prints._REPEAT) & MASK) if n > 1 else x for x, (_, n) in zip(names, groups)]
        labels = [s for s, _ in groups]
        for _ in range(3 if not level else 4):
            labels = toss(labels)
        assert max(labels) < 6 and all(a != b for a, b in zip(labels, labels[1:]))
        found = []
        for i, x in enumerate(names):
            if i == 0 or (i < len(names) - 1 and labels[i - 1] < labels[i] > labels[i + 1]):
                found.append([])
            found[-1].append(x)
        symbols = [mix(sum(mix(x) * pow(int(prints._STEP), k + 1, 2**64) for k, x in enumerate(p)) + len(p) * int(prints._LENGTH) & MASK) for p in found]
        level += 1
        if level >= 3 or len(symbols) == 1:
            out += symbols
        if len(symbols) == 1:
            break
    return sorted({x >> 32 for x in out})[:prints.SKETCH]


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    both = sorted({*a, *b})
    both = both[:prints.SKETCH] if max(len(a), len(b)) >= prints.SKETCH else both
    shared = len({*a} & {*b} & {*both})
    return 2 * shared / (len(both) + shared)


def digits(names):
    return "".join(f"{x:08x}" for x in names)


@pytest.mark.parametrize("seed", range(5))
def test_names_as_by_one_symbol_after_the_other(seed):
    r = random.Random(seed)
    texts = ["", None, "a", "aa", "ab", "a" * 5000, "ab" * 700, *[prose(seed * 50 + k, r.randint(1, 60)) for k in range(30)], *["".join(r.choice("ab") for _ in range(k)) for k in range(40)]]
    assert [p.tolist() for p in prints.fingerprints(pa.array(texts))] == [plain_names((t or "").encode()) for t in texts]


def plain_edited(rows):
    rows = sorted(rows, key=lambda r: (order_of(r), sha((r[1] or "").encode())), reverse=True)
    out = []
    for (d, t), (_, f) in zip(rows, rows[1:] + rows[:1]):
        t, f = t or "", f or ""
        new = t[:len(t) - len(t) // 2] + f[:len(t) // 2]
        a, b, c = (plain_names(x.encode()) for x in (t, new, f))
        out.append((order_of((d,)), len(t), sha(new.encode()), digits(a), digits(b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_edited_texts_as_by_brute_force(spark, parts):
    rows = [r for r in odd_rows() if r != (13, odd_rows()[15][1]) and len(r[1] or "") < 20_000]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = prints.with_edited(odd_documents(spark, rows).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((order_of((r.doc_id,)), *tuple(r)[1:]) for r in got) == plain_edited(rows)


def test_one_row_none_and_many_equal(spark):
    assert prints.with_edited(odd_documents(spark, [])).count() == 0
    assert [tuple(r)[1:] for r in prints.with_edited(odd_documents(spark, [(1, None)])).collect()] == [(0, sha(b""), "", "", 1.0, 1.0)]
    one = prints.with_edited(odd_documents(spark, [(1, "abcd")])).collect()[0]
    assert (one.edited_sha256, one.near_next) == (sha(b"abab"), 1.0)
    got = prints.with_edited(odd_documents(spark, [(None, "same text here")] * 300 + [(7, "other")]).repartition(7)).collect()
    assert len(got) == 301 and len({r.fingerprint for r in got}) == 2 and sum(r.near_next == 1.0 for r in got) == 299


def test_equal_substrings_share_their_phrases_wherever_they_stand(spark):
    passage = prose(77, 400)
    size = len(passage.encode())
    texts = [(k, prose(500 + k, 37 * k) + passage + prose(900 + k, 23)) for k in range(1, 5)]
    for level, margin in ((1, 12), (2, 90), (3, 400)):
        inside = []
        rows = prints.phrases(odd_documents(spark, texts), level).collect()
        for k, t in texts:
            mine = sorted((r.start, r.end, r.name) for r in rows if r.doc_id == k)
            assert mine[0][0] == 0 and mine[-1][1] == len(t.encode()) and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
            base = len(t[:t.index(passage)].encode())
            inside.append([(s - base, n) for s, e, n in mine if s - base >= margin and e - base <= size - margin])
        assert len(inside[0]) > 20 and all(x == inside[0] for x in inside)


def test_likeness_follows_what_is_shared():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    mean = {}
    for share in (0.0, 0.5, 0.9):
        found = []
        for _ in range(60):
            w = [word() for _ in range(300)]
            a, b = " ".join(w), " ".join(w[:int(300 * share)] + [word() for _ in range(300 - int(300 * share))])
            x, y = prints.fingerprints(pa.array([a, b]))
            found.append(prints.likeness(x, y))
        mean[share] = sum(found) / len(found)
    assert mean[0.0] < 0.02 and 0.4 < mean[0.5] < 0.6 and 0.8 < mean[0.9] < 1.0
