"""Plain versions of the operators for small inputs, and inputs with every odd case."""

from __future__ import annotations

import collections
import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Names that the operators use inside; documents may have columns of these names.
CLASHES = ("body", "uid", "key", "k0", "k1", "token", "n_words", "items", "spans", "numbers", "line", "root", "gone", "kept", "vote_symbols", "__text")


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßñ漢") for _ in range(r.randint(1, 7))) for _ in range(60)] + ["the", "and", "of", "It's", "№5"]
    return "".join(r.choice(words) + (r.choice([".\n", ",\t", " \x0b", "  "]) if r.random() < 0.1 else " ") for _ in range(n))


def odd_rows() -> list[tuple]:
    """(doc_id, text): nulls, blanks, copies, near copies, equal ids, one very long text, shared passages."""
    a, b, passage = prose(1, 150), prose(2, 90), prose(3, 70)
    changed = a.split(" ")
    changed[40] = "changed"
    long_text = prose(4, 30_000)
    return [(1, a), (2, b), (3, None), (4, ""), (5, " \n\t "), (None, prose(5, 40)), (6, a), (7, " ".join(changed)), (8, b), (8, b), (9, passage + "x " + b),
            (10, "one"), (11, "one"), (12, "One two"), (13, prose(6, 30) + passage), (13, prose(7, 35)), (14, long_text), (15, long_text[:50_000]),
            (16, (prose(8, 12) + "\n") * 6), (17, "w " * 45), (18, passage.upper()), (-5, passage), (19, "a\x1cb\x85c d ​e")]


def odd_documents(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(d, t, "en", "s", None, *["x"] * len(CLASHES)) for d, t in rows],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def order_of(row):
    return (row[0] is not None, row[0] or 0)


def repeats(rows, size):
    """For each distinct row: words, words in later copies, words in any copy, kept text.  Ties by document id must not matter in the input."""
    seen, found = collections.defaultdict(list), {}
    distinct = sorted({r for r in rows}, key=lambda r: (order_of(r), r[1] or ""))
    for row in distinct:
        words = found[row] = WORD.findall(row[1] or "")
        for i in range(len(words) - size + 1):
            seen[tuple(words[i:i + size])].append((row, i))
    gone, shared = ({r: [False] * len(w) for r, w in found.items()} for _ in range(2))
    for places in seen.values():
        for n, (row, i) in enumerate(places):
            if len(places) > 1:
                shared[row][i:i + size] = [True] * size
                if n:
                    gone[row][i:i + size] = [True] * size
    return {r: (len(w), sum(gone[r]), sum(shared[r]), " ".join(x for x, g in zip(w, gone[r]) if not g)) for r, w in found.items()}


def shingle_set(text, size):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows, size, num, den):
    """Component of every key; texts under one key are one document."""
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)), key=lambda k: (k is not None, k or 0))
                root[q] = p
    return {d: find(d) for d in root}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines_gone(rows, edits, least):
    seen, out = [], {}
    for row in sorted({r for r in rows}, key=lambda r: (order_of(r), r[1] or "")):
        out[row] = []
        for i, line in enumerate((row[1] or "").split("\n")):
            if not WORD.search(line):
                continue
            reach = edits if len(line) >= least else 0
            if any(len(o) >= least or o == line for o in seen if abs(len(line) - len(o)) <= reach and distance(o, line) <= reach):
                out[row].append(i)
            if line not in seen:
                seen.append(line)
    return out
