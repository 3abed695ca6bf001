"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton over the vocabulary.

A text is cut by the tokenizer's pattern; each piece is encoded on its own.  Bytes are mapped to Latin-1 so that
the automaton sees one character a byte.  From the left, the longest vocabulary entry is taken if it may follow
the token before it; otherwise the next shorter entry, and with none left the last token is taken back and its
place marked as a dead end.  Two tokens may stand side by side when merging their joint bytes by rank gives
exactly the two; that verdict is memoised.  Every place is tried once for each entry, so the time is linear in
the piece, and the token list is the one that the merges give.

Null and empty texts have no tokens.  Rows are independent of each other, so the job is a narrow map: it needs no
shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemeter.llm.memo import per_process

#: Distinct stretches whose tokens a Python worker remembers, the first it meets; the others are worked out each time.
REMEMBERED = 120_000


def read_ranks(path: str) -> bytes:
    """The rank file as it is: about a megabyte, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder for one rank file and one pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.sizes = [0] * (max(self.tokens, default=0) + 1)
        for rank, token in self.tokens.items():
            self.sizes[rank] = len(token)
        self.prefixes: dict[int, int] = {}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.stretches = _Stretches(self)

    def merged(self, data: bytes) -> list[int]:
        """Tokens by the merges themselves: the pair of least rank first, leftmost if equal."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            at, least = -1, None
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (least is None or rank < least):
                    at, least = i, rank
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 32 | right)
        if known is None:
            known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self.pairs) < 2 * REMEMBERED:
                self.pairs[left << 32 | right] = known
        return known

    def shorter(self, rank: int) -> int:
        """The longest entry that is a proper prefix of this one; -1 for single bytes."""
        known = self.prefixes.get(rank)
        if known is None:
            token = self.tokens[rank]
            known = next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), -1)
            self.prefixes[rank] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None or not data:
            return [whole] if data else []
        n, sizes, pairs = len(data), self.sizes, self.pairs
        longest = [-1] * n  # by first byte; matches come in order of their ends, so the last one stays
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - sizes[rank]] = rank
        out: list[int] = []
        at, last, rank, dead = 0, -1, longest[0], bytearray(n + 1)
        while at < n:
            while rank >= 0:
                if not dead[at + sizes[rank]]:
                    if last < 0:
                        break
                    known = pairs.get(last << 32 | rank)
                    if self.fits(last, rank) if known is None else known:
                        break
                rank = self.shorter(rank)
            if rank >= 0:
                out.append(rank)
                at += sizes[rank]
                last, rank = rank, longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the ranks do not cover every byte")
                dead[at] = 1
                rank = out.pop()
                at -= sizes[rank]
                last, rank = out[-1] if out else -1, self.shorter(rank)
        return out

    def _pieces(self, found: list[str]) -> bytes:
        out = []
        for p in found:
            got = self.words.get(p)
            if got is None:
                got = np.array(self.piece(p.encode("utf-8")), dtype="<u4").tobytes()
                if len(self.words) < REMEMBERED // 8 and len(p) <= 32:
                    self.words[p] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        A space with no white space on one of its sides always opens a piece or closes one, so the stretches
        between spaces are independent of each other and their ids can be remembered.  Texts with a space between
        two white spaces go through the pattern as a whole.
        """
        if _WITHIN_SPACE.search(text):
            return self._pieces(self.pattern.findall(text))
        head, *rest = text.split(" ")
        return self._pieces(self.pattern.findall(head)) + b"".join(map(self.stretches.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def codec_of(rank_file: bytes, pattern: str) -> Codec:
    """This process's codec."""
    return per_process(("codec", hashlib.sha256(rank_file).digest(), pattern), lambda: Codec(rank_file, pattern))


_WITHIN_SPACE = regex.compile(r"(?:\A|\s) (?:\s|\Z)")


class _Stretches(dict):
    """Ids of " " + stretch, worked out when first asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, stretch: str) -> bytes:
        codec = self.codec
        found = codec.pattern.findall(" " + stretch)
        if len(found) == 1:
            got = np.array(codec.piece(found[0].encode("utf-8")), dtype="<u4").tobytes()
        elif len(found[0]) > 1 and found[0][0] == " ":
            got = self[found[0][1:]] + codec._pieces(found[1:])
        else:
            got = codec._pieces(found)
        if len(self) < REMEMBERED and len(stretch) <= 32:
            self[stretch] = got
        return got


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text", *,
                     ids: bool = False, digests: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Token counts, ids and digests of every text.

    Returns ``key``, the ``keep`` columns, ``n_tokens``, with ``ids`` the ids as little-endian 32-bit binary, and
    with ``digests`` the SHA-256 of the ids and of the bytes that decoding the ids gives back.  Null or empty text:
    0 tokens and the digests of nothing.  Repeated rows are encoded each; other columns, whatever their names, are
    left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))
    held = [key, *[c for c in keep if c != key]]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*held).schema], "n_tokens long"]
                       + ["ids binary"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or codec_of(ranks.value, pattern)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [codec.encode(t or "") for t in part.column(len(held)).to_pylist()]
                cols = [*[part.column(i) for i in range(len(held))], pa.array([len(x) // 4 for x in got], pa.int64())]
                names = [*held, "n_tokens"]
                if ids:
                    cols.append(pa.array(got, pa.binary()))
                    names.append("ids")
                if digests:
                    cols += [pa.array([hashlib.sha256(x).hexdigest() for x in got]),
                             pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in got])]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(*held, docs[text].alias("__text")).mapInArrow(run, schema)


def decode_documents(tokens: DataFrame, rank_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The text of every id list (``key``, ``text``); bytes that are no UTF-8 become replacement characters, null ids null."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or codec_of(ranks.value, r"\X")
            text = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], [key, "text"])

    return tokens.select(key, tokens[ids].alias("__ids")).mapInArrow(run, f"`{key}` {kind}, text string")
