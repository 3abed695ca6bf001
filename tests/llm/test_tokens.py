import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import odd_documents, odd_rows, sha
from tidemeter.llm import byte_bpe, token_shards

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CODEC = byte_bpe.Codec(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb") if line.strip())}
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\t'sé1!\x1c\x85 ​漢", max_size=40)))
def test_ids_are_those_of_the_merges(text):
    text = text.encode("utf-8", "replace").decode("utf-8")
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == OTHER.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode("utf-8")


def test_documents_with_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect())
    want = sorted((d or 0, len(i), sha(np.array(i, "<u4").tobytes()), sha((t or "").encode())) for d, t in odd_rows() for i in [OTHER.encode_ordinary(t or "")])
    assert got == want
    ids = byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, ids=True, digests=False)
    back = sorted((r.doc_id or 0, r.text) for r in byte_bpe.decode_documents(ids, PATH).collect())
    assert back == sorted((d or 0, t or "") for d, t in odd_rows())
    assert byte_bpe.encode_documents(odd_documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_slots_are_a_permutation(n):
    a, b = (token_shards.permutation(n, k)(np.arange(n)) for k in (1, 2))
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    assert n < 17 or a.tolist() != b.tolist()


def test_shards_hold_every_sequence_once_and_resume(spark, tmp_path):
    docs, path = odd_documents(spark), str(tmp_path / "shards")
    token_shards.write_shards(docs, path, PATH, public_tokenizers.PATTERN, seed=3, length=64, per_shard=16)
    rows = token_shards.read_slots(spark, path).collect()
    want = []
    for d, t in odd_rows():
        ids = OTHER.encode_ordinary(t or "")
        for k in range(0, len(ids), 64):
            part = ids[k:k + 64]
            want.append((d or 0, k // 64, len(part), np.array(part + [50256] * (64 - len(part)), "<u2").tobytes()))
    assert sorted((r.key or 0, r.piece, r.n_tokens, bytes(r.record)) for r in rows) == sorted(want)
    assert sorted(r.slot for r in rows) == list(range(len(want)))
    some = token_shards.read_slots(spark, path, 40, 90).collect()
    assert {r.slot: bytes(r.record) for r in some} == {r.slot: bytes(r.record) for r in rows if 40 <= r.slot < 90}
    shards = spark.read.parquet(path).collect()
    assert all(len(s.records) == s.stride * (s.last_slot - s.first_slot + 1) and s.first_slot == 16 * s.shard for s in shards)
    report = token_shards.materialised(docs, PATH, public_tokenizers.PATTERN, seed=3, length=64, per_shard=16).collect()
    assert {(r.slot, r.shard, r.offset, r.record_sha256) for r in report} == {(r.slot, r.slot // 16, r.slot % 16 * 128, sha(bytes(r.record))) for r in rows}


def test_no_documents_no_shards(spark):
    assert token_shards.materialised(odd_documents(spark, [(1, ""), (2, None)]), PATH, public_tokenizers.PATTERN).count() == 0
    assert token_shards.materialised(odd_documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
