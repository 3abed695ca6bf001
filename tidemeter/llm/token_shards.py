"""Training-order materialisation: token sequences at a keyed random place in fixed-stride shards.

Documents are encoded and cut into sequences of ``length`` tokens; the last one of a document is padded.  The
sequences are numbered 0 to N - 1 in the order of the input, and a keyed Feistel permutation of these numbers gives each its
slot.  The permutation works on the next power of four; a result outside 0 to N - 1 is permuted again until it
falls inside (cycle-walking), so slots are again exactly 0 to N - 1.  It is plain arithmetic on columns: any task
can work out any slot, and a key gives the same order again.

Slots are dealt by range, and each range writes its shards in order: ``per_shard`` records of one stride.  So the record of a
slot is at byte (slot % per_shard) * stride of shard slot // per_shard, and reading can resume at any slot without
reading what comes before it.

Encoded sequences are written once before they are numbered, so a number is stable however often a task is run
again.  Null and empty texts give no sequence.  Repeated rows give their sequences each.  Null keys stay null.
Other columns, whatever their names, are left out; an empty table gives no shard.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.llm.byte_bpe import read_ranks
from tidemeter.llm.memo import per_process
from tidemeter.session import at_most, checkpoint_dir, cut

ROUNDS = 6
#: Bytes of one row group of a shard file.
ROW_GROUP = 8 << 20
#: Input splits whose offsets may be broadcast: 16 MB.
BROADCAST_PARTS = 1_000_000


def permutation(n: int, key: int):
    """``numbers -> slots`` for 0 to n - 1, vectorised."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.frombuffer(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=16).digest(), dtype=np.uint64) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for a, b in keys:
            f = (right + a) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29)) ^ b) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << shift) | right

    def slots(numbers: np.ndarray) -> np.ndarray:
        out = once(numbers.astype(np.uint64))
        while (outside := out >= n).any():  # the domain is less than four times n, so few steps are needed
            out[outside] = once(out[outside])
        return out.astype(np.int64)

    return slots


def _encoder(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    """This process's encoder; texts are encoded with the installed library, ids are those of ``byte_bpe``."""
    def build() -> tiktoken.Encoding:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return per_process(("encoder", hashlib.sha256(rank_file).digest(), pattern), build)


def _sequences(length: int, pad: int, ranks, pattern: str, fits_16: bool):
    """(key, text) to one row for each sequence, numbered inside its task's partition."""
    kind = "<u2" if fits_16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=3)
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(ranks.value, pattern)
            for lo in range(0, batch.num_rows, 256):
                keys, texts = batch.column(0).slice(lo, 256), batch.column(1).slice(lo, 256).to_pylist()
                row, piece, used, packed = [], [], [], []
                for r, text in enumerate(texts):
                    ids = encoder.encode_to_numpy(text or "", disallowed_special=())
                    for k in range(0, len(ids), length):
                        own = ids[k:k + length]
                        full = np.full(length, pad, dtype=kind)
                        full[:len(own)] = own
                        row.append(r)
                        piece.append(k // length)
                        used.append(len(own))
                        packed.append(packer.compress(full.tobytes()))
                n = len(row)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int64()), pa.array(used, pa.int64()),
                                                  pa.array(np.full(n, part)), pa.array(np.arange(count, count + n)), pa.array(packed, pa.binary())],
                                                 ["k0", "piece", "n_tokens", "part", "place", "record"])
                count += n
    return run


def sequences(docs: DataFrame, rank_path: str, pattern: str, *, length: int = 1024, pad: int | None = None, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """``k0`` (the key), ``piece``, ``n_tokens``, ``number`` (0 to N - 1) and ``record`` (zstandard-compressed ids of one stride) of every sequence."""
    sc = docs.sparkSession.sparkContext
    ranks = sc.broadcast(read_ranks(rank_path))
    largest = sum(1 for line in ranks.value.splitlines() if line)
    pad = largest if pad is None else pad
    kind = docs.schema[key].dataType.simpleString()
    rows = cut(docs.select(docs[key].alias("k0"), docs[text].alias("body")).mapInArrow(
        _sequences(length, pad, ranks, pattern, max(pad, largest) < 1 << 16), f"k0 {kind}, piece long, n_tokens long, part long, place long, record binary"))
    # One row for each input split, so small whatever the number of sequences; the sequences themselves stay where they are.
    parts = cut(rows.groupBy("part").agg(F.count("*").alias("n")).selectExpr(
        "part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before"))
    parts = F.broadcast(parts) if at_most(parts, BROADCAST_PARTS) else parts
    return rows.join(parts, "part").select("k0", "piece", "n_tokens", F.expr("before + place").alias("number"), "record")


def write_shards(docs: DataFrame, path: str, rank_path: str, pattern: str, *, seed: int = 1, length: int = 1024, per_shard: int = 64,
                 pad: int | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Writes shards under ``path``, with any scheme Spark can write: one row for each shard, in range-partitioned files.

    ``shard``, ``first_slot`` and ``last_slot``, ``stride`` (bytes), ``keys``, ``pieces`` and ``used`` (tokens before the padding) of its records
    in order, and ``records``, the ids of all its records end to end.
    """
    rows = sequences(docs, rank_path, pattern, length=length, pad=pad, key=key, text=text)
    n = rows.count()
    order = permutation(max(n, 1), seed)

    @F.pandas_udf("long")
    def slot(number):
        import pandas as pd
        return pd.Series(order(number.to_numpy()))

    kind = docs.schema[key].dataType.simpleString()
    width = 2 if max(pad or 0, sum(1 for line in read_ranks(rank_path).splitlines() if line)) < 1 << 16 else 4
    schema = f"shard long, first_slot long, last_slot long, stride long, `keys` array<{kind}>, pieces array<long>, used array<long>, records binary"
    placed = rows.withColumn("slot", slot("number")).withColumn("shard", F.expr(f"slot div {per_shard}"))
    (placed.repartitionByRange("shard").sortWithinPartitions("slot").select("shard", "slot", "k0", "piece", "n_tokens", "record")
     .mapInArrow(_pack(per_shard, length * width), schema)
     # small row groups: readers skip to a slot, and writers hold little
     .write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path))


def _pack(per_shard: int, stride: int):
    """Rows in slot order to whole shards; holds one shard at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        held: list[pa.RecordBatch] = []
        kind = None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            shard, n = t.column("shard")[0].as_py(), t.num_rows
            body = b"".join([unpacker.decompress(x) for x in t.column("record").to_pylist()])
            if len(body) != n * stride:
                raise ValueError("a record is not one stride long")

            def one(values) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values.combine_chunks())

            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([shard * per_shard]), pa.array([shard * per_shard + n - 1]), pa.array([stride]), one(t.column("k0")), one(t.column("piece")),
                 one(t.column("n_tokens")), pa.array([body], pa.binary())], ["shard", "first_slot", "last_slot", "stride", "keys", "pieces", "used", "records"])

        for batch in batches:
            shard = batch.column(0).to_numpy()
            at = 0
            while at < len(shard):
                if held and kind != shard[at]:
                    yield flush()
                    held = []
                kind = shard[at]
                to = int(np.searchsorted(shard, kind, side="right"))
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield flush()
    return run


def read_slots(spark: SparkSession, path: str, from_slot: int = 0, to_slot: int | None = None) -> DataFrame:
    """Records ``from_slot`` to ``to_slot`` (excluded; None: all) in order of their slots: ``slot``, ``key``, ``piece``, ``n_tokens``, ``record``.

    Only the shards in question are read, by the statistics of their files; a record is cut out by its stride.
    """
    shards = spark.read.parquet(path).filter(F.col("last_slot") >= from_slot)
    shards = shards if to_slot is None else shards.filter(F.col("first_slot") < to_slot)
    rows = shards.select("first_slot", "stride", "records", F.posexplode(F.arrays_zip("keys", "pieces", "used")).alias("k", "of"))
    out = rows.select((F.col("first_slot") + F.col("k")).alias("slot"), F.col("of.keys").alias("key"), F.col("of.pieces").alias("piece"),
                      F.col("of.used").alias("n_tokens"), F.expr("substring(records, CAST(k * stride + 1 AS INT), CAST(stride AS INT))").alias("record"))
    out = out.filter(F.col("slot") >= from_slot)
    return out if to_slot is None else out.filter(F.col("slot") < to_slot)


def materialised(docs: DataFrame, rank_path: str, pattern: str, *, key: str = "doc_id", **how) -> DataFrame:
    """Writes the shards into the checkpoint folder and reads them back: ``slot``, ``shard``, ``offset`` (bytes), the key, ``piece``,
    ``n_tokens`` and the SHA-256 of the record of every sequence."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, rank_path, pattern, key=key, **how)
    shards = spark.read.parquet(path)
    rows = shards.select("shard", "first_slot", "stride", F.posexplode(F.expr(
        "transform(arrays_zip(`keys`, pieces, used), (x, i) -> named_struct('key', x.`keys`, 'piece', x.pieces, 'n', x.used, "
        "'sha', sha2(substring(records, CAST(i * stride + 1 AS INT), CAST(stride AS INT)), 256)))")).alias("k", "of"))
    return rows.select((F.col("first_slot") + F.col("k")).alias("slot"), "shard", (F.col("k") * F.col("stride")).alias("offset"), F.col("of.key").alias(key),
                       F.col("of.piece").alias("piece"), F.col("of.n").alias("n_tokens"), F.col("of.sha").alias("record_sha256"))
