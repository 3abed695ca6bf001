"""Structured Streaming jobs: ingest, rollup, deduplication and recompute of what a batch touched."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemeter.functions.scalars import exact_sum, usd
from tidemeter.model import CYCLE, DAY, LIMIT, USAGE, Params
from tidemeter.operators import windows as W
from tidemeter.operators.dedup import ARRIVAL, best_per_message
from tidemeter.operators.temporal import bucket_of
from tidemeter.session import cut
from tidemeter.sources import logs, runs
from tidemeter.streaming.state import ALIGN_DELAY, with_event_time


def rollup(usage: DataFrame, length: str = "1 hour", delay: str = ALIGN_DELAY) -> DataFrame:
    """Requests, tokens and cost per tumbling window and tool; a window is final once the watermark passes it."""
    return with_event_time(usage, delay).groupBy(F.window("event_time", length), "account_id", "tool").agg(
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.coalesce(usd(exact_sum("cost_pico")), F.lit(0.0)).alias("cost_usd")).select(
        F.unix_micros("window.start").alias("bucket"), "account_id", "tool", "requests", "input_tokens", "output_tokens", "cost_usd")


def drop_repeats(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First arrival per key within the watermark; older repeats are left to the keyed sink."""
    return with_event_time(stream, delay).dropDuplicatesWithinWatermark(keys)


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "60 seconds"})).start())


#: Runs of one level of a stream's tables that are merged to one.
FULL_STATE_EVERY = 16


def _table(spark: SparkSession, path: str, merge: runs.Merge | None, keys: list[str] | None = None, writer: str = "w") -> runs.RunTable:
    return runs.RunTable(spark, path, merge, runs.bucket(keys) if keys else None, FULL_STATE_EVERY, writer)


def ingest(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], keys: list[str], path: str, checkpoint: str,
           trigger: dict | None = None) -> StreamingQuery:
    """Parse every batch on its own and keep the first row of every key: replays and re-reads never count twice.

    For rows that are complete in themselves; log files that grow go through ``ingest_messages`` and ``ingest_sessions``.
    Read the table with ``ingested``.
    """
    writer = f"w{zlib.crc32(checkpoint.encode()):08x}"
    return _start(stream, lambda batch, n: _table(batch.sparkSession, path, runs.oldest(keys), keys, writer).write(parse(batch), n), checkpoint, trigger)


def ingested(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The rows of ``ingest``, one per key."""
    return _table(spark, path, runs.oldest(keys), keys).read()


USAGE_KEYS = ["account_id", "tool", "id"]


def upsert_usage(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep priced requests by id: a later copy only ever adds output, reasoning and cost.  Read them with ``upserted_usage``."""
    return _start(stream, lambda batch, n: _usage_table(batch.sparkSession, path).write(batch, n), checkpoint, trigger)


def _usage_table(spark: SparkSession, path: str) -> runs.RunTable:
    rest = [c for c in USAGE.fieldNames() if c not in (*USAGE_KEYS, "output_tokens", "reasoning_tokens", "cost_pico")]
    return _table(spark, path, runs.grown(USAGE_KEYS, "output_tokens", ["reasoning_tokens", "cost_pico"], rest), ["account_id", "id"])


def upserted_usage(spark: SparkSession, path: str) -> DataFrame | None:
    return _usage_table(spark, path).read()


_MESSAGE = ["account_id", "tool", "id", "file"]


def ingest_messages(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the best copy of each layout-A message of each file of a stream of log lines.

    No batch reads what is stored; ``message_usage`` settles which file's copy stands, exactly as one import of all lines would.
    """
    return _start(stream, lambda batch, n: _messages(batch.sparkSession, path).write(logs.parse_layout_a(batch), n), checkpoint, trigger)


def _messages(spark: SparkSession, path: str) -> runs.RunTable:
    return _table(spark, path, lambda df: best_per_message(df.drop(runs.RUN)), ["account_id", "id"])


def message_usage(spark: SparkSession, path: str, prices: DataFrame) -> DataFrame:
    """Requests of all stored messages."""
    return logs.usage_of_messages(_messages(spark, path).read(), prices)


def _carried(spark: SparkSession, path: str) -> runs.RunTable:
    return _table(spark, f"{path}/carried", runs.newest(["account_id", "file"]), ["account_id", "file"])


def _session_table(spark: SparkSession, path: str, name: str) -> runs.RunTable:
    """Requests or readings of session files; a line that is read again leaves its rows once."""
    keys = ["account_id", "tool", *ARRIVAL] + (["id"] if name == "requests" else ["scope", "window", "ts"])
    return _table(spark, f"{path}/{name}", runs.oldest(keys), ["account_id"])


def ingest_sessions(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the requests and readings of a stream of layout-B lines; files may grow from batch to batch.

    A file's lines only make sense after those before them, so each batch takes up what the file carried over
    (model, plan, links, session, counters) and leaves the same for the next.  A batch reads only what batches
    before it left, and leaves that last, so running it again gives the same rows.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = logs.session_rows(batch).persist()
        met = rows.select("account_id", "file").distinct()
        mine = _carried(spark, path).read(lambda df: df.join(met, ["account_id", "file"], "left_semi"), until=batch_id)
        folded = logs.fold_rows(rows, mine).persist()
        _session_table(spark, path, "requests").write(logs.requests_of(folded), batch_id)
        _session_table(spark, path, "snapshots").write(logs.snapshots_of(folded), batch_id)
        _carried(spark, path).write(logs.carry_over(rows, mine), batch_id)
        folded.unpersist()
        rows.unpersist()
    return _start(stream, work, checkpoint, trigger)


def session_tables(spark: SparkSession, path: str, prices: DataFrame, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """usage, links and snapshots of all stored sessions."""
    req, snaps = (_session_table(spark, path, t).read() for t in ("requests", "snapshots"))
    return logs.tables_of_sessions(req, snaps, prices, rules)


# -- windows kept current ----------------------------------------------------------------------------

_HOME = ["account_id", "tool"]
_DIGEST = [*LIMIT, "reset_bucket", "used_percent"]
_FACTS = ["id", "account_id", "tool", "ts", "model", "on_plan", "input_tokens", "cache_read_tokens", "output_tokens", "cost_pico"]


class WindowStore:
    """What ``maintain_windows`` keeps below ``home``: digests of readings, requests by day, and the spend of every window.

    A digest row sums up all readings of one percent value of one reset, so late readings merge into it in any order.
    Spend is kept per window together with the edges it was added up for.
    """

    def __init__(self, spark: SparkSession, home: str, p: Params):
        self.p, self.spark, self.scratch = p, spark, f"{home}/scratch"
        table = lambda name, merge, part: runs.RunTable(spark, f"{home}/{name}", merge, part, FULL_STATE_EVERY)
        self.digest = table("digest", runs.combined(
            _DIGEST, reset_min=F.min, reset_max=F.max, ts_min=F.min, ts_max=F.max, last_plan=F.max, first_reset=F.min, snapshots=F.sum), runs.bucket(_HOME))
        anchor = F.coalesce("resets_at", "ts")
        self.facts = table("requests", runs.oldest(["account_id", "tool", "id", "scope", "window", "resets_at"]), bucket_of(anchor, DAY))
        self.spend = table("spend", runs.newest(CYCLE), runs.bucket(_HOME))

    def _mine(self, touched: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """Rows of the touched accounts; only their buckets are read."""
        parts = [r.part for r in touched.select(runs.bucket(_HOME).alias("part")).distinct().collect()]
        return lambda df: df.where(F.col("part").isin(parts)).join(touched, _HOME, "left_semi")

    def _edges(self, keep, until: int | None = None, hold=lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """Window rows, their steps and their segments, from the digest alone."""
        digest = self.digest.read(keep, until)
        if digest is None:
            return None
        digest = hold(W.owned_digest(digest, self.p))
        rows, rises = W.cycles(digest, self.p), W.steps(digest)
        return rows, rises, W.segments(rows, rises)

    def _days(self, affected: DataFrame) -> list[int]:
        """Days that hold requests of the affected windows: of timed tools by the request, of linked ones by the reset."""
        timed = F.col("attribution") == "time"
        lo = F.when(timed, F.col("start")).otherwise(F.col("reset_min") - self.p.link_slack)
        hi = F.when(timed, F.col("end")).otherwise(F.col("reset_max") + self.p.link_slack)
        days = affected.select(F.explode(F.sequence(bucket_of(lo, DAY), F.greatest(bucket_of(lo, DAY), bucket_of(hi, DAY)))).alias("day"))
        return sorted(r.day for r in days.distinct().collect())

    def refresh(self, snapshots: DataFrame, requests: DataFrame, batch: int) -> None:
        """Take in a batch's readings and requests and add up again the spend of the windows they change, reading those windows' days only."""
        self.digest.write(W.snapshot_digest(snapshots, self.p), batch)
        mine = requests.select(*_FACTS, *_LINK_COLS)
        self.facts.write(mine, batch)
        runs.remove(self.spark, self.scratch)
        hold = lambda df: cut(df, f"{self.scratch}/{batch}")
        touched = hold(snapshots.select(*_HOME).unionByName(requests.select(*_HOME)).distinct())
        keep = self._mine(touched)
        edges = self._edges(keep, batch + 1, hold)
        if edges is None:
            return
        rows, _, segs = edges
        rows, segs = hold(rows), hold(segs)
        # a window may also lose all its segments to its neighbours, so every window has edges
        parts = segs.groupBy(*CYCLE).agg(F.sort_array(F.collect_list(F.struct("step_no", "lo", "hi"))).alias("parts"))
        signed = hold(rows.select(*CYCLE, "reset_max").join(parts, CYCLE, "left").select(*CYCLE, F.xxhash64("parts", "reset_max").alias("edges")))
        stored = self.spend.read(keep, batch)
        stale = signed if stored is None else signed.join(stored.select(*CYCLE, F.col("edges").alias("was")), CYCLE, "left").where(
            ~F.col("edges").eqNullSafe(F.col("was")))
        hit = W.attribute(*_usage_and_links(mine), segs, self.p).select(*CYCLE)
        affected = hold(stale.select(*CYCLE).unionByName(hit).distinct())
        days = self._days(rows.join(affected, CYCLE, "left_semi"))
        facts = self.facts.read(lambda df: df.where(F.col("part").isin(days)).join(touched, _HOME, "left_semi"), batch + 1)
        spend = W.segment_spend(W.attribute(*_usage_and_links(facts), segs.join(affected, CYCLE, "left_semi"), self.p))
        per_window = spend.groupBy(*CYCLE).agg(F.collect_list(F.struct(*[c for c in spend.columns if c not in CYCLE])).alias("parts"))
        empty = F.array().cast(per_window.schema["parts"].dataType)
        self.spend.write(signed.join(affected, CYCLE, "left_semi").join(per_window, CYCLE, "left").select(
            *CYCLE, "edges", F.coalesce("parts", empty).alias("parts")), batch)
        runs.remove(self.spark, self.scratch)

    def windows(self) -> DataFrame | None:
        """All windows as ``windows.build_windows`` gives them."""
        edges = self._edges(None)
        if edges is None:
            return None
        rows, rises, _ = edges
        return W.windows_with_spend(rows, rises, self.spend.read().select(*CYCLE, F.inline("parts")))


_LINK_COLS = ["scope", "window", "resets_at"]


def _usage_and_links(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    usage = facts.select(*_FACTS).dropDuplicates(["account_id", "tool", "id"])
    return usage, facts.where(F.col("resets_at").isNotNull()).select(F.col("id").alias("usage_id"), "account_id", "tool", *_LINK_COLS)


def linked_requests(usage: DataFrame, links: DataFrame) -> DataFrame:
    """Requests with their links: one row a link, or one without."""
    side = links.select(F.col("usage_id").alias("id"), "account_id", "tool", *_LINK_COLS)
    return usage.select(*_FACTS).join(side, ["account_id", "tool", "id"], "left").select(*_FACTS, *_LINK_COLS)


def maintain_windows(snapshots: DataFrame, requests: DataFrame, home: str, p: Params, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep windows current over streams of readings and of requests (``linked_requests``), late ones included.

    Everything is a minimum, a maximum or a sum over stored rows, so rows in any order give the windows of a rebuild
    of everything; read them with ``WindowStore.windows``.
    """
    side = lambda df, name, other: df.select(F.struct(*df.columns).alias(name), F.lit(None).cast(other.schema).alias("r" if name == "s" else "s"))
    both = side(snapshots, "s", requests).unionByName(side(requests, "r", snapshots))

    def refresh(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        part = lambda c: rows.where(F.col(c).isNotNull()).select(f"{c}.*")
        WindowStore(batch.sparkSession, home, p).refresh(part("s"), part("r"), batch_id)
        rows.unpersist()
    return _start(both, refresh, checkpoint, trigger)
