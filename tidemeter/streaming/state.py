"""Keyed state over streams: live windows with their spend, visible changes, alert cool-down, alignment of two streams.

Everything goes by event time: rows may come in any order within the delay, and state ends by timers that fire when the watermark
passes them.  Queries with this state need Spark's RocksDB state store; ``start`` sets it for the query it starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemeter.functions.scalars import in_scope, round_reset
from tidemeter.model import DAY, HOUR, LIMIT, SEC, WINDOW_SECONDS

_L, _D, _S, _B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
MS = 1000
#: Quota readings may lag the request log by this much.
ALIGN_DELAY = "10 minutes"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that a task holds, packed to some 40 bytes each, before it passes them on.
CHUNK = 1_000_000


def _schema(**f: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in f.items()])


_KEYS = dict(account_id=_L, tool=_S, scope=_S, window=_S)


def with_event_time(stream: DataFrame, delay: str = ALIGN_DELAY) -> DataFrame:
    """Add the event-time column streams are watermarked on."""
    return stream.withColumn("event_time", F.timestamp_micros("ts")).withWatermark("event_time", delay)


def start(df: DataFrame, mode: str, work: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query with keyed state; the session's own choice of a state store is put back."""
    conf = df.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        return (df.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"processingTime": "60 seconds"})).start())
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)


# -- rows packed before they are dealt out ----------------------------------------------------------

def _packed(rows: DataFrame, keys: list[str], item: np.dtype) -> DataFrame:
    """Rows as one row per key and hour of ``ts`` of each task: the columns of ``item`` as bytes, and the latest instant.

    Keys may be few and their rows many; so the work of a row is done before they meet, where they lie.  Rows without an instant are left out.
    """
    def bundles(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        items = np.empty(table.num_rows, item)
        for c in item.names:
            items[c] = table[c].to_numpy()
        codes = [*[_codes(table[k]) for k in keys], items["ts"] // HOUR]
        order = np.lexsort(codes)
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in codes:
            new[1:] |= np.diff(c[order]) != 0
        first, items = np.flatnonzero(new), items[order]
        parts = [part.tobytes() for part in np.split(items, first[1:])]
        heads = table.select(keys).take(pa.array(order[first]))
        columns = [heads[k].combine_chunks() for k in keys]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        latest = pa.array(np.maximum.reduceat(items["ts"], first))
        yield pa.RecordBatch.from_arrays([*columns, latest, pa.array(parts, pa.binary())], [*keys, "ts", "items"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield from bundles(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from bundles(pa.Table.from_batches(held))

    slim = rows.where(F.col("ts").isNotNull()).select(*keys, *item.names)
    schema = T.StructType([*[slim.schema[k] for k in keys], T.StructField("ts", _L), T.StructField("items", T.BinaryType())])
    return slim.mapInArrow(pack, schema)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for every value of a column; -1 for null."""
    found = column.dictionary_encode().combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    return found.indices.fill_null(-1).to_numpy()


def _unpacked(rows: Iterator[Row], column: str, item: np.dtype) -> Iterator[np.ndarray]:
    """The items of packed rows, so many at once as a task may hold."""
    held, n = [], 0
    for row in rows:
        data = row[column]
        if data is None:
            continue
        held.append(bytes(data))
        n += len(data)
        if n >= CHUNK * item.itemsize:
            yield np.frombuffer(b"".join(held), item)
            held, n = [], 0
    if held:
        yield np.frombuffer(b"".join(held), item)


def _by_slice(items: np.ndarray, slices: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, its items)"""
    if not len(items):
        return
    order = np.argsort(slices, kind="stable")
    items, slices = items[order], slices[order]
    first = np.flatnonzero(np.r_[True, np.diff(slices) != 0])
    for s, part in zip(slices[first].tolist(), np.split(items, first[1:])):
        yield s, part


# -- rows of a key in their order ------------------------------------------------------------------

class InOrder(StatefulProcessor):
    """Folds the rows of a key in the order of event time, whatever the order and batches they come in.

    Rows wait in the state store by block of time, packed as bytes; when the watermark passes a slice, the rows of its block up to the
    watermark's slice are sorted and folded into one value per key.  A task holds ``CHUNK`` packed rows of one key or one block of it at
    most.  Rows of a slice already folded are too late and left out.
    """

    slice_span = 60 * SEC
    block = HOUR  # whole slices
    item: np.dtype  # of a row: the instant first, no nulls
    value_schema: T.StructType

    def fold(self, key: tuple, value: tuple | None, rows: list[tuple]) -> tuple[tuple, list[Row]]:
        """The value after ``rows``, which are sorted, and what to put out."""
        raise NotImplementedError

    def keep_until(self, value: tuple) -> int | None:
        """Instant from which the value says nothing any more; None if it always does."""
        return None

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _schema(block=_L), _schema(rows=T.BinaryType()))
        self.value = handle.getValueState("value", self.value_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for items in _unpacked(rows, "items", self.item):
            items = items[self._ends(items) > timerValues.getCurrentWatermarkInMs()]
            for block, part in _by_slice(items, items["ts"] // self.block):
                due = self._ends(part).min()
                if self.waiting.containsKey((block,)):
                    old = self._waiting(block)
                    if due < self._ends(old).min():
                        self.handle.registerTimer(int(due))
                    part = np.concatenate([old, part])
                else:
                    self.handle.registerTimer(int(due))
                self.waiting.updateValue((block,), (bytearray(part.tobytes()),))
        return iter(())

    def _waiting(self, block: int) -> np.ndarray:
        return np.frombuffer(bytes(self.waiting.getValue((block,))[0]), self.item)

    def _ends(self, items: np.ndarray) -> np.ndarray:
        """Ends of the slices of rows, in milliseconds."""
        return (items["ts"] // self.slice_span + 1) * self.slice_span // MS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() * MS
        block = (at - 1) // self.block
        value = self.value.get() if self.value.exists() else None
        if self.waiting.containsKey((block,)):
            items = self._waiting(block)
            passed = self._ends(items) <= timerValues.getCurrentWatermarkInMs()
            rest = items[~passed]
            if len(rest):
                self.handle.registerTimer(int(self._ends(rest).min()))
                self.waiting.updateValue((block,), (bytearray(rest.tobytes()),))
            else:
                self.waiting.removeKey((block,))
            if passed.any():
                value, out = self.fold(tuple(key), value, sorted(items[passed].tolist()))
                self.value.update(value)
                until = self.keep_until(value)
                if until is not None:  # at the end of a slice, after the rows of that slice
                    self.handle.registerTimer(-(-until // self.slice_span) * self.slice_span // MS)
                yield from out
        until = self.keep_until(value) if value is not None else None
        if until is not None and until <= at:
            self.value.clear()

    def close(self) -> None:
        pass


CHANGE = _schema(**_KEYS, ts=_L, used_percent=_D, reset=_L)


class _Changes(InOrder):
    item = np.dtype([("ts", "<i8"), ("used_percent", "<f8"), ("reset", "<i8")])
    value_schema = _schema(used_percent=_D, reset=_L)

    def fold(self, key, value, rows):
        out, last = [], None if value is None else tuple(value)
        for ts, percent, reset in rows:
            if (percent, reset) != last:
                out.append(Row(**dict(zip(CHANGE.names, (*key, ts, percent, reset)))))
            last = (percent, reset)
        return last, out


def visible_changes(snapshots: DataFrame, delay: str = ALIGN_DELAY) -> DataFrame:
    """Snapshots after which a limit's percent or reset minute differs from the snapshot before, in the order of time.

    Put out once the watermark has passed them.  One small tuple per limit stays, besides the rows that wait.
    """
    rows = snapshots.where(F.col("resets_at").isNotNull() & F.col("used_percent").isNotNull()).select(
        *LIMIT, "ts", F.col("used_percent").cast("double").alias("used_percent"), round_reset("resets_at").alias("reset"))
    return with_event_time(_packed(rows, LIMIT, _Changes.item), delay).groupBy(*LIMIT).transformWithState(_Changes(), CHANGE, "Append", "EventTime")


ALERT_KEYS = ["account_id", "tool", "window", "direction"]
_ALERT_OUT = _schema(account_id=_L, tool=_S, window=_S, direction=_S, ts=_L, ratio=_D)


class _Cooled(InOrder):
    item = np.dtype([("ts", "<i8"), ("ratio", "<f8")])
    value_schema = _schema(last=_L)

    def __init__(self, cooldown: int):
        self.cooldown = cooldown

    def fold(self, key, value, rows):
        out, last = [], None if value is None else value[0]
        for ts, ratio in rows:
            if last is None or ts - last >= self.cooldown:
                out.append(Row(**dict(zip(_ALERT_OUT.names, (*key, ts, ratio)))))
                last = ts
        return (last,), out

    def keep_until(self, value):
        return value[0] + self.cooldown


def cooled_alerts(alerts: DataFrame, cooldown: int = 24 * HOUR, delay: str = ALIGN_DELAY) -> DataFrame:
    """Alerts at least the cool-down after the last one let through of the same limit and direction, in the order of time.

    A direction's state ends with its cool-down.
    """
    rows = alerts.select(*ALERT_KEYS, "ts", F.coalesce(F.col("ratio").cast("double"), F.lit(float("nan"))).alias("ratio"))
    out = with_event_time(_packed(rows, ALERT_KEYS, _Cooled.item), delay).groupBy(*ALERT_KEYS).transformWithState(_Cooled(cooldown), _ALERT_OUT, "Append", "EventTime")
    return out.withColumn("ratio", F.nanvl("ratio", F.lit(None).cast("double")))


# -- live windows ----------------------------------------------------------------------------------

LIVE = _schema(**_KEYS, reset_min=_L, reset_max=_L, first_seen=_L, last_seen=_L, used_percent=_D, cost_at_snapshot=_D, cost_so_far=_D,
               unpriced_requests=_L, final=_B)
_SIGHT = _schema(lo=_L, hi=_L, first=_L, last=_L, percent=_D, seconds=_L, closed=_B)
#: A request, or the sum of several; pico-dollars in two parts, so that sums of many stay exact.
_ITEM = np.dtype([("anchor", "<i8"), ("ts", "<i8"), ("high", "<i8"), ("low", "<i8"), ("unpriced", "<i8")])
_SEEN = np.dtype([("ts", "<i8"), ("resets_at", "<i8"), ("used_percent", "<f8"), ("window_seconds", "<i8")])
#: What a reading of unknown window length is waited for.
_LONGEST = 31 * DAY


_LOW = (1 << 32) - 1


def _pico(items: np.ndarray) -> int:
    return (int(items["high"].sum()) << 32) + int(items["low"].sum())


class _Ledger(StatefulProcessor):
    """State of one limit: what was seen of each reset in progress, and the spend of the time they may cover, by slice.

    Requests of one instant are summed as they are stored, packed as bytes; a slice that the watermark has passed and that no edge of a
    window can cut any more becomes one sum.  So state is bounded by the slices in a window and the requests since the last reading.
    A timer some time after a window's reset puts out its last row; others end its spend.
    """

    def __init__(self, jitter: int, slack: int, slice_span: int, hold: int):
        self.jitter, self.slack, self.slice_span, self.hold = jitter, slack, slice_span, hold

    def init(self, handle) -> None:
        self.handle = handle
        self.sights = handle.getValueState("sights", _schema(rows=T.ArrayType(_SIGHT)))
        self.spend = handle.getMapState("spend", _schema(slice=_L), _schema(items=T.BinaryType()))

    # readings

    def _seen(self) -> list[list]:
        return [list(r) for r in self.sights.get()[0]] if self.sights.exists() else []

    def _see(self, sights: dict[int, list], rows: np.ndarray) -> None:
        """Readings summed up by reset; the window's length is that of the least reset."""
        rows = rows[np.lexsort((rows["window_seconds"], rows["resets_at"]))]
        bucket = rows["resets_at"] // self.jitter
        first = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
        least, most = rows[first], rows[np.r_[first[1:], len(rows)] - 1]
        found = zip(bucket[first].tolist(), least["resets_at"].tolist(), most["resets_at"].tolist(), np.minimum.reduceat(rows["ts"], first).tolist(),
                    np.maximum.reduceat(rows["ts"], first).tolist(), np.maximum.reduceat(rows["used_percent"], first).tolist(),
                    least["window_seconds"].tolist())
        for b, lo, hi, ts, last, percent, seconds in found:
            a = sights.get(b, [lo, hi, ts, last, percent, seconds, False])
            sights[b] = [min(a[0], lo), max(a[1], hi), min(a[2], ts), max(a[3], last), max(a[4], percent), min((a[0], a[5]), (lo, seconds))[1], False]

    def _merge(self, old: list[list], fresh: dict[int, list]) -> list[list]:
        """Sights by reset, those within the jitter of each other as one."""
        out: list[list] = []
        for r in sorted([*old, *fresh.values()]):
            if out and r[0] - out[-1][1] <= self.jitter:
                a = out[-1]
                seconds = a[5]  # the length that came with the least reset
                out[-1] = [a[0], max(a[1], r[1]), min(a[2], r[2]), max(a[3], r[3]), max(a[4], r[4]), seconds, a[6] and r[6]]
            else:
                out.append(r)
        return out

    def _spans(self, timed: bool, seen: list[list]) -> list[tuple]:
        """(sight, start, end) in the order of first sight; what two windows of a timed tool both cover is cut as in the batch rebuild."""
        rows = [[r, r[0] - r[5] * SEC, r[1]] for r in sorted(seen, key=lambda r: (r[2], r[0]))]
        cuts = [max(b[1], a[0][3]) if timed and b[1] < a[2] else None for a, b in zip(rows, rows[1:])]
        for k, cut in enumerate(cuts):
            if cut is not None:
                rows[k][2], rows[k + 1][1] = cut, cut
        return [tuple(r) for r in rows]

    # spend

    def _kept_for(self, key: tuple) -> int:
        """How long after its end a slice can still be part of a window in progress; in whole slices."""
        wait = WINDOW_SECONDS.get(key[3], _LONGEST // SEC) * SEC if key[1] == "timed" else 0
        return -(-(wait + self.jitter + self.hold) // self.slice_span) * self.slice_span

    def _items(self, s: int) -> np.ndarray:
        return np.frombuffer(bytes(self.spend.getValue((s,))[0]), _ITEM)

    def _store(self, s: int, items: np.ndarray) -> None:
        """Keep the items of a slice, those of one anchor and instant as one."""
        items = items[np.lexsort((items["ts"], items["anchor"]))]
        first = np.flatnonzero(np.r_[True, (np.diff(items["anchor"]) != 0) | (np.diff(items["ts"]) != 0)])
        out = items[first]
        low = np.add.reduceat(items["low"], first)
        out["high"] = np.add.reduceat(items["high"], first) + (low >> 32)
        out["low"] = low & _LOW
        out["unpriced"] = np.add.reduceat(items["unpriced"], first)
        self.spend.updateValue((s,), (bytearray(out.tobytes()),))

    def _add(self, key: tuple, fresh: np.ndarray) -> None:
        for s, items in _by_slice(fresh, fresh["ts" if key[1] == "timed" else "anchor"] // self.slice_span):
            end = (s + 1) * self.slice_span
            if self.spend.containsKey((s,)):
                items = np.concatenate([self._items(s), items])
            else:
                self.handle.registerTimer(end // MS)
                self.handle.registerTimer((end + self._kept_for(key)) // MS)
            self._store(s, items)

    def _costs(self, timed: bool, sight: list, start: int, end: int) -> tuple[float, float, int]:
        """Cost at the last sight, cost so far, and unpriced requests of one window."""
        at, far, unpriced = 0, 0, 0
        lo, hi = (start, end - 1) if timed else (sight[0] - self.slack, sight[1] + self.slack)
        for s in range(lo // self.slice_span, hi // self.slice_span + 1):
            if not self.spend.containsKey((s,)):
                continue
            items = self._items(s)
            place = items["ts" if timed else "anchor"]
            items = items[(lo <= place) & (place <= hi)]
            far += _pico(items)
            at += _pico(items[items["ts"] <= sight[3]])
            unpriced += int(items["unpriced"].sum())
        return float(at) / 1e12, float(far) / 1e12, unpriced

    def _row(self, key: tuple, span: tuple, final: bool) -> Row:
        r, start, end = span
        costs = self._costs(key[1] == "timed", r, start, end)
        return Row(**dict(zip(LIVE.names, (*key, r[0], r[1], r[2], r[3], max(0.0, r[4]), *costs, final))))

    # batches and timers

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        key, timed = tuple(key), key[1] == "timed"
        sights: dict[int, list] = {}

        def sort_out() -> Iterator[Row]:
            for row in rows:
                if row.kind == "reading":
                    self._see(sights, np.frombuffer(bytes(row["items"]), _SEEN))
                else:
                    yield row
        for items in _unpacked(sort_out(), "items", _ITEM):
            self._add(key, items)
        seen = self._merge(self._seen(), sights)
        if sights:
            self.sights.update(([tuple(r) for r in seen],))
            for r in seen:
                if not r[6]:
                    self.handle.registerTimer((r[1] + self.hold) // MS + 1)
        open_ = [s for s in self._spans(timed, seen) if not s[0][6]]
        if open_:
            yield self._row(key, max(open_, key=lambda s: s[0][0]), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        key, timed, at = tuple(key), key[1] == "timed", expiredTimerInfo.getExpiryTimeInMs() * MS
        seen = self._seen()
        spans = self._spans(timed, seen)
        due = [s for s in spans if not s[0][6] and s[0][1] + self.hold < at]
        for span in due:
            yield self._row(key, span, True)
            span[0][6] = True
        if due:
            # a window that ended still bounds the one that follows it
            left = [r for r, following in zip(spans, [*spans[1:], None]) if not r[0][6] or (following is not None and not following[0][6])]
            if any(not s[0][6] for s in left):
                self.sights.update(([tuple(s[0]) for s in left],))
            else:
                self.sights.clear()
        if at % self.slice_span:
            return
        self._end_slices(timed, key, at, [s for s in spans if not s[0][6]])

    def _end_slices(self, timed: bool, key: tuple, at: int, open_: list[tuple]) -> None:
        s = at // self.slice_span - 1
        if self.spend.containsKey((s,)):
            items = self._items(s)
            newest = open_[-1][0][3] if open_ else -1
            inside = (s + 1) * self.slice_span <= newest and not any(
                abs(edge - at) <= self.jitter + self.slice_span for _, start, end in open_ for edge in (start, end))
            if timed and inside and len(items) > 1:
                total = _pico(items)
                one = np.array([(0, items["ts"].max(), total >> 32, total & _LOW, items["unpriced"].sum())], _ITEM)
                self.spend.updateValue((s,), (bytearray(one.tobytes()),))
        gone = (at - self._kept_for(key)) // self.slice_span - 1
        if self.spend.containsKey((gone,)):
            self.spend.removeKey((gone,))

    def close(self) -> None:
        pass


def spend_rows(usage: DataFrame, links: DataFrame | None = None, limits: list[tuple[str, str]] | None = None) -> DataFrame:
    """Spend as seen by limits: on-plan requests of timed tools for every (scope, window) that counts them, of linked tools by their links."""
    on_plan = usage.where("on_plan")
    known = limits or [(scope, window) for scope in ("all", "opus", "sonnet", "fable") for window in ("five_hour", "seven_day")]
    pairs = F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(w).alias("window")) for s, w in known])
    timed = on_plan.where(F.col("tool") == "timed").select("account_id", "tool", "ts", "model", "cost_pico", F.inline(pairs))
    timed = timed.where(in_scope("tool", "scope", "model")).select(*LIMIT, "ts", F.lit(None).cast("bigint").alias("resets_at"), "cost_pico")
    if links is None:
        return timed
    linked = links.where(F.col("resets_at").isNotNull()).withColumnRenamed("usage_id", "id").join(
        on_plan.where(F.col("tool") == "linked").select("id", "account_id", "tool", "ts", "model", "cost_pico"), ["account_id", "tool", "id"])
    return timed.unionByName(linked.where(in_scope("tool", "scope", "model")).select(*LIMIT, "ts", "resets_at", "cost_pico"))


def live_windows(snapshots: DataFrame, spend: DataFrame | None = None, jitter: int = 900 * SEC, slack: int = SEC, slice_span: int = HOUR,
                 hold: int = 900 * SEC, delay: str = ALIGN_DELAY) -> DataFrame:
    """The window in progress of every limit, with the spend in it, and its last state when it is over.

    ``spend`` has the columns of ``spend_rows``.  Each batch puts out a limit's newest window (``final`` false); some time
    (``hold``) after its reset, and after the delay, a window's last row comes (``final`` true) and its state ends.  Up to the delay rows
    may come in any order, and the last row equals the batch rebuild, but for two cases that ``jobs.maintain_windows`` mends: a window first
    seen after the end of the one before it that began before that end (the rebuild then cuts the earlier one), and requests linked to a
    window that ended before them.  Update mode.
    """
    seen = snapshots.where(F.col("resets_at").isNotNull() & F.col("window_seconds").isNotNull() & F.col("used_percent").isNotNull()).select(
        *LIMIT, "ts", "resets_at", F.col("used_percent").cast("double").alias("used_percent"), "window_seconds")
    rows = _packed(seen, LIMIT, _SEEN).withColumn("kind", F.lit("reading"))
    if spend is not None:
        pico = F.coalesce(F.col("cost_pico").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
        high = F.floor(pico / F.lit(1 << 32)).cast("bigint")
        paid = spend.select(*LIMIT, "ts", F.coalesce("resets_at", F.lit(0)).alias("anchor"), pico.alias("pico"), high.alias("high"),
                            F.col("cost_pico").isNull().cast("bigint").alias("unpriced"))
        paid = paid.withColumn("low", (F.col("pico") - F.col("high") * F.lit(1 << 32).cast("decimal(10,0)")).cast("bigint"))
        rows = rows.unionByName(_packed(paid, LIMIT, _ITEM).withColumn("kind", F.lit("spend")))
    return with_event_time(rows, delay).groupBy(*LIMIT).transformWithState(
        _Ledger(jitter, slack, slice_span, -(-hold // slice_span) * slice_span), LIVE, "Update", "EventTime")


# -- alignment of readings and requests --------------------------------------------------------------

def met_by_bucket(snapshots: DataFrame, usage: DataFrame, grace: int = 600 * SEC, delay: str = ALIGN_DELAY) -> DataFrame:
    """Readings of each (account, tool, bucket of ``grace``) and the requests that may be near them, as two lists, once no more can come.

    A row waits in a list until the watermarks of both streams say that no request near the bucket's readings can come any more.  State is
    read and written once a batch and bucket, an account with many rows spreads over time, and lists hold the rows of three times the grace.
    """
    keys = ["account_id", "tool"]
    bucket = F.expr(f"ts div {grace}")
    # ``due``: no request near the bucket's readings has an instant after it; the delay counts from a row's own instant
    due = lambda b: F.timestamp_micros((b + 2) * F.lit(grace)).alias("due")
    waits = lambda df, spans: df.withWatermark("due", f"{delay} {spans * grace} microseconds")
    reading = F.struct("scope", "window", "ts", "used_percent")
    request = F.struct(F.col("id").alias("usage_id"), F.col("ts").alias("usage_ts"), "cost_pico")
    s = waits(snapshots.where(F.col("ts").isNotNull()).select(*keys, reading.alias("reading"), due(bucket)), 2)
    u = waits(usage.where(F.col("ts").isNotNull() & F.col("account_id").isNotNull() & F.col("tool").isNotNull()).select(
        *keys, request.alias("request"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("b")).select(*keys, "request", due(F.col("b"))), 3)
    return s.unionByName(u, allowMissingColumns=True).groupBy(*keys, "due").agg(
        F.collect_list("reading").alias("readings"), F.collect_list("request").alias("requests"))


#: Pairs that a task makes of one row, and copies of requests that it hands on at once.
TILE, COPIES = 1 << 14, 1 << 18


def pairs_of_buckets(met: DataFrame, grace: int = 600 * SEC) -> DataFrame:
    """Readings of ``met_by_bucket`` with each request at most ``grace`` before or after them, or alone.

    Both lists are sorted by time, so the requests near a reading are a stretch of them, found once a reading; nothing is compared for each pair.
    Readings go on in tiles with their stretches of requests, so a task holds the pairs of one tile, never those of a bucket.
    """
    reading, request = (met.schema[c].dataType.elementType for c in ("readings", "requests"))
    stretch = T.StructType([*reading, T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())])
    schema = T.StructType([met.schema["account_id"], met.schema["tool"], T.StructField("readings", T.ArrayType(stretch)), T.StructField("requests", T.ArrayType(request))])
    tiles = met.select("account_id", "tool", "readings", "requests").mapInArrow(lambda batches: (t for b in batches for t in _tiles(b, grace)), schema)
    each = tiles.select("account_id", "tool", F.inline("readings"), "requests")
    return each.select(*LIMIT, "ts", "used_percent", F.inline_outer(F.slice("requests", F.col("first") + 1, F.col("n"))))


def _tiles(batch: pa.RecordBatch, grace: int) -> Iterator[pa.RecordBatch]:
    """Readings with the place (``first``, ``n``) of their requests among those of the tile; one with more than a tile's comes in several parts."""
    (r_row, readings), (q_row, requests) = (_elements(batch.column(c)) for c in ("readings", "requests"))
    if not len(readings):
        return
    r_ts, q_ts = readings.field("ts").to_numpy(), requests.field("usage_ts").to_numpy()
    # in the order of time: where stretches begin, requests, where stretches end
    kind = np.repeat(np.array([0, 1, 2], np.int8), [len(r_ts), len(q_ts), len(r_ts)])
    order = np.lexsort((kind, np.r_[r_ts - grace, q_ts, r_ts + grace], np.r_[r_row, q_row, r_row]))
    kind = kind[order]
    passed = np.cumsum(kind == 1)
    requests = requests.take(pa.array(order[kind == 1] - len(r_ts)))
    mine = order[kind == 0]  # readings by row and time
    first = passed[kind == 0]
    last = np.empty_like(first)
    last[order[kind == 2] - len(r_ts) - len(q_ts)] = passed[kind == 2]
    last = last[mine]
    # readings with more requests than a tile in several parts of about the same size
    parts = np.maximum(1, -(-(last - first) // TILE))
    of = np.repeat(np.arange(len(mine)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    parts, size = parts[of], (last - first)[of]
    lo, hi, row, mine = first[of] + size * k // parts, first[of] + size * (k + 1) // parts, r_row[mine][of], mine[of]
    filled = np.cumsum(hi - lo + 1) // TILE
    alone = parts > 1
    begin = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(filled) != 0) | alone[1:] | alone[:-1]])
    end = np.r_[begin[1:], len(of)]
    least, most = np.minimum.reduceat(lo, begin), np.maximum.reduceat(hi, begin)
    copies = np.cumsum(most - least + end - begin)
    cuts = np.r_[0, np.flatnonzero(np.diff(copies // COPIES)) + 1, len(begin)]
    for i, j in zip(cuts[:-1], cuts[1:]):
        own, width = slice(begin[i], end[j - 1]), most[i:j] - least[i:j]
        ends = np.r_[0, np.cumsum(width)]
        taken = np.arange(ends[-1]) + np.repeat(least[i:j] - ends[:-1], width)
        offset = np.repeat(least[i:j], end[i:j] - begin[i:j])
        found = readings.take(pa.array(mine[own]))
        place = [pa.array((lo[own] - offset).astype(np.int32)), pa.array((hi[own] - lo[own]).astype(np.int32))]
        names = [f.name for f in found.type]
        found = pa.StructArray.from_arrays([*found.flatten(), *place], [*names, "first", "n"])
        heads = batch.select(["account_id", "tool"]).take(pa.array(row[begin[i:j]]))
        lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), x) for at, x in (
            (np.r_[begin[i:j], end[j - 1]] - begin[i], found), (ends, requests.take(pa.array(taken))))]
        yield pa.RecordBatch.from_arrays([*heads.columns, *lists], ["account_id", "tool", "readings", "requests"])


def _elements(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The row of every element, and the elements."""
    at = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(at)), lists.values.slice(at[0], at[-1] - at[0])


def aligned(snapshots: DataFrame, usage: DataFrame, grace: int = 600 * SEC, delay: str = ALIGN_DELAY) -> DataFrame:
    """Readings with the requests of the same account and tool at most ``grace`` before or after them; a reading without any comes once, alone.

    All rows of a reading come when the watermarks say that no request near it can come any more: only then is a rise believed to be
    unexplained.  Pairs grow with the square of the rows of a stretch of time: give it rises (``visible_changes``) rather than all readings
    of a busy account, or put out ``met_by_bucket`` and make the pairs (``pairs_of_buckets``) where they are read.
    """
    return pairs_of_buckets(met_by_bucket(snapshots, usage, grace, delay), grace)
