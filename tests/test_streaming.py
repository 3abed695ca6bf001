import json
import random

import pytest
from pyspark.sql import functions as F

from tidemeter import model as M
from tidemeter.model import HOUR, SEC, Params
from tidemeter.operators import windows as W
from tidemeter.sources import catalog, logs, runs, sinks, tail
from tidemeter.sources.tail import JsonlTail
from tidemeter.streaming import jobs, state

FILES = "/root/testdata/sf0.001"


def stream_of(spark, tmp_path, name, batches, schema):
    """A file stream that gives each list of rows as one micro-batch."""
    folder = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), folder


def run(df, mode, name, tmp_path):
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_keyed(df, mode, tmp_path, name="keyed"):
    """Rows a query with keyed state puts out, and what is left in its state at the end."""
    out = str(tmp_path / f"out-{name}")
    q = state.start(df, mode, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/b={n}"), str(tmp_path / f"cp-{name}"), {"availableNow": True})
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out).drop("b"), sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"])


FAR = 3_000_000  # seconds, long after every other row


def snap(ts, pct, reset, account=1):
    return (account, "timed", "all", "five_hour", ts * SEC, float(pct), reset * SEC, 18000, "plus", "t")


def test_tail_reads_appended_complete_lines_once(spark, tmp_path):
    spark.dataSource.register(JsonlTail)
    logs, out, cp = tmp_path / "logs", tmp_path / "out", str(tmp_path / "cp")
    logs.mkdir()

    def pump():
        s = spark.readStream.format("jsonl_tail").option("path", str(logs)).option("sliceBytes", 7).load()
        q = s.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.value for r in tail.lines(spark.read.schema(s.schema).parquet(str(out))).collect())

    a = logs / "a.jsonl"
    a.write_text("one\ntwo two two two\nhal")
    assert pump() == ["one", "two two two two"]
    with a.open("a") as f:
        f.write("f\n")
    (logs / "sub").mkdir()
    (logs / "sub" / "b.jsonl").write_text("bee\n")
    assert pump() == ["bee", "half", "one", "two two two two"]
    assert pump() == ["bee", "half", "one", "two two two two"]
    a.write_text("x\n")                                   # shrank: read again from the start
    assert pump() == ["bee", "half", "one", "two two two two", "x"]


def test_tail_batch_slices_keep_every_line(spark, tmp_path):
    spark.dataSource.register(JsonlTail)
    want = [f"{i}-" + "z" * (i % 23) for i in range(400)]
    (tmp_path / "a.jsonl").write_text("\n".join(want) + "\n")
    got = spark.read.format("jsonl_tail").option("path", str(tmp_path)).option("sliceBytes", 64).load().orderBy("file", "seq").collect()
    assert [r.value for r in got] == want and len({r.block for r in got}) > 10


class Batches:
    """The tail reader driven as Spark drives it; ``again`` makes a new reader, as after a restart."""

    def __init__(self, folder, **options):
        self.options, self.offset = {"path": str(folder), **options}, {"files": "{}"}
        self.again()

    def again(self):
        self.reader = tail.TailReader(self.options)

    def next(self):
        end = self.reader.latestOffset()
        parts = self.reader.partitions(self.offset, end)
        self.offset = end
        rows = [r for p in parts for b in self.reader.read(p) for r in b.to_pylist()]
        return [r["value"] for r in rows if not r["event"]], sorted((r["file"].rsplit("/", 1)[1], r["event"], r["value"]) for r in rows if r["event"])


def test_tail_takes_so_many_bytes_a_batch(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    want = [f"{i:03d}" for i in range(40)] + ["long" * 30]
    (folder / "a.jsonl").write_text("\n".join(want) + "\n")
    (folder / "b.jsonl").write_text("bee\nhal")
    b = Batches(folder, maxBytesPerTrigger="20", frontier=str(tmp_path / "frontier"), sliceBytes="7")
    got = []
    for n in range(20):
        lines, told = b.next()
        assert sum(len(x) + 1 for x in lines) <= 20 + 125 and not told
        got += lines
        if n % 4 == 1:
            b.again()
    assert sorted(got) == sorted([*want, "bee"])
    with pytest.raises(ValueError):
        tail.TailReader({"path": str(folder), "maxBytesPerTrigger": "5"})


def test_tail_opens_changed_files_only_and_forgets_those_gone(tmp_path, monkeypatch):
    for name in "abc":
        (tmp_path / f"{name}.jsonl").write_text(f"{name}1\n")
    opened, inner = [], tail.last_line_end
    monkeypatch.setattr(tail, "last_line_end", lambda path, file, *a: opened.append(file[-7]) or inner(path, file, *a))
    b = Batches(tmp_path)
    assert sorted(b.next()[0]) == ["a1", "b1", "c1"] and sorted(opened) == ["a", "b", "c"]
    opened.clear()
    assert b.next() == ([], []) and not opened
    with (tmp_path / "b.jsonl").open("a") as f:
        f.write("b2\n")
    (tmp_path / "c.jsonl").unlink()
    assert b.next() == (["b2"], []) and opened == ["b"]
    assert sorted(json.loads(b.offset["files"])) == [str(tmp_path / f"{n}.jsonl") for n in "ab"]


def test_tail_tells_of_shrunk_and_unreadable_files(spark, tmp_path, monkeypatch):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text("one\ntwo\n")
    b.write_text("bee\n")
    broken, inner = {"b.jsonl"}, tail.last_line_end

    def end(path, file, *rest):
        if file.rsplit("/", 1)[1] in broken:
            raise PermissionError(13, "no")
        return inner(path, file, *rest)

    monkeypatch.setattr(tail, "last_line_end", end)
    run = Batches(tmp_path)
    assert run.next() == (["one", "two"], [("b.jsonl", "read_error", "PermissionError")])
    assert run.next() == ([], [])  # told once
    broken.clear()
    a.write_text("x\n")
    lines, told = run.next()
    assert sorted(lines) == ["bee", "x"] and told == [("a.jsonl", "truncated", None), ("b.jsonl", "readable", None)]
    schema = "file string, event string, detail string, since long, mtime long"
    rows = [("/p/a.jsonl", "truncated", None, 5, 9), ("/p/b.jsonl", "read_error", "PermissionError", 3, 4), ("/p/b.jsonl", "readable", None, 4, 8),
            ("/p/c.jsonl", "read_error", "OSError", None, 7)]
    gaps = logs.incident_gaps(spark.createDataFrame(rows, schema), F.lit(1), 20, "timed")
    assert sorted((g.kind, g.detail, g.start, g.end) for g in gaps.collect()) == [("read_error", "c.jsonl: OSError", 20, 20), ("truncated", "a.jsonl", 5, 9)]


def test_tail_shrinking_files_through_a_stream(spark, tmp_path):
    spark.dataSource.register(JsonlTail)
    folder, out, cp = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()

    def pump():
        s = (spark.readStream.format("jsonl_tail").option("path", str(folder)).option("maxBytesPerTrigger", 8)
             .option("frontier", str(tmp_path / "frontier")).load())
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(once=True).start().awaitTermination()
        rows = spark.read.schema(s.schema).parquet(out)
        return sorted(r.value for r in tail.lines(rows).collect()), [r.event for r in tail.incidents(rows).collect()]

    (folder / "a.jsonl").write_text("one\ntwo\nthree\n")
    assert pump() == (["one", "two"], [])
    assert pump() == (["one", "three", "two"], [])
    (folder / "a.jsonl").write_text("x\n")
    assert pump() == (["one", "three", "two", "x"], ["truncated"])


def test_hourly_rollup_equals_batch(spark, tmp_path):
    from tidemeter.plans import driver_tables as D
    u = D.priced(spark, FILES).withColumn("cost_pico", F.col("cost_pico").cast("bigint"))
    folder = str(tmp_path / "u")
    u.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(folder)
    s = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(jobs.rollup(s, delay="60 days"), "complete", "rollup_all", tmp_path)
    want = jobs.rollup(u, delay="60 days")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_rollup_appends_closed_windows_only(spark, tmp_path):
    row = lambda t: ("i", 1, "timed", t, "m", True, None, 1, 0, 0, 0, 1, 0, None, 5)
    s, _ = stream_of(spark, tmp_path, "u2", [[row(0), row(10 * SEC)], [row(3 * HOUR)], [row(6 * HOUR)]], M.USAGE)
    got = {r.bucket: r.requests for r in run(jobs.rollup(s), "append", "rollup_closed", tmp_path).collect()}
    assert got[0] == 2 and 6 * HOUR not in got


def test_live_windows_match_batch(spark, tmp_path):
    batches = [[snap(100, 5, 18000), snap(200, 9, 18001)], [snap(300, 7, 17999), snap(400, 12, 18000)], [snap(20000, 3, 36100), snap(20100, 4, 36100)]]
    s, folder = stream_of(spark, tmp_path, "s", batches, M.SNAPSHOT)
    rows = run_keyed(state.live_windows(s), "update", tmp_path)[0].collect()
    live = {}
    for r in rows:                                    # the last update of each cycle
        live[r.reset_max] = r if r.reset_max not in live or r.last_seen > live[r.reset_max].last_seen else live[r.reset_max]
    p = Params(now=10**15)
    d = W.cycle_digest(spark.read.parquet(folder), p)
    batch = {c.reset_max: c for c in W.cycles(d, p).collect()}
    for end in (18001 * SEC, 36100 * SEC):
        a, b = live[end], batch[end]
        assert (a.reset_min, a.first_seen, a.last_seen, a.used_percent) == (b.reset_min, b.first_seen, b.last_seen, b.peak_percent)


def paid(ts, cost, account=1, tool="timed", model="claude-x", name=None):
    return (name or f"u{ts}", account, tool, ts * SEC, model, True, None, 1, 0, 0, 0, 1, 0, None, cost)


@pytest.mark.parametrize("seed", range(3))
def test_ended_windows_with_spend_equal_the_rebuild(spark, tmp_path, seed):
    """Two tools, resets that wobble and shift, rows shuffled within the delay, requests without a window and without a price."""
    r = random.Random(seed)
    resets = [18000, 36000, 43000, 61000, 90000]  # the third begins inside the second
    snaps, use, links = [], [], []
    for account, tool, scope in ((1, "timed", "all"), (2, "linked", "codex")):
        for reset in resets:
            for _ in range(r.randint(1, 9)):
                at = r.randint(max(reset - 17000, 0), reset - 100)
                snaps.append((account, tool, scope, "five_hour", at * SEC, float(r.randint(0, 60)), (reset + r.randint(-2, 2)) * SEC, 18000, "plus", "t"))
        for k in range(60):
            at, name = r.randint(0, 95000), f"{tool}{k}"
            use.append(paid(at, None if k % 11 == 0 else r.randint(1, 10**9), account, tool, "claude-x" if tool == "timed" else "gpt-x", name))
            ahead = [x for x in resets if x > at]
            if tool == "linked" and ahead:
                links.append((name, account, tool, scope, "five_hour", r.choice(ahead) * SEC))
    usage, linked = spark.createDataFrame(use, M.USAGE), spark.createDataFrame(links, M.LINK)
    spend = state.spend_rows(usage, linked, [("all", "five_hour")]).persist()
    late = lambda rows, at: sorted(rows, key=lambda x: x[at] + r.randint(0, 500) * SEC)
    cut3 = lambda rows: [rows[:len(rows) // 3], rows[len(rows) // 3:2 * len(rows) // 3], rows[2 * len(rows) // 3:]]
    a, _ = stream_of(spark, tmp_path, "a", [*cut3(late(snaps, 4)), [snap(FAR, 0, FAR, 9)]], M.SNAPSHOT)
    rows = [tuple(x) for x in spend.collect()]
    b, _ = stream_of(spark, tmp_path, "b", [*cut3(late(rows, 4)), [(9, "timed", "all", "five_hour", FAR * SEC, None, 1)]], spend.schema)
    got, left = run_keyed(state.live_windows(a, b, delay="20 minutes", slice_span=r.choice([600, 3600]) * SEC), "update", tmp_path)
    cols = ["account_id", "reset_min", "reset_max", "first_seen", "last_seen", "used_percent", "cost_at_snapshot", "cost_so_far", "unpriced_requests"]
    want = W.build_windows(spark.createDataFrame(snaps, M.SNAPSHOT), usage, linked, Params(now=10**15))[0].select(*cols)
    key = lambda rows: sorted((*x[:6], round(x[6], 12), round(x[7], 12), x[8]) for x in rows)
    final = key(got.where("final and account_id < 9").select(*cols).collect())
    assert final == key(want.collect()) and len(final) == 2 * len(resets)
    assert left <= 2  # the closing rows' own


@pytest.mark.parametrize("chunk", [2, 10_000])
def test_visible_changes_in_any_order(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(state, "CHUNK", chunk)
    r = random.Random(4)
    rows = [snap(1 + k * 7 + (k % 3), r.choice([5, 5, 6]), r.choice([600, 601, 720]), account=k % 2) for k in range(200)]
    mixed = sorted(rows, key=lambda x: x[4] + r.randint(0, 300) * SEC)
    s, _ = stream_of(spark, tmp_path, "c", [mixed[:70], mixed[70:140], mixed[140:], [snap(FAR, 0, FAR, 9)]], M.SNAPSHOT)
    got = run_keyed(state.visible_changes(s), "append", tmp_path)[0].where("account_id < 9").collect()
    want, last = [], {}
    for x in sorted(rows, key=lambda x: (x[4], x[5], round(x[6] / SEC / 60))):
        now = (x[5], round(x[6] / SEC / 60) * 60)
        if last.get(x[0]) != now:
            want.append((x[0], x[4], *now))
        last[x[0]] = now
    assert sorted((g.account_id, g.ts, g.used_percent, g.reset) for g in got) == sorted(want)


def test_alert_cooldown(spark, tmp_path):
    row = lambda t, d="tighter", account=1: (account, "linked", "w", d, t, 0.6, "x", 4)
    batches = [[row(1000 * SEC), row(5, "looser")], [row(1)], [row(25 * HOUR), row(24 * HOUR)], [row(FAR * SEC, account=9)]]
    s, _ = stream_of(spark, tmp_path, "al", batches, M.ALERT)
    got, left = run_keyed(state.cooled_alerts(s, delay="2 hours"), "append", tmp_path)
    assert sorted((r.direction, r.ts) for r in got.where("account_id < 9").collect()) == [("looser", 5), ("tighter", 1), ("tighter", 25 * HOUR)]
    assert left == 2  # the closing row and its timer wait; the state of a direction ended with its cool-down


def test_alignment_equals_a_range_join(spark, tmp_path):
    r = random.Random(6)
    snaps = [snap(r.randint(1, 20_000), k, 18000, account=k % 2) for k in range(60)] + [snap(90_000, 3, 99_000)]
    use = [paid(r.randint(1, 20_000), 5, account=k % 2, name=f"r{k}") for k in range(50)]
    near = lambda rows, at: sorted(rows, key=lambda x: x[at] + r.randint(0, 400) * SEC)
    a, b = near(snaps, 4), near(use, 3)
    s, _ = stream_of(spark, tmp_path, "s", [a[:20], a[20:], [snap(FAR, 0, FAR, 9)]], M.SNAPSHOT)
    u, _ = stream_of(spark, tmp_path, "u", [b[:30], b[30:], [paid(FAR, 1, account=9)]], M.USAGE)
    got, _ = run_keyed(state.aligned(s, u), "append", tmp_path)
    want = []
    for x in snaps:
        mine = [y for y in use if y[1] == x[0] and abs(y[3] - x[4]) <= 600 * SEC]
        want += [(x[0], x[4], y[0]) for y in mine] or [(x[0], x[4], "")]
    rows = got.where("account_id < 9").collect()
    assert sorted((g.account_id, g.ts, g.usage_id or "") for g in rows) == sorted(want) and any(g.usage_id is None for g in rows)


def test_rows_of_a_turn_come_in_a_batch_with_a_file_for_every_core(spark, tmp_path):
    from tidemeter.plans.driver_queries import _arriving
    stream, seen = _arriving(spark.range(3000), F.col("id") % 3, 3, files=2), {}

    def look(batch, n):
        seen[n] = batch.select((F.col("id") % 3).alias("turn"), F.input_file_name().alias("file"), "id").collect()
    stream.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {n: {r.turn for r in rows} for n, rows in seen.items()} == {0: {0}, 1: {1}, 2: {2}}
    assert all(len({r.file for r in rows}) == spark.sparkContext.defaultParallelism for rows in seen.values())
    assert sorted(r.id for rows in seen.values() for r in rows) == list(range(3000))


def test_a_large_part_of_a_table_is_written_by_several_tasks(spark, tmp_path):
    """One day of a large batch is not one task's work."""
    table = runs.RunTable(spark, str(tmp_path / "big"), runs.oldest(["id"]))
    name, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(name, "64k")
    try:
        table.write(spark.range(0, 200_000, 1, 4).select("id", F.sha1(F.col("id").cast("string")).alias("v")), 0)
    finally:
        spark.conf.set(name, before)
    assert len([n for n in runs.names(spark, str(tmp_path / "big" / "w-0-0" / "part=0")) if n.startswith("part-")]) > 1
    assert table.read().count() == 200_000


def test_rows_to_align_wait_by_bucket(spark, tmp_path):
    """State holds one entry an account, tool and bucket, not one for each row and bucket; rows without an account meet nothing."""
    snaps = [snap(k, k, 7200, acc) for k in range(40) for acc in (1, None)]
    use = [paid(k + 7, k, account=acc) for k in range(40) for acc in (1, None)]
    s, _ = stream_of(spark, tmp_path, "bs", [snaps], M.SNAPSHOT)
    u, _ = stream_of(spark, tmp_path, "bu", [use], M.USAGE)
    got, left = run_keyed(state.met_by_bucket(s, u), "append", tmp_path)
    assert got.count() == 0 and left <= 4
    s, _ = stream_of(spark, tmp_path, "bs2", [snaps, [snap(FAR, 0, FAR, 9)]], M.SNAPSHOT)
    u, _ = stream_of(spark, tmp_path, "bu2", [use, [paid(FAR, 1, account=9)]], M.USAGE)
    got, _ = run_keyed(state.met_by_bucket(s, u), "append", tmp_path, "keyed2")
    pairs = state.pairs_of_buckets(got).where("account_id is null or account_id < 9").collect()
    assert len(pairs) == 40 * 40 + 40 and all((p.account_id is None) == (p.usage_id is None) for p in pairs)


def met_rows(spark, rows):
    """Rows as ``state.met_by_bucket`` gives them: (account, tool, readings, requests)."""
    return spark.createDataFrame(rows, """account_id bigint, tool string, readings array<struct<scope:string,window:string,ts:bigint,used_percent:double>>,
        requests array<struct<usage_id:string,usage_ts:bigint,cost_pico:bigint>>""")


def pairs_of(rows, grace=600 * SEC):
    out = []
    for account, tool, readings, requests in rows:
        for x in readings:
            near = [q for q in requests if abs(q[1] - x[2]) <= grace]
            out += [(account, tool, *x, *q) for q in near] or [(account, tool, *x, None, None, None)]
    return sorted(out, key=repr)


def test_pairs_come_in_tiles_whatever_the_size_of_a_bucket(spark, monkeypatch):
    """A task makes so many pairs of one row at most: of busy buckets, of a reading with very many requests, and at the very ends of the grace."""
    r = random.Random(8)
    reading = lambda t: ("all", "five_hour", t, r.choice([1.0, 2.0, None]))
    request = lambda t: (f"e{r.randint(0, 99)}", t, r.choice([5, None]))
    around = lambda t: r.randint(t - 1500, t + 1500) * SEC
    rows = [(1, "timed", [reading(around(0)) for _ in range(40)], [request(around(0)) for _ in range(300)]),
            (1, "linked", [reading(0), reading(1), reading(0)], [request(k * SEC) for k in (-601, -600, 600, 601)] + [request(600 * SEC + 1)]),
            (2, "timed", [reading(7), reading(9)], []), (2, "linked", [], [request(7)]), (None, None, [reading(5)], []),
            (3, "timed", [reading(0)], [request(0) for _ in range(250)]), *[(k, "timed", [reading(k)], [request(k)]) for k in range(4, 90)]]
    want = pairs_of(rows)
    assert sorted(map(tuple, state.pairs_of_buckets(met_rows(spark, rows)).collect()), key=repr) == want
    monkeypatch.setattr(state, "TILE", 64)
    monkeypatch.setattr(state, "COPIES", 100)
    batch = met_rows(spark, rows).coalesce(1).toArrow().combine_chunks().to_batches()[0]
    tiles = [t for part in state._tiles(batch, 600 * SEC) for t in part.to_pylist()]
    assert max(sum(max(1, x["n"]) for x in t["readings"]) for t in tiles) <= 2 * 64 and max(len(t["requests"]) for t in tiles) <= 301
    got = []
    for t in tiles:
        for x in t["readings"]:
            near = t["requests"][x["first"]:x["first"] + x["n"]]
            got += [(t["account_id"], t["tool"], x["scope"], x["window"], x["ts"], x["used_percent"], *q.values()) for q in near or [dict(a=None, b=None, c=None)]]
    assert sorted(got, key=repr) == want


def test_requests_are_not_copied_for_every_reading(spark):
    """Pairs are made in generated code of stretches that are found before; no list is filtered for each reading."""
    plan = state.pairs_of_buckets(met_rows(spark, [(1, "timed", [("all", "five_hour", 5, 1.0)], [("e1", 5, 5)])]))._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline(slice(" in plan and "lambdafunction" not in plan


def test_rows_are_packed_before_they_meet_their_key(spark):
    """One row per key and hour of a task reaches the keyed state, with every row in it; rows without an instant stay out."""
    r = random.Random(5)
    rows = [(r.choice([1, 2, None]), r.choice(["a", None]), r.choice([None, r.randint(-HOUR, 2 * HOUR - 1)]), k / 4) for k in range(500)]
    df = spark.createDataFrame(rows, "account_id bigint, tool string, ts bigint, ratio double").coalesce(1)
    got = state._packed(df, ["account_id", "tool"], state._Cooled.item).collect()
    assert len(got) == 2 * 3 * 3
    unpack = lambda g: state.np.frombuffer(bytes(g["items"]), state._Cooled.item).tolist()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((g.account_id, g.tool, *i) for g in got for i in unpack(g)), key=key) == sorted((x for x in rows if x[2] is not None), key=key)
    assert all(g.ts == max(i[0] for i in unpack(g)) for g in got)


def test_an_hour_of_waiting_rows_is_one_entry(spark, tmp_path):
    """State of rows that wait: one entry and one timer an hour, not one of each a slice; late ones are folded in order all the same."""
    rows = [snap(60 * k + 1, k % 7, 7200) for k in range(60)]
    s, _ = stream_of(spark, tmp_path, "w", [rows[::2], rows[1::2]], M.SNAPSHOT)
    got, left = run_keyed(state.visible_changes(s, "2 hours"), "append", tmp_path)
    assert got.count() == 0 and left <= 4  # the block, its first timer, and the timer's index
    s, _ = stream_of(spark, tmp_path, "w2", [rows[::2], rows[1::2], [snap(FAR, 0, FAR, 9)]], M.SNAPSHOT)
    got, _ = run_keyed(state.visible_changes(s, "2 hours"), "append", tmp_path, "keyed2")
    assert [(g.ts, g.used_percent) for g in got.where("account_id < 9").orderBy("ts").collect()] == [(x[4], x[5]) for x in rows]


def test_the_session_keeps_its_state_store(spark, tmp_path):
    s, _ = stream_of(spark, tmp_path, "c", [[snap(1, 5, 600)]], M.SNAPSHOT)
    before = spark.conf.get(state.STORE, None)
    run_keyed(state.visible_changes(s), "append", tmp_path)
    assert spark.conf.get(state.STORE, None) == before


def test_repeats_within_watermark(spark, tmp_path):
    row = lambda i, t: (i, 1, "timed", t, "m", True, None, 1, 0, 0, 0, 1, 0, None, 5)
    s, _ = stream_of(spark, tmp_path, "d", [[row("a", 0)], [row("a", 5), row("b", 6)]], M.USAGE)
    assert run(jobs.drop_repeats(s, ["id"], "1 hour"), "append", "dd", tmp_path).count() == 2


def test_ingest_is_idempotent(spark, tmp_path):
    rows = [[("x", 1)], [("x", 2), ("y", 3)]]
    s, folder = stream_of(spark, tmp_path, "raw", rows, "id string, v long")
    for i in range(2):                                # the second run reads everything again
        jobs.ingest(s, lambda b: b, ["id"], str(tmp_path / "t"), str(tmp_path / f"cp{i}"), {"availableNow": True}).awaitTermination()
    assert sorted(tuple(r) for r in jobs.ingested(spark, str(tmp_path / "t"), ["id"]).collect()) == [("x", 1), ("y", 3)]


@pytest.mark.parametrize("fan_in", [2, 16])
def test_late_rows_give_the_same_windows(spark, tmp_path, monkeypatch, fan_in):
    """Readings and requests in any batches, of several accounts; some join two windows, lower a reset or come before all others."""
    monkeypatch.setattr(jobs, "FULL_STATE_EVERY", fan_in)
    p, r = Params(now=10**15), random.Random(fan_in)
    snaps = [snap(r.randint(0, 60_000), r.randint(0, 50), reset + r.choice([-300, 0, 0, 400, 850]), a) for a in (1, 2, 3) for reset in (18000, 36000, 43000, 61000) for _ in range(6)]
    use = [paid(r.randint(0, 70_000), r.choice([None, 10**8, 3 * 10**8]), a, name=f"{a}-{k}") for a in (1, 2, 3) for k in range(25)]
    use += [paid(r.randint(0, 70_000), 10**8, 4, "linked", "gpt-x", f"l{k}") for k in range(20)]
    snaps += [(4, "linked", "codex", "five_hour", r.randint(0, 60_000) * SEC, float(k), (18000 + 18000 * (k % 3)) * SEC, 18000, "pro", "t") for k in range(12)]
    links = [(f"l{k}", 4, "linked", "codex", "five_hour", (18000 + 18000 * (k % 3)) * SEC) for k in range(18)]
    snapshots, usage, linked = (spark.createDataFrame(x, t) for x, t in ((snaps, M.SNAPSHOT), (use, M.USAGE), (links, M.LINK)))
    requests = [tuple(x) for x in jobs.linked_requests(usage, linked).collect()]
    schema = jobs.linked_requests(usage, linked).schema
    r.shuffle(snaps)
    r.shuffle(requests)
    a, _ = stream_of(spark, tmp_path, "s", [snaps[:50], snaps[50:80], snaps[80:]], M.SNAPSHOT)
    b, _ = stream_of(spark, tmp_path, "r", [requests[:30], requests[30:60], requests[60:]], schema)
    home = str(tmp_path / "w")
    jobs.maintain_windows(a, b, home, p, str(tmp_path / "cpw"), {"availableNow": True}).awaitTermination()
    store = jobs.WindowStore(spark, home, p)
    want = W.build_windows(snapshots, usage, linked, p)[0]
    rows = lambda df: sorted(map(str, df.select(sorted(want.columns)).withColumn("cost_so_far", F.round("cost_so_far", 12)).withColumn(
        "cost_at_snapshot", F.round("cost_at_snapshot", 12)).collect()))
    assert rows(store.windows()) == rows(want)
    # a batch that is run again changes nothing
    store.refresh(spark.createDataFrame(snaps[80:], M.SNAPSHOT), spark.createDataFrame(requests[60:], schema), 2)
    assert rows(store.windows()) == rows(want)


def test_a_refresh_reads_the_days_it_needs(spark, tmp_path):
    day = 86_400
    p, home = Params(now=10**15), str(tmp_path / "w")
    empty_l = spark.createDataFrame([], M.LINK)
    store = jobs.WindowStore(spark, home, p)
    snaps = lambda d, pct: spark.createDataFrame([snap(d * day + 4000 + pct, pct, d * day + 18000)], M.SNAPSHOT)
    use = lambda d, cost: jobs.linked_requests(spark.createDataFrame([paid(d * day + 3000, cost, name=f"{d}-{cost}")], M.USAGE), empty_l)
    for n in range(4):
        store.refresh(snaps(10 * n, 5), use(10 * n, 10**12), n)
    asked, inner = [], store._days
    store._days = lambda affected: asked.append(inner(affected)) or asked[-1]
    store.refresh(snaps(30, 9), use(10, 2 * 10**12), 4)  # a rise in the last window, a late request in the second
    assert asked == [[10, 30]]
    got = {r.reset_min // SEC // day: (r.used_percent, r.cost_at_snapshot) for r in store.windows().collect()}
    assert got == {0: (5.0, 1.0), 10: (5.0, 3.0), 20: (5.0, 1.0), 30: (9.0, 1.0)}


def test_a_hundred_batches_of_upserts(spark, tmp_path):
    keys, path = ["id"], str(tmp_path / "t")
    table = runs.RunTable(spark, path, runs.grown(keys, "output", ["cost"], ["model"]), runs.bucket(keys, 2), fan_in=4)
    r, best = random.Random(1), {}
    for n in range(100):
        rows = [(f"k{r.randint(0, 30)}", f"m{n}-{k}", r.randint(0, 1000), 10 * n + k) for k in range(r.randint(0, 3))]
        table.write(spark.createDataFrame(rows, "id string, model string, output long, cost long").coalesce(1), n)
        for i, model, output, cost in sorted(rows, key=lambda x: x[1]):
            if i not in best:
                best[i] = (model, output, cost)
            elif output > best[i][1]:
                best[i] = (best[i][0], output, cost)
        if n in (99, 47):
            assert {x.id: (x.model, x.output, x.cost) for x in table.read().collect()} == best
            again = sorted(map(tuple, table.read().collect()))
            table.write(spark.createDataFrame([("k1", "other", 10**6, 0)], "id string, model string, output long, cost long"), n if n == 47 else 63)
            assert sorted(map(tuple, table.read().collect())) == again  # merged batches are not taken in again
    assert [(a, b) for _, a, b in table.runs()] == [(0, 63), (64, 79), (80, 95), (96, 99)]
    assert len(runs.names(spark, path)) <= 8 and table.read(until=64).count() <= len(best)


def test_runs_of_the_other_kinds(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), "id string, v long")
    new = runs.RunTable(spark, str(tmp_path / "n"), runs.newest(["id"]), fan_in=2)
    old = runs.RunTable(spark, str(tmp_path / "o"), runs.oldest(["id"]), fan_in=2)
    low = runs.RunTable(spark, str(tmp_path / "c"), runs.combined(["id"], v=F.sum), fan_in=2)
    every = runs.RunTable(spark, str(tmp_path / "e"), fan_in=2)
    assert new.read() is None
    for t in (new, old, low, every):
        for n, rows in enumerate([[("a", 1), ("b", 5)], [("a", 3)], [], [("b", 2), ("a", 2)]]):
            t.write(df(*rows), n)
        assert [(a, b) for _, a, b in t.runs()] == [(0, 3)]
    found = lambda t: sorted((r.id, r.v) for r in t.read().collect())
    assert found(new) == [("a", 2), ("b", 2)] and found(old) == [("a", 1), ("b", 5)] and found(low) == [("a", 6), ("b", 7)]
    assert found(every) == [("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 5)]


def test_replace_partitions_keeps_others(spark, tmp_path):
    path = str(tmp_path / "p")
    df = lambda rows: spark.createDataFrame(rows, "v long, account_id long")
    sinks.replace_partitions(df([(1, 1), (2, 2)]), path, ["account_id"])
    sinks.replace_partitions(df([(9, 2)]), path, ["account_id"])
    assert sorted((r.v, r.account_id) for r in spark.read.parquet(path).collect()) == [(1, 1), (9, 2)]


LINE = "account_id bigint, file string, block bigint, seq bigint, mtime bigint, value string"


def growing(spark, tmp_path, name, files, cuts):
    """All lines as one table, and as a stream in which the files break off at ``cuts``."""
    rows = [(1, f, k // 4, k, 5, json.dumps(x)) for f, lines in files.items() for k, x in enumerate(lines)]
    parts = [[r for r in rows if lo <= r[3] < hi] for lo, hi in zip([0, *cuts], [*cuts, 10**6])]
    return spark.createDataFrame(rows, LINE), stream_of(spark, tmp_path, name, [p for p in parts if p], LINE)[0]


def price_table(spark):
    body = json.dumps({"models": {"gpt-wren": {"input": 2.5, "output": 9}, "claude-finch": {"input": 4, "output": 19}}})
    return catalog.price_entries(spark.createDataFrame([(body,)], "value string"), "seed")[0]


def session_file(session, steps):
    sums, lines = [0, 0, 0], [{"type": "session_meta", "payload": {"id": session}}, {"type": "turn_context", "payload": {"model": "gpt-wren"}}]
    for k, step in enumerate(steps):
        sums = [a + b for a, b in zip(sums, step)]
        names = ("input_tokens", "cached_input_tokens", "output_tokens")
        limits = {"limit_id": "codex", "plan_type": "pro", "primary": {"used_percent": 3.5 * k, "window_minutes": 300, "resets_at": 1_900_000_000 + 9_000}} if k % 3 == 0 else None
        lines.append({"timestamp": f"2030-03-17T17:{k:02d}:00Z", "type": "event_msg", "payload": {
            "type": "token_count", "info": {"total_token_usage": dict(zip(names, sums))}, **({"rate_limits": limits} if limits else {})}})
    return lines


@pytest.mark.parametrize("cuts", [[3], [1, 2, 4, 7], [5, 6]])
def test_session_files_may_grow_anywhere(spark, tmp_path, monkeypatch, cuts):
    monkeypatch.setattr(jobs, "FULL_STATE_EVERY", 2)
    files = {"a.jsonl": session_file("s-a", [(120, 20, 11), (75, 0, 8), (300, 240, 40), (18, 0, 2), (44, 4, 6)]), "b.jsonl": session_file("s-b", [(9, 0, 1), (35, 5, 7)])}
    lines, stream = growing(spark, tmp_path, "grow", files, cuts)
    prices, home = price_table(spark), str(tmp_path / "sessions")
    want = logs.tables_from_layout_b(lines, prices)
    jobs.ingest_sessions(stream, home, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    got = jobs.session_tables(spark, home, prices)
    for name, table in want.items():
        columns = sorted(table.columns)
        assert sorted(map(str, got[name].select(columns).collect())) == sorted(map(str, table.select(columns).collect())), name
    assert {r.session_id for r in got["usage"].collect()} == {"s-a", "s-b"} and got["usage"].count() == 7


@pytest.mark.parametrize("cuts", [[1], [2, 3], [1, 2, 3, 4]])
def test_messages_may_grow_anywhere(spark, tmp_path, cuts):
    def copy(name, output, done):
        return {"type": "assistant", "timestamp": f"2030-03-17T17:{output % 60:02d}:00Z", "sessionId": "n", "message": {
            "id": name, "model": "claude-finch", "stop_reason": done, "usage": {"input_tokens": 5, "output_tokens": output}}}

    files = {"a.jsonl": [copy("x", 1, None), copy("x", 480, "end"), copy("y", 2, None), copy("x", 700, None), copy("y", 66, "end")], "b.jsonl": [copy("y", 90, None), copy("z", 4, None)]}
    lines, stream = growing(spark, tmp_path, "grow", files, cuts)
    prices, home = price_table(spark), str(tmp_path / "messages")
    jobs.ingest_messages(stream, home, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    got = {r.id: r for r in jobs.message_usage(spark, home, prices).collect()}
    assert got == {r.id: r for r in logs.usage_from_layout_a(lines, prices).collect()}
    assert {i: r.output_tokens for i, r in got.items()} == {"claude:x": 480, "claude:y": 90, "claude:z": 4}
