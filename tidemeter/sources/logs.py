"""Request logs: JSON lines in two layouts, to usage, snapshot and link rows.

A line row is (account_id, file, block, seq, mtime, value): (block, seq) orders the lines of a file and
``block`` is the file split they came from, so the ordered fold over a huge file still spreads over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemeter.functions.scalars import epoch_us, is_on_plan, parse_iso, window_name
from tidemeter.model import DAY, GAP, SEC, USAGE
from tidemeter.operators.dedup import ARRIVAL, best_per_message, first_wins, merge_messages
from tidemeter.operators.pricing import price_usage
from tidemeter.operators.rules import drop_deleted
from tidemeter.operators.temporal import blocked_scan
from tidemeter.session import cut

RETENTION = 30 * DAY
_D, _S = T.DoubleType(), T.StringType()


def _obj(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Counters are read as DOUBLE: text is then no number, and a fraction is cut rather than refused.
LAYOUT_A = _obj(
    type=_S, timestamp=_S, sessionId=_S,
    message=_obj(id=_S, model=_S, stop_reason=_S, usage=_obj(
        input_tokens=_D, output_tokens=_D, cache_read_input_tokens=_D, cache_creation_input_tokens=_D, speed=_S,
        cache_creation=_obj(ephemeral_5m_input_tokens=_D, ephemeral_1h_input_tokens=_D),
        output_tokens_details=_obj(thinking_tokens=_D))),
    _corrupt_record=_S)

# Cumulative counters of layout B.
COUNTERS = ["input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens",
            "reasoning_output_tokens", "total_tokens"]
_COUNTS = _obj(**{c: _D for c in COUNTERS})
_LIMIT = _obj(used_percent=_D, window_minutes=_D, resets_at=_D)
LAYOUT_B = _obj(
    timestamp=_S, type=_S,
    payload=_obj(id=_S, model=_S, type=_S,
                 info=_obj(model=_S, total_token_usage=_COUNTS, last_token_usage=_COUNTS),
                 rate_limits=_obj(limit_id=_S, plan_type=_S, primary=_LIMIT, secondary=_LIMIT)))


def read_lines(spark: SparkSession, paths: list[str], account: Column, glob: str = "*.jsonl",
               modified_after: str | None = None) -> DataFrame:
    """Lines of every matching file below ``paths``; ``modified_after`` skips files older than the import horizon.

    Splits of a file never decrease ``block``, and the row id rises within one, so both order its lines.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = reader.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start",
                                      "_metadata.file_modification_time")
    return lines.where(F.col("value") != "").select(
        account.cast("bigint").alias("account_id"), F.col("file_path").alias("file"), F.col("file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.unix_micros("file_modification_time").alias("mtime"), "value")


# -- layout A: one finished message per line ------------------------------------------------------

def _parsed_a(lines: DataFrame) -> DataFrame:
    # The substring test spares most lines the JSON parser.
    seen = lines.where(F.col("value").contains('"assistant"') & F.col("value").contains('"usage"'))
    return seen.withColumn("d", F.from_json("value", LAYOUT_A, {"columnNameOfCorruptRecord": "_corrupt_record"}))


def _broken() -> Column:
    return F.when(F.col("d._corrupt_record").isNotNull(), F.try_parse_json("value").isNull()).otherwise(F.lit(False))


def parse_layout_a(lines: DataFrame, tool: str = "timed", prefix: str = "claude:") -> DataFrame:
    """Messages with usage; several lines of one message are still separate rows (``final`` tells partial ones)."""
    n = lambda path: F.coalesce(F.col(path).cast("bigint"), F.lit(0))
    u = "d.message.usage"
    five, hour = n(f"{u}.cache_creation.ephemeral_5m_input_tokens"), n(f"{u}.cache_creation.ephemeral_1h_input_tokens")
    is_split = (five != 0) | (hour != 0)
    model = F.coalesce(F.when(F.col("d.message.model") != "", F.col("d.message.model")), F.lit("unknown"))
    rows = _parsed_a(lines).where(
        (F.col("d.type") == "assistant") & (F.col("d.message.id") != "") & F.col(u).isNotNull() & (model != "<synthetic>"))
    return rows.select(
        F.concat(F.lit(prefix), "d.message.id").alias("id"), "account_id", F.lit(tool).alias("tool"),
        parse_iso("d.timestamp").alias("ts"), model.alias("model"), is_on_plan(F.lit(tool), model).alias("on_plan"),
        F.col("d.sessionId").alias("session_id"), n(f"{u}.input_tokens").alias("input_tokens"),
        n(f"{u}.cache_read_input_tokens").alias("cache_read_tokens"),
        F.when(is_split, five).otherwise(n(f"{u}.cache_creation_input_tokens")).alias("cache_write_5m_tokens"),
        F.when(is_split, hour).otherwise(F.lit(0)).cast("bigint").alias("cache_write_1h_tokens"),
        n(f"{u}.output_tokens").alias("output_tokens"), n(f"{u}.output_tokens_details.thinking_tokens").alias("reasoning_tokens"),
        F.col(f"{u}.speed").alias("speed"), F.col("d.message.stop_reason").isNotNull().alias("final"),
        "file", "block", "seq").where(F.col("ts").isNotNull())


def parse_gaps(lines: DataFrame, tool: str = "timed") -> DataFrame:
    """One gap per file with lines that look like usage but do not parse, from the latest request before
    the first of them up to the file's modification."""
    bad = _parsed_a(lines).where(_broken()).groupBy("account_id", "file").agg(
        F.min(F.struct("block", "seq")).alias("first_bad"), F.count("*").alias("bad"), F.max("mtime").alias("mtime"))
    before = (parse_layout_a(lines, tool).select("account_id", "file", "block", "seq", "ts").join(bad, ["account_id", "file"])
              .where(F.struct("block", "seq") < F.col("first_bad")).groupBy("account_id", "file").agg(F.max("ts").alias("seen")))
    name = F.element_at(F.split("file", "/"), -1)
    return bad.join(before, ["account_id", "file"], "left").select(
        "account_id", F.lit(tool).alias("tool"), F.least(F.coalesce("seen", "mtime"), F.col("mtime")).alias("start"),
        F.col("mtime").alias("end"), F.lit("parse_error").alias("kind"),
        F.concat(name, F.lit(": "), F.col("bad").cast("string")).alias("detail"))


def _not_empty() -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) != 0 for c in (
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens")])


def usage_of_messages(messages: DataFrame, prices: DataFrame) -> DataFrame:
    """Deduplicated, priced requests from all copies of layout-A messages."""
    per_file = best_per_message(messages).where(_not_empty())
    return merge_messages(price_usage(per_file, prices)).select(*USAGE.fieldNames())


def usage_from_layout_a(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Deduplicated, priced requests of layout A."""
    return usage_of_messages(parse_layout_a(lines), prices)


# -- layout B: a session file with cumulative counters --------------------------------------------

def session_rows(lines: DataFrame, default_scope: str = "codex") -> DataFrame:
    """The lines of session files that matter, parsed: what each says about model, plan, session, limits and counters."""
    # Only three kinds of lines matter; the substring test spares the others the JSON parser.
    seen = lines.where(F.col("value").contains('"token_count"') | F.col("value").contains('"turn_context"')
                       | F.col("value").contains('"session_meta"'))
    d = seen.withColumn("d", F.from_json("value", LAYOUT_B)).withColumn("p", F.col("d.payload"))
    kind = F.when(F.col("d.type") == "session_meta", "meta").when(F.col("d.type") == "turn_context", "turn").when(
        (F.col("d.type") == "event_msg") & (F.col("p.type") == "token_count"), "count")
    rows = d.withColumn("kind", kind).withColumn("stamp", F.col("d.timestamp")).withColumn("ts", parse_iso("d.timestamp")).where(
        (F.col("kind") != "count") | F.col("ts").isNotNull())
    snaps = F.when(F.col("kind") == "count", limit_readings("p.rate_limits", default_scope))
    rows = rows.withColumn("snaps", F.coalesce(snaps, F.array().cast(_READINGS)))
    links = F.transform(F.filter("snaps", lambda s: s["resets_at"].isNotNull() & (s["resets_at"] != 0)),
                        lambda s: F.struct(s["scope"].alias("scope"), s["window"].alias("window"), s["resets_at"].alias("resets_at")))
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    counts = lambda c: F.when(F.col(c).isNotNull(), F.array(*[F.coalesce(F.col(f"{c}.{k}").cast("bigint"), F.lit(0)) for k in COUNTERS]))
    rows = (rows.withColumn("links", F.when(F.size(links) > 0, links))
            .withColumn("plan", F.when(F.size("snaps") > 0, F.when(F.col("snaps")[0]["plan_type"] != "", F.col("snaps")[0]["plan_type"])))
            .withColumn("session", F.when(F.col("kind") == "meta", text("p.id")))
            .withColumn("model", F.when(F.col("kind") == "turn", text("p.model")).when(F.col("kind") == "count", text("p.info.model")))
            .withColumn("total", F.when(F.col("kind") == "count", counts("p.info.total_token_usage")))
            .withColumn("last", F.when(F.col("kind") == "count", counts("p.info.last_token_usage"))))
    for i, c in enumerate(COUNTERS):
        rows = rows.withColumn(f"high{i}", F.col("total")[i])
    return rows.drop("value", "p", "d")


_HIGHS = [f"high{i}" for i in range(len(COUNTERS))]
_CARRIED = {"last": ["links", "plan", "model"], "first": ["session"], "high": _HIGHS}


def fold_rows(rows: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Token-count lines with what earlier lines of the file carry over.

    Model, plan and limit links hold until replaced, the session id of the first meta line sticks, and
    counters keep their high-water mark.  All of it is a blocked scan over (file, split).  ``carried`` holds what
    lines of an earlier import left (``carry_over``); it stands before the first line of its file.
    """
    if carried is not None:
        before = carried.select("account_id", "file", *sum(_CARRIED.values(), []), F.lit(-1).cast("bigint").alias("block"),
                                F.lit(-1).cast("bigint").alias("seq"), F.lit("carried").alias("kind"))
        rows = rows.unionByName(before, allowMissingColumns=True)
    run = blocked_scan(rows, ["account_id", "file"], "block", ["seq"], **_CARRIED)
    return run.where(F.col("kind") == "count")


def carry_over(rows: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """What the lines of each file leave for lines that come later: one row a file."""
    keys = ["account_id", "file"]
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct("block", "seq"))
    slim = rows.select(*keys, "block", "seq", *sum(_CARRIED.values(), []))
    if carried is not None:
        slim = slim.unionByName(carried.select(*keys, F.lit(-1).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("seq"),
                                               *sum(_CARRIED.values(), [])))
    return slim.groupBy(*keys).agg(*[F.max_by(c, place(c)).alias(c) for c in _CARRIED["last"]],
                                   *[F.min_by(c, place(c)).alias(c) for c in _CARRIED["first"]], *[F.max(c).alias(c) for c in _CARRIED["high"]])


def fold_layout_b(lines: DataFrame, default_scope: str = "codex", keep=lambda df: df) -> DataFrame:
    """Folded token-count lines of whole files.  ``keep`` may cut lineage after parsing, since the scan reads the parsed lines twice."""
    return fold_rows(keep(session_rows(lines, default_scope)))


_READINGS = ("array<struct<scope string, window string, used_percent double, resets_at bigint, "
             "window_seconds bigint, plan_type string>>")


def limit_readings(limits: str, default_scope: str) -> Column:
    """Readings of the primary and secondary limit of a rate-limit object."""
    def one(name: str) -> Column:
        w = F.col(f"{limits}.{name}")
        seconds = w["window_minutes"].cast("bigint") * 60
        ok = w["used_percent"].isNotNull() & (w["window_minutes"] != 0)
        scope = F.coalesce(F.when(F.col(f"{limits}.limit_id") != "", F.col(f"{limits}.limit_id")), F.lit(default_scope))
        return F.when(ok, F.struct(scope.alias("scope"), window_name(seconds).alias("window"), w["used_percent"].alias("used_percent"),
                                   epoch_us(w["resets_at"]).alias("resets_at"), seconds.alias("window_seconds"),
                                   F.col(f"{limits}.plan_type").alias("plan_type")))
    return F.array_compact(F.array(one("primary"), one("secondary")))


def requests_of(folded: DataFrame, tool: str = "linked", prefix: str = "codex:") -> DataFrame:
    """Requests of folded layout-B lines, with the links still valid at their time."""
    high = F.array(*[F.col(f"high{i}__high") for i in range(len(COUNTERS))])
    grown = F.zip_with("total", high, lambda t, h: F.greatest(F.lit(0), t - h))
    delta = F.coalesce("last", F.when(F.col("high0__high").isNotNull(), grown), "total")
    d = folded.where(F.col("total").isNotNull() | F.col("last").isNotNull()).withColumn("delta", delta)
    inp, write, output, reasoning = (F.col("delta")[i] for i in (0, 2, 3, 4))
    cached = F.least(F.col("delta")[1], inp)
    as_list = lambda a: F.coalesce(F.concat(F.lit("["), F.array_join(F.col(a).cast("array<string>"), ", "), F.lit("]")), F.lit("null"))
    stamp = F.concat(F.lit('"'), F.col("stamp"), F.lit('"'))
    signature = F.concat(F.lit("["), F.when(F.col("total").isNotNull(), as_list("total")).otherwise(stamp),
                         F.lit(", "), as_list("last"), F.lit("]"))
    model = F.coalesce("model__last", F.lit("unknown"))
    live = F.coalesce(F.filter("links__last", lambda k: k["resets_at"] > F.col("ts")), F.array())
    return d.where((inp != 0) | (output != 0)).select(
        F.concat(F.lit(prefix), F.substring(F.sha1(signature), 1, 24)).alias("id"), "account_id", F.lit(tool).alias("tool"), "ts",
        model.alias("model"), is_on_plan(F.lit(tool), model).alias("on_plan"), F.col("session__first").alias("session_id"),
        F.greatest(F.lit(0), inp - cached - write).alias("input_tokens"), cached.alias("cache_read_tokens"),
        write.alias("cache_write_5m_tokens"), F.lit(0).cast("bigint").alias("cache_write_1h_tokens"),
        output.alias("output_tokens"), reasoning.alias("reasoning_tokens"), F.lit(None).cast("string").alias("speed"),
        live.alias("links"), F.col("plan__last").alias("plan_type"), "file", "block", "seq")


def snapshots_of(folded: DataFrame, tool: str = "linked", source: str = "log") -> DataFrame:
    """Percent snapshots reported in layout-B lines, first arrival per (limit, instant)."""
    s = folded.select("account_id", F.lit(tool).alias("tool"), "ts", *ARRIVAL, F.inline("snaps")).withColumn("source", F.lit(source))
    return s.select("account_id", "tool", "scope", "window", "ts", "used_percent", "resets_at", "window_seconds",
                    "plan_type", "source", *ARRIVAL)


def tables_of_sessions(req: DataFrame, snaps: DataFrame, prices: DataFrame, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """usage, links and snapshots from all copies of requests and readings.

    Replayed copies of a request share its id; a copy may still add links of other limits.  Rows of a deleted
    plan up to its deletion stay out.
    """
    if rules is not None:
        req, snaps = drop_deleted(req, rules), drop_deleted(snaps, rules)
    links = req.select(F.col("id").alias("usage_id"), "account_id", "tool", *ARRIVAL, F.inline("links"))
    keys = ["account_id", "tool"]
    usage = price_usage(first_wins(req.drop("links", "plan_type"), [*keys, "id"]), prices)
    return {
        "usage": usage.select(*USAGE.fieldNames()),
        "links": first_wins(links, [*keys, "usage_id", "scope", "window"]).drop(*ARRIVAL),
        "snapshots": first_wins(snaps, [*keys, "scope", "window", "ts"]).drop(*ARRIVAL),
    }


def tables_from_layout_b(lines: DataFrame, prices: DataFrame, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """usage, links and snapshots of layout B."""
    folded = cut(fold_layout_b(lines, keep=cut))
    return tables_of_sessions(requests_of(folded), snapshots_of(folded), prices, rules)


# -- file bookkeeping -----------------------------------------------------------------------------

def file_listing(spark: SparkSession, paths: list[str], glob: str = "*.jsonl") -> DataFrame:
    """Files below ``paths`` with size and modification time; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths)
            .select(F.col("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime")))


def truncation_gaps(listing: DataFrame, cursors: DataFrame, tool: str) -> DataFrame:
    """Files now shorter than what was read of them: what lay between may be gone."""
    c = cursors.select("account_id", "path", F.col("offset"), F.col("mtime").alias("read_mtime"))
    return listing.join(c, "path").where(F.col("size") < F.col("offset")).select(
        "account_id", F.lit(tool).alias("tool"), F.col("read_mtime").alias("start"), F.col("mtime").alias("end"),
        F.lit("truncated").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("detail"))


def retention_gaps(last_sync: DataFrame, now: int, retention: int = RETENTION) -> DataFrame:
    """Accounts (account_id, tool, ts of last sync) not read for longer than logs are kept."""
    return last_sync.where((F.col("ts") > 0) & (F.lit(now) - F.col("ts") > retention)).select(
        "account_id", "tool", F.col("ts").alias("start"), F.lit(now - retention).cast("bigint").alias("end"),
        F.lit("horizon").alias("kind"), F.lit(None).cast("string").alias("detail"))


def read_error_gaps(failures: DataFrame, cursors: DataFrame, now: int, tool: str) -> DataFrame:
    """Files that could not be read (account_id, path, error, fallback start): a gap from their last read on."""
    c = cursors.select("path", F.col("mtime").alias("read_mtime"))
    name = F.element_at(F.split("path", "/"), -1)
    return failures.join(c, "path", "left").select(
        "account_id", F.lit(tool).alias("tool"), F.coalesce("read_mtime", "fallback").alias("start"),
        F.lit(now).cast("bigint").alias("end"), F.lit("read_error").alias("kind"), F.concat(name, F.lit(": "), "error").alias("detail"))


def incident_gaps(incidents: DataFrame, account: Column, now: int, tool: str) -> DataFrame:
    """Gaps from what the tail source tells about files: truncated ones from the read before to the file's new time, unreadable ones up to now.

    ``incidents`` in the order of ``since``; a file that could be read again has no read-error gap.
    """
    rows = incidents.withColumn("account_id", account.cast("bigint")).withColumn("tool", F.lit(tool)).withColumn(
        "name", F.element_at(F.split("file", "/"), -1))
    cut_off = rows.where(F.col("event") == "truncated").select(
        "account_id", "tool", F.col("since").alias("start"), F.col("mtime").alias("end"), F.lit("truncated").alias("kind"), F.col("name").alias("detail"))
    failed = rows.where(F.col("event") == "read_error").select(
        "account_id", "tool", F.coalesce("since", F.lit(now)).cast("bigint").alias("start"), F.lit(now).cast("bigint").alias("end"),
        F.lit("read_error").alias("kind"), F.concat("name", F.lit(": "), "detail").alias("detail"))
    return clear_read_gaps(cut_off.unionByName(failed), rows.where(F.col("event") == "readable").select("account_id", "tool", "name"))


def clear_read_gaps(gaps: DataFrame, read_files: DataFrame) -> DataFrame:
    """Withdraw read-error gaps of files (account_id, tool, name) that have since been read in full."""
    g = gaps.withColumn("__name", F.when(F.col("kind") == "read_error", F.regexp_extract("detail", r"^(.*?): ", 1)))
    r = read_files.select("account_id", "tool", F.col("name").alias("__name")).distinct()
    return g.join(r, ["account_id", "tool", "__name"], "left_anti").select(*GAP.fieldNames())


def import_coverage(listing: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files present, files never read, and the oldest modification among those."""
    done = cursors.select("path", F.lit(True).alias("done")).distinct()
    return listing.join(done, "path", "left").agg(
        F.count("*").alias("files"), F.count_if(F.col("done").isNull()).alias("pending"),
        F.min(F.when(F.col("done").isNull(), F.col("mtime"))).alias("pending_oldest"))
