"""Registered queries: file events, triggers, throttling and streams over the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks.views import edge_view, table, view, with_views
from depscope import scratch
from depscope.functions.paths import file_name
from depscope.operators import associate
from depscope.schemas import EDGE_COLUMNS
from depscope.session import prepare_streaming
from depscope.streaming import blobs, debounce, events, firing, stateful, throttle, upkeep

EVENTS = with_views("fx_events", recursive=True)
QUERIES, ORACLES = {}, {}
HOUR_MS = 3_600_000


def _register(name, query, oracle=None):
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def _events(s, d):
    return view(s, d, "fx_events")


# The path of the event that closes a stream: days after all others, it moves the watermark past them.
_CLOSING = "src/m-1/f-1.rs"


def _event_stream(s, d):
    """The event table as a stream, with the columns of `fx_events`, and a closing event."""
    given = table(s, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    closing = given.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), "ts")
    folder = scratch.new_folder(s, "event-stream")
    given.write.parquet(f"{folder}/given")
    closing.write.parquet(f"{folder}/closing")
    raw = s.readStream.schema(given.schema).parquet(f"{folder}/*")
    user = F.col("user_id")
    kind = F.when(F.col("event_type").isin("view", "purchase"), "write").when(F.col("event_type").isin("click", "signup"), "create").when(
        F.col("event_type") == "error", "delete"
    )
    ending = F.when(user % 3 == 0, ".go").when(user % 3 == 1, ".py").otherwise(".rs")
    return raw.select(
        "event_id", F.concat(F.lit("src/m"), user % 10, F.lit("/f"), user, ending).alias("path"), kind.alias("event_type"), "ts")


def _run(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all its input and read what it wrote."""
    spark = stream.sparkSession
    prepare_streaming(spark)
    folder = scratch.new_folder(spark, label)
    (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").where(F.col("path") != _CLOSING)


# -- events and triggers -----------------------------------------------------
TRIGGERS = (
    events.Trigger("update-graph", "*", ("write", "create", "delete"), builtin="parse-and-diff", debounce_ms=2 * HOUR_MS),
    events.Trigger(
        "lint", "*.go", ("write",), command="lint {{ .FilePath }}", debounce_ms=2 * HOUR_MS,
        on_success=events.TriggerAction("set_xattr", "last_linted", "{{ .FilePath }}"), on_failure=events.TriggerAction("warn"),
    ),
    events.Trigger("watch-one", "f7.py", ("write", "delete"), command="check", async_exec=False, debounce_ms=2 * HOUR_MS),
    events.Trigger("sync", "*3.rs", ("create",), builtin="upload-to-backend", debounce_ms=5 * HOUR_MS),
)
_MATCHED = """matched AS (
  SELECT 'update-graph' AS "trigger", event_id, path, event_type, ts, 2 AS hours FROM fx_events
  UNION ALL SELECT 'lint', event_id, path, event_type, ts, 2 FROM fx_events WHERE path LIKE '%.go' AND event_type = 'write'
  UNION ALL SELECT 'watch-one', event_id, path, event_type, ts, 2 FROM fx_events WHERE path LIKE '%/f7.py' AND event_type IN ('write', 'delete')
  UNION ALL SELECT 'sync', event_id, path, event_type, ts, 5 FROM fx_events WHERE path LIKE '%3.rs' AND event_type = 'create')"""


def _fired(source: str, keys: str) -> str:
    """The greedy rule as a recursion from each firing to the next event a window later."""
    on = " AND ".join(f"e.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    return f"""fired AS (
      SELECT {keys}, hours, min(ts) AS ts FROM {source} GROUP BY {keys}, hours
      UNION ALL
      SELECT {mine}, f.hours, min(e.ts) FROM fired f JOIN {source} e ON {on} AND e.ts >= f.ts + f.hours * INTERVAL 1 HOUR
      GROUP BY {mine}, f.hours, f.ts
    )"""


_register(
    "typed_events",
    lambda s, d: events.typed_events(table(s, d, "events").select(
        F.concat(F.lit("f"), "user_id").alias("path"), F.expr("shiftleft(1, cast(event_id % 11 AS int))").alias("mask"), "event_id"
    )),
    """SELECT concat('f', user_id) AS path, event_id, CASE event_id % 11 WHEN 3 THEN 'write' WHEN 8 THEN 'create' ELSE 'delete' END AS event_type
    FROM events WHERE event_id % 11 IN (3, 8, 9, 10)""",
)
_register(
    "match_triggers", lambda s, d: events.match_triggers(_events(s, d), TRIGGERS).select("trigger", "event_id", "path", "event_type"),
    f'{EVENTS}, {_MATCHED} SELECT "trigger", event_id, path, event_type FROM matched',
)
_register(
    "match_pattern",
    lambda s, d: _events(s, d).where(events.matches_pattern(F.col("path"), "*1.py")).select("event_id"),
    f"{EVENTS} SELECT event_id FROM fx_events WHERE path LIKE '%1.py'",
)
_register(
    "throttle_path_and_type", lambda s, d: throttle.throttle(_events(s, d), ["path", "event_type"], 2 * HOUR_MS).select("event_id", "path", "event_type"),
    f"""{EVENTS}, timed AS (SELECT *, 2 AS hours FROM fx_events), {_fired('timed', 'path, event_type')}
    SELECT min(event_id) AS event_id, path, event_type FROM fired JOIN fx_events USING (path, event_type, ts) GROUP BY path, event_type, ts""",
)
_BY_PATH = f"""{EVENTS}, timed AS (SELECT *, 2 AS hours FROM fx_events), {_fired('timed', 'path')}
    SELECT min(event_id) AS event_id, path FROM fired JOIN fx_events USING (path, ts) GROUP BY path, ts"""
_register("throttle_path", lambda s, d: throttle.throttle(_events(s, d), ["path"], 2 * HOUR_MS).select("event_id", "path"), _BY_PATH)
_register(
    # The same rule with every key cut into segments.
    "throttle_hot_keys", lambda s, d: throttle.throttle(_events(s, d), ["path"], 2 * HOUR_MS, segment_rows=5).select("event_id", "path"), _BY_PATH,
)
_register(
    "debounce_trailing",
    lambda s, d: debounce.debounce_trailing(_events(s, d), ["path"], 3 * HOUR_MS).select(
        "path", "n_events", (F.unix_micros("last_ts") - F.unix_micros("first_ts")).alias("length")
    ),
    f"""{EVENTS}, steps AS (SELECT path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS starts FROM fx_events),
    bursts AS (SELECT path, ts, sum(starts) OVER (PARTITION BY path ORDER BY ts) AS burst FROM steps)
    SELECT path, count(*) AS n_events, epoch_us(max(ts)) - epoch_us(min(ts)) AS length FROM bursts GROUP BY path, burst""",
)
_COMMAND = "CASE \"trigger\" WHEN 'update-graph' THEN 'parse-and-diff' WHEN 'sync' THEN 'upload-to-backend' WHEN 'lint' THEN concat('lint ', path) ELSE 'check' END"
_ACTIONS = f"""SELECT "trigger", path, CASE WHEN "trigger" IN ('update-graph', 'sync') THEN 'builtin' ELSE 'command' END AS action,
  {_COMMAND} AS command, "trigger" <> 'watch-one' AS async_exec, 30 AS timeout_seconds FROM fired"""
_register(
    "fire_triggers", lambda s, d: firing.fire_triggers(_events(s, d), TRIGGERS).drop("ts", "event_type"),
    f"""{EVENTS}, {_MATCHED}, {_fired('matched', '"trigger", path')} {_ACTIONS}""",
)
_register(
    "action_metadata",
    lambda s, d: events.action_metadata(
        firing.fire_triggers(_events(s, d), TRIGGERS).select("trigger", "path", (F.length("path") % 2 == 0).alias("success")), TRIGGERS, 5
    ),
    f"""{EVENTS}, {_MATCHED}, {_fired('matched', '"trigger", path')}
    SELECT path, 'user.vfs.last_linted' AS key, path AS value, 5 AS version FROM fired WHERE "trigger" = 'lint' AND length(path) % 2 = 0""",
)

# -- streams -----------------------------------------------------------------
# With the closing event a stream gives what its table twin gives.
_register(
    "throttle_stream",
    lambda s, d: _run(stateful.throttle_stream(_event_stream(s, d), ["path"], 2 * HOUR_MS, "10 minutes"), "throttle").select("event_id", "path"),
    _BY_PATH,
)
_register(
    "debounce_stream",
    lambda s, d: _run(debounce.debounce_stream(_event_stream(s, d), ["path"], 3 * HOUR_MS, "10 minutes"), "debounce").select(
        "path", "n_events", (F.unix_micros("last_ts") - F.unix_micros("first_ts")).alias("length")
    ),
    ORACLES["debounce_trailing"],
)


def _fire_stream(s, d):
    fired = firing.fire_triggers_stream(_event_stream(s, d), TRIGGERS, "10 minutes")
    return _run(fired, "fire").select("trigger", "path", "action", "command", "async_exec", "timeout_seconds")


_register("fire_triggers_stream", _fire_stream, ORACLES["fire_triggers"])


def _blob_stream(s, d):
    folder = scratch.new_folder(s, "blob-stream")
    raw = s.readStream.schema(table(s, d, "documents").schema).option("pathGlobFilter", "documents.parquet").parquet(d)
    objects = raw.select(
        F.concat(F.lit("docs/"), "doc_id").alias("path"), F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1700000000)).alias("modificationTime"),
    )
    blobs.index_blobs(objects, f"{folder}/index", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    from depscope.sources.tables import read_blob_index

    return read_blob_index(s, f"{folder}/index")


_register(
    "blob_index_stream", _blob_stream,
    "SELECT concat('docs/', doc_id) AS path, concat('sha256:', sha256(text)) AS hash, 's3' AS backend, 1700000000 AS uploaded_at FROM documents",
)


# -- keeping a graph current -------------------------------------------------
def _maintained(s, d):
    """Two batches over all files: all are written, then each seventh is deleted and each fifth source changed."""
    files = view(s, d, "fx_files")
    key = F.regexp_extract("path", r"mod_(\d+)", 1).cast("bigint")
    source = associate.source_of_test(file_name(F.col("path"))).isNull()
    store = upkeep.EdgeStore(s, scratch.new_folder(s, "store"))
    first = files.select("path", F.lit("create").alias("event_type"), F.timestamp_seconds(F.lit(1700000000)).alias("ts"))
    second = files.where((key % 7 == 0) | ((key % 5 == 0) & source)).select(
        "path", F.when(key % 7 == 0, "delete").otherwise("write").alias("event_type"), F.timestamp_seconds(F.lit(1700000100)).alias("ts")
    )
    changed = files.withColumn("content", F.when((key % 5 == 0) & source, F.regexp_replace("content", "json|fmt|stdio|std", "swapped")).otherwise(F.col("content")))
    load = lambda texts: lambda wanted: texts.join(wanted, "path", "left_semi")
    upkeep.apply_batch(store, first, 0, load(files))
    for _ in range(2):  # The second run of a batch changes nothing.
        upkeep.apply_batch(store, second, 1, load(changed))
    return store, lambda batch, rows: upkeep.apply_batch(store, rows, batch, load(changed)), second, changed.where(key % 7 != 0)


def _compacted(s, d):
    """The same, compacted; then the newest batch comes again, and a new query counts its batches from 0."""
    store, apply, second, present = _maintained(s, d)
    store.compact()
    apply(1, second)
    store.begin()
    key = F.regexp_extract("path", r"mod_(\d+)", 1).cast("bigint")
    apply(0, present.where(key % 11 == 0).select("path", F.lit("write").alias("event_type"), F.timestamp_seconds(F.lit(1700000200)).alias("ts")))
    return store


from checks.files import _IMPORTS, _SOURCE_OF, _TESTED_BY, _TESTS, _WITH_EXT  # noqa: E402

_STATES = f"""{_WITH_EXT.replace('known AS', 'known_all AS')}, keyed AS (
  SELECT path, content, ext, CAST(regexp_extract(path, 'mod_(\\d+)', 1) AS BIGINT) AS k, regexp_extract(path, '([^/]*)$', 1) AS name FROM known_all
), known AS (
  SELECT path, ext, k % 5 = 0 AND {_SOURCE_OF} IS NULL AS written,
    CASE WHEN k % 5 = 0 AND {_SOURCE_OF} IS NULL THEN regexp_replace(content, 'json|fmt|stdio|std', 'swapped', 'g') ELSE content END AS content
  FROM keyed WHERE k % 7 <> 0
), named AS (
  SELECT path, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM known
), named_all AS (
  SELECT path, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM known_all
)"""
_NOW = " UNION ALL ".join([_IMPORTS, *[x.replace("fx_files", "known") for x in (_TESTED_BY, _TESTS)]])
_BEFORE = " UNION ALL ".join([_IMPORTS.replace("FROM known", "FROM known_all"), *[x.replace("FROM named", "FROM named_all").replace("fx_files", "known_all") for x in (_TESTED_BY, _TESTS)]])
_register("maintained_edges", lambda s, d: _maintained(s, d)[0].edges(), f"{_STATES}, now AS ({_NOW}) SELECT DISTINCT * FROM now")
_register("maintained_compacted", lambda s, d: _compacted(s, d).edges(), f"{_STATES}, now AS ({_NOW}) SELECT DISTINCT * FROM now")
_register(
    "maintained_changes",
    lambda s, d: _maintained(s, d)[0].changes().where("batch = 1").select(*EDGE_COLUMNS, "change"),
    f"""{_STATES}, now AS ({_NOW}), before AS ({_BEFORE})
    SELECT *, 'added' AS change FROM (SELECT DISTINCT * FROM now EXCEPT SELECT DISTINCT * FROM before)
    UNION ALL SELECT *, 'removed' FROM (SELECT DISTINCT * FROM before EXCEPT SELECT DISTINCT * FROM now)""",
)
_register(
    # What depends on a changed source: the tests that stand beside it.
    "maintained_impact",
    lambda s, d: _maintained(s, d)[0].impacted().where("batch = 1").select("path", "relation", "depth"),
    f"""{_STATES}, tested AS ({_TESTED_BY.replace('fx_files', 'known')})
    SELECT "from" AS path, 'tested_by' AS relation, 1 AS depth FROM tested WHERE "to" IN (SELECT path FROM known WHERE written)""",
)
