import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Row, functions as F, types as T

from depscope.operators import extract, graph, targets
from depscope.plans import discover
from depscope.streaming import debounce, events, firing, stateful, upkeep
from depscope.streaming.throttle import SegmentTable, firing_times, throttle

EVENT = "event_id bigint, path string, event_type string, ts timestamp"
START = datetime(2024, 1, 1)


def _brute(rows, window_ms):
    last, fired = {}, []
    for event_id, path, _, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        if path not in last or ts - last[path] >= timedelta(milliseconds=window_ms):
            last[path] = ts
            fired.append(event_id)
    return sorted(fired)


def _random_events(seed, n=600, span=40_000):
    rng = random.Random(seed)
    # Half of the events belong to one path.
    return [
        (i, "hot" if rng.random() < 0.5 else f"p{rng.randrange(5)}", rng.choice(["write", "create"]), START + timedelta(milliseconds=rng.randrange(span)))
        for i in range(n)
    ]


@pytest.mark.parametrize("window_ms", [1, 70, 500, 3000])
@pytest.mark.parametrize("segment_rows", [3, 40, 10_000])
def test_throttle_equals_plain_loop(spark, window_ms, segment_rows):
    data = _random_events(window_ms)
    got = throttle(spark.createDataFrame(data, EVENT), ["path"], window_ms, segment_rows=segment_rows)
    assert sorted(r["event_id"] for r in got.collect()) == _brute(data, window_ms)


def test_segment_tables_answer_every_incoming_time():
    rng = random.Random(5)
    for window in (1, 5, 30, 200):
        for _ in range(60):
            times = np.array(sorted(rng.randrange(400) for _ in range(rng.randrange(1, 60))), dtype=np.int64)
            table, cut = SegmentTable(window), rng.randrange(len(times))
            for part in (times[:cut], times[cut:]):
                if len(part):
                    table.add(part)
            rows = table.rows()
            for last in [None, *range(int(times[0]) - 2 * window - 2, int(times[0]) + 1)]:
                expected = firing_times(times, last, window)[1]
                at = 0 if last is None else int(np.searchsorted([e for e, _ in rows], last + window))
                assert (rows[at][1] if at < len(rows) else last) == expected


@pytest.mark.parametrize("segment_rows", [5, 10_000])
def test_throttle_with_null_keys_times_and_windows_by_key(spark, segment_rows):
    at = lambda k: START + timedelta(milliseconds=k)
    big = 2**62 + 1
    rows = [(i, None, 100, at(10 * i)) for i in range(50)] + [(100 + i, big, 250, at(10 * i)) for i in range(50)]
    rows += [(200 + i, big + 1, 0, at(0)) for i in range(3)] + [(300, 7, 100, None), (301, None, 100, None)]
    got = throttle(spark.createDataFrame(rows, "event_id bigint, user bigint, width int, ts timestamp"), ["user"], "width", segment_rows=segment_rows)
    assert got.columns == ["event_id", "user", "width", "ts"]
    fired = sorted((r.event_id, r.user) for r in got.collect())
    expected = [(i, None) for i in range(0, 50, 10)] + [(100, big), (125, big)] + [(200 + i, big + 1) for i in range(3)]
    assert fired == sorted(expected)


def test_plan_of_triggers_does_not_grow_with_their_windows(spark):
    happened = spark.createDataFrame([(1, "a/b.go", "create", START)], EVENT)
    plans = [
        firing.fire_triggers(happened, [events.Trigger(f"t{i}", debounce_ms=100 + i) for i in range(n)])._jdf.queryExecution().executedPlan().toString()
        for n in (1, 6)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_throttle_without_window_keeps_all(spark):
    data = _random_events(1, 20)
    assert throttle(spark.createDataFrame(data, EVENT), ["path"], 0).count() == 20


def _run(stream, tmp_path):
    (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def _source(spark, data, tmp_path, parts):
    """The events in files of random order, one per micro-batch, then one far later event that moves the watermark."""
    rng = random.Random(0)
    shuffled = sorted(data, key=lambda r: (r[3] - START).total_seconds() + rng.random() * 5)
    late = (10**6, "end", "write", START + timedelta(days=2))
    size = -(-len(shuffled) // parts)
    chunks = [shuffled[i:i + size] for i in range(0, len(shuffled), size)] + [[late]]
    folder = tmp_path / "in"
    for i, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, EVENT).coalesce(1).write.mode("append").parquet(str(folder / f"d{i:03d}"))
    return spark.readStream.schema(spark.createDataFrame([], EVENT).schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def test_stream_throttle_equals_table(spark, tmp_path):
    data = _random_events(3, 300)
    stream = stateful.throttle_stream(_source(spark, data, tmp_path, 4), ["path"], 700, "20 seconds")
    got = sorted(r["event_id"] for r in _run(stream, tmp_path).where("path <> 'end'").collect())
    assert got == _brute(data, 700)


class _Calls:
    """State of one key in memory, counting the calls to it."""

    def __init__(self):
        self.map, self.value, self.calls, self.timers = {}, None, 0, []

    def __getattr__(self, name):
        made = {
            "getValueState": lambda *_: self, "getMapState": lambda *_: self, "registerTimer": self.timers.append,
            "containsKey": lambda k: k in self.map, "updateValue": self.map.__setitem__, "getValue": self.map.__getitem__, "removeKey": self.map.pop,
            "keys": lambda: list(self.map), "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
        }[name]

        def call(*args):
            self.calls += 1
            return made(*args)

        return call

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_calls_to_the_state_do_not_follow_the_events():
    held = T.StructType([T.StructField("event_micros", T.LongType()), T.StructField("event_id", T.LongType())])
    calls = {}
    for n in (10, 1000):
        state = _Calls()
        throttler = stateful.ThrottleProcessor(["path", "event_micros", "event_id"], held, 1, "event_id")
        throttler.init(state)
        data, fired = [Row(event_micros=500 * i, event_id=i) for i in range(n)] + [Row(event_micros=None, event_id=-1)], []
        random.Random(1).shuffle(data)
        throttler.handleInputRows(("k",), iter(data), state)
        # The watermark stops inside what came together; the rest fires later, and nothing twice.
        for state.watermark in (n // 4, n // 4, n):
            fired += [r.event_id for r in throttler.handleExpiredTimer(("k",), state, None)]
        assert fired == list(range(0, n, 2)) and not state.map
        calls[n] = state.calls
    assert calls[10] == calls[1000] < 30


def test_stream_keeps_every_digit_beside_nulls(spark, tmp_path):
    schema = "path string, event_id long, ts timestamp, n long, small int, flag boolean, name string, size decimal(20, 2), day date, x double, raw binary, tags array<long>, at timestamp"
    big, at = 2**53 + 1, lambda k: START + timedelta(seconds=k)
    full = lambda i: (big + i, i, bool(i % 2), f"n{i}", Decimal(f"123456789012345678.{i:02d}"), START.date(), 0.1, b"\x00\xff", [big, None], at(i))
    none = (None,) * 10
    rows = [("k", big + i, at(10 * i), *(none if i % 3 == 1 else full(i))) for i in range(9)]
    late = [("end", 0, START + timedelta(days=2), *none)]
    for i, chunk in enumerate((rows[:4], rows[4:], late)):
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = _run(stateful.throttle_stream(source, ["path"], 1, "1 hour"), tmp_path).where("path = 'k'").collect()
    expected = spark.createDataFrame(rows, schema).collect()
    assert sorted(got, key=lambda r: r.event_id) == expected


def test_stream_debounce_equals_table(spark, tmp_path):
    # Includes a quiet time of exactly the gap.
    data = _random_events(4, 120, 200_000) + [(900, "edge", "write", START), (901, "edge", "write", START + timedelta(milliseconds=2500))]
    cols = ["path", "first_ts", "last_ts", "n_events"]
    table = sorted(map(tuple, debounce.debounce_trailing(spark.createDataFrame(data, EVENT), ["path"], 2500).select(*cols).collect()))
    stream = debounce.debounce_stream(_source(spark, data, tmp_path, 3), ["path"], 2500, "20 seconds")
    assert sorted(map(tuple, _run(stream, tmp_path).where("path <> 'end'").select(*cols).collect())) == table


def test_patterns_and_kinds(spark, rows):
    one = spark.range(1)
    match = lambda path, pattern: one.select(events.matches_pattern(F.lit(path), pattern)).first()[0]
    assert match("a/b.go", "*") and match("a/b.go", "*.go") and not match("a/b.go", "*.py")
    assert match("x/Makefile", "Makefile") and not match("x/Makefile.am", "Makefile")
    masks = spark.createDataFrame([("a", 0x8 | 0x200, 1), ("b", 0x400, 2), ("c", 0x100, 3), ("d", 0x1, 4)], "path string, mask int, ts int")
    assert rows(events.typed_events(masks).select("path", "event_type")) == [("a", "write"), ("b", "delete"), ("c", "create")]


def test_triggers(spark, rows):
    triggers = [events.Trigger("all"), events.Trigger("go", "*.go", ("create",)), events.Trigger("short", "*" + "x" * 50)]
    happened = spark.createDataFrame([(1, "a/b.go", "create", START), (2, "c", "delete", START)], EVENT)
    assert rows(events.match_triggers(happened, triggers).select("trigger", "event_id")) == [("all", 2), ("go", 1)]
    actions = events.action_rows(events.match_triggers(happened, [events.Trigger("c", events=("create",), command="run {{ .FilePath }}")]))
    assert [r["command"] for r in actions.collect()] == ["run a/b.go"]


def test_triggers_are_sent_to_the_events_and_not_the_events_to_them(spark, tmp_path):
    spark.createDataFrame([(i, "a/b.go", "write", START) for i in range(50)], EVENT).write.parquet(str(tmp_path / "events"))
    triggers = [events.Trigger("all", on_success=events.TriggerAction("set_xattr", "k", "v")), events.Trigger("go", "*.go")]
    matched = events.match_triggers(spark.read.parquet(str(tmp_path / "events")), triggers)
    outcomes = spark.read.parquet(str(tmp_path / "events")).select(F.lit("all").alias("trigger"), "path", (F.col("event_id") > 9).alias("success"))
    updates = events.action_metadata(outcomes, triggers, 1)
    for frame, count in ((matched, 100), (updates, 40)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan and "hashpartitioning" not in plan
        assert frame.count() == count


def _keeper(spark, store, texts):
    """A function that applies a batch of (path, kind) events; files have the texts of that moment."""
    def batch(number, *happened):
        files = spark.createDataFrame(list(texts.items()) or [("", "")], "path string, content string")
        frame = spark.createDataFrame([(p, k, START + timedelta(seconds=i)) for i, (p, k) in enumerate(happened)], "path string, event_type string, ts timestamp")
        upkeep.apply_batch(store, frame, number, lambda wanted: files.join(wanted, "path", "left_semi"))

    return batch


def _discovered(spark, texts):
    return discover.discover(spark.createDataFrame(list(texts.items()), "path string, content string")).distinct()


def test_upkeep_equals_discovery_with_tests_and_impact(spark, tmp_path, rows):
    store, texts = upkeep.EdgeStore(spark, str(tmp_path / "store")), {}
    batch = _keeper(spark, store, texts)
    texts.update({"s/a.py": "import b\nimport c\n", "s/d.py": "import b\n", "s/b.py": "", "s/x.c": '#include "h/y.h"\n', "s/h/y.h": ""})
    batch(0, *[(p, "create") for p in texts])
    assert rows(store.edges()) == rows(_discovered(spark, texts))
    # A test appears: its source gets an edge too, though it did not change.
    texts["s/test_b.py"] = "import b\n"
    for _ in range(2):
        batch(1, ("s/test_b.py", "create"), ("s/h/y.h", "write"))
    assert rows(store.edges()) == rows(_discovered(spark, texts))
    assert rows(store.changes().where("batch = 1").select("from", "to", "change")) == [
        ("s/b.py", "s/test_b.py", "added"), ("s/test_b.py", "pkg:b", "added"), ("s/test_b.py", "s/b.py", "added")]
    # The source is named by its test edge; the header by the file that includes it.
    assert rows(store.impacted().where("batch = 1").select("path", "depth")) == [("s/a.py", 2), ("s/b.py", 1), ("s/d.py", 2), ("s/x.c", 1)]
    assert rows(store.metadata().where("batch = 1 AND key LIKE '%impact'").select("path", "value")) == [
        ("s/a.py", "indirect:2"), ("s/b.py", "direct:1"), ("s/d.py", "indirect:2"), ("s/x.c", "direct:1")]
    # The test goes, and the edge of its source with it.
    del texts["s/test_b.py"], texts["s/d.py"]
    texts["s/a.py"] = "import c\nimport e\n"
    batch(2, ("s/a.py", "write"), ("s/d.py", "write"), ("s/d.py", "delete"), ("s/test_b.py", "delete"))
    assert rows(store.edges()) == rows(_discovered(spark, texts))


def test_compaction_survives_repeats_and_new_queries(spark, tmp_path, rows):
    store, texts = upkeep.EdgeStore(spark, str(tmp_path / "store")), {"a.py": "import x\n", "b.py": "import y\n"}
    batch = _keeper(spark, store, texts)
    batch(0, ("a.py", "create"), ("b.py", "create"))
    texts["a.py"] = "import z\n"
    batch(1, ("a.py", "write"))
    expected, history = rows(_discovered(spark, texts)), rows(store.changes().select("from", "to", "change"))
    store.compact()
    assert rows(store.edges()) == expected and rows(store.changes().select("from", "to", "change")) == history
    batch(1, ("a.py", "write"))  # The newest batch comes again.
    assert rows(store.edges()) == expected and rows(store.changes().select("from", "to", "change")) == history
    store.begin()  # A query without its checkpoint counts from 0 again.
    texts["b.py"] = "import w\n"
    batch(0, ("b.py", "write"))
    assert rows(store.edges()) == rows(_discovered(spark, texts))
    # A compaction that did not get to its mark is not seen.
    store.write("edges", store.edges().limit(0).withColumn("part", F.lit("imports")), -1, store.generation() + 1)
    assert rows(store.edges()) == rows(_discovered(spark, texts))
    store.compact()
    assert rows(store.edges()) == rows(_discovered(spark, texts)) and store.generation() == 3


def _exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_current_edges_are_read_as_they_lie_while_nothing_replaced_them(spark, tmp_path, rows):
    store, texts = upkeep.EdgeStore(spark, str(tmp_path / "store")), {"a.py": "import x\n", "b.py": "import a\n", "test_a.py": ""}
    batch = _keeper(spark, store, texts)
    batch(0, *[(p, "create") for p in texts])
    assert _exchanges(store.edges()) == 0
    # All files are of this batch: what it adds is what it wrote, and nothing else depends on it.
    assert rows(store.changes().select("from", "to", "rel")) == rows(store.edges()) and store.impacted().count() == 0
    texts["a.py"] = "import y\n"
    batch(1, ("a.py", "write"))
    store.compact()
    assert _exchanges(store.edges()) == 0 and rows(store.edges()) == rows(_discovered(spark, texts))
    # Edges of a batch that broke off before its files were written are not seen.
    store.write("edges", store.edges().withColumn("part", F.lit("imports")), 7)
    assert rows(store.edges()) == rows(_discovered(spark, texts))


def test_what_a_batch_changed_takes_one_shuffle_of_the_edges(spark, tmp_path, rows):
    store = upkeep.EdgeStore(spark, str(tmp_path / "store"))
    # Per batch the files and parts it touched, and the edges it wrote for them. The last one meets edges of both parts that the second replaced.
    batches = [
        ({"a", "b", "c"}, {"a", "b"}, [("a", "x", "imports"), ("a", "k", "imports"), ("b", "x", "imports"), ("a", "t", "tests"), ("b", "u", "tests")]),
        ({"a"}, {"a"}, [("a", "y", "imports"), ("a", "k", "imports")]),
        ({"a", "c"}, {"a", "b"}, [("a", "x", "imports"), ("a", "k", "imports"), ("a", "t", "tests")]),
    ]
    for number, (imports, tests, edges) in enumerate(batches):
        files = [(p, False, "imports") for p in imports] + [(p, False, "tests") for p in tests]
        store.write("edges", spark.createDataFrame([(*e, "imports" if e[2] == "imports" else "tests") for e in edges], "`from` string, `to` string, rel string, part string"), number)
        store.write("files", spark.createDataFrame(files, "path string, deleted boolean, part string"), number)
    assert rows(store.difference(1)) == [("a", "t", "tests", "removed"), ("a", "x", "imports", "removed"), ("a", "y", "imports", "added")]
    assert rows(store.difference(2)) == [("a", "t", "tests", "added"), ("a", "x", "imports", "added"), ("a", "y", "imports", "removed"), ("b", "u", "tests", "removed")]
    assert rows(store.edges()) == [("a", "k", "imports"), ("a", "t", "tests"), ("a", "x", "imports"), ("b", "x", "imports")]
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(store.difference(2)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_last_events_are_hashed_and_not_sorted(spark, rows):
    at = lambda k: None if k is None else START + timedelta(seconds=k)
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", "c", "d", "e", "f", None]), rng.choice(["write", "delete", None]), at(rng.choice([None, 1, 2]))) for _ in range(40)]
    data += [("g", None, None), ("h", "delete", None), ("h", "write", None), ("i", None, at(1)), ("j", "delete", at(1)), ("j", None, at(2))]
    frame = spark.createDataFrame(data, "path string, event_type string, ts timestamp")
    low = lambda x: (x is not None, x or 0)
    last = {}
    for path, kind, ts in data:
        gone = None if kind is None else kind == "delete"
        mine = (ts is not None, ts or START, *low(gone))
        if path not in last or mine > last[path][0]:
            last[path] = mine, (path, gone, ts)
    got = upkeep.net_changes(frame)
    assert rows(got) == sorted([row for _, row in last.values()], key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_texts_are_made_once_and_behind_the_join(spark, tmp_path, rows):
    spark.createDataFrame([("a.py", "import xx\n"), ("b.py", "import y\n"), ("c.md", "import z\n")], "path string, content string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    made = files.withColumn("content", F.regexp_replace("content", "xx", "swapped")).join(files.select("path"), "path", "left_semi")
    imports = extract.extract_imports(made)
    assert rows(imports.select("from", "to")) == [("a.py", "pkg:swapped"), ("b.py", "pkg:y")]
    filters = [line for line in imports._jdf.queryExecution().executedPlan().toString().splitlines() if " Filter " in line]
    assert filters and not any("regexp_replace" in line.partition("FileScan")[0] or "Contains(content" in line for line in filters)


def test_a_target_is_a_few_rows_and_means_what_its_candidates_mean(spark, rows):
    named = ["./d", "../c/d", ".", "..", "./", "d/.", "./x/../d", "/q", "d.ts", "m//d", "", "../../../d", "d\n"]
    found = ["a/c/d.ts", "a/c/d.js", "a/c/d", "a/c/d/index.ts", "a/c/index.js", "a/c", "a", "a/c.rb", "/q.ts", "a/c/d.ts.tsx", "a/c/m/d.ts", "../d.ts", "a/c/.ts",
             "a/c/os.py", "os.py", "os/__init__.py", "os/__init__/__init__.py", "a/c/d\n.ts", "local:./d"]
    edges = [("a/c/x.ts", f"local:{n}", "i") for n in named] + [("a/c/x.py", f"pkg:{n}", "i") for n in ("os", "os.__init__", ".", "c..os")] + [("a/x.go", "pkg:os", "i")]
    edges = spark.createDataFrame(edges, "`from` string, `to` string, rel string")
    files = spark.createDataFrame([(f,) for f in found] + [(None,)], "path string")
    plain = edges.select("from", "rel", F.explode(targets.candidates(F.col("from"), F.col("to"))).alias("to")).join(files.select(F.col("path").alias("to")), "to", "left_semi")
    resolved = targets.resolved_edges(edges, files)
    assert rows(resolved) == rows(plain.select("from", "to", "rel").distinct()) and resolved.count() > 12
    common = edges.where(~F.col("to").rlike(r"[./]$|:$|\.\.")).select(F.max(F.size(targets._keys(F.col("from"), F.col("to"))))).first()[0]
    assert common <= 2


def test_targets_mean_files(spark, rows):
    files = spark.createDataFrame([("a/b.h",), ("a/c/d.ts",), ("a/m/__init__.py",), ("q.py",)], "path string")
    e = spark.createDataFrame([
        ("a/x.c", "local:./b.h", "i"), ("a/c/x.c", "local:../b.h", "i"), ("a/y.ts", "local:./c/d", "i"), ("a/z.py", "pkg:m", "i"), ("a/z.py", "pkg:q", "i"),
        ("a/x.c", "sys:b.h", "i"), ("a/y.go", "pkg:q", "i"), ("a/x.c", "local:../../b.h", "i"),
    ], "`from` string, `to` string, rel string")
    assert rows(targets.resolved_edges(e, files).select("from", "to")) == [
        ("a/c/x.c", "a/b.h"), ("a/x.c", "a/b.h"), ("a/y.ts", "a/c/d.ts"), ("a/z.py", "a/m/__init__.py"), ("a/z.py", "q.py")]


def test_upkeep_stream(spark, tmp_path, rows):
    store = upkeep.EdgeStore(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("a.py", "import b\n"), ("b.py", "import c\n")], "path string, content string")
    spark.createDataFrame([(1, "a.py", "write", START), (2, "b.py", "create", START)], EVENT).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.createDataFrame([], EVENT).schema).parquet(str(tmp_path / "in"))
    load = lambda wanted: files.join(wanted, "path", "left_semi")
    upkeep.maintain_graph(source, store, load, str(tmp_path / "ck"), availableNow=True).awaitTermination()
    assert rows(store.edges()) == [("a.py", "pkg:b", "imports"), ("b.py", "pkg:c", "imports")]
