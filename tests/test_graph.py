import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from depscope.operators import associate, graph, reports
from depscope.plans import traverse
from depscope.sources.layout import lookup, write_layout

@pytest.mark.parametrize("seed", range(2))
def test_impact_equals_plain_search(spark, rows, seed):
    # Few names, so that there are cycles, self-loops and repeated edges; depths from none to more than there are names.
    rng = random.Random(seed)
    data = [(f"v{rng.randrange(9)}", f"v{rng.randrange(9)}", rng.choice(("imports", "calls"))) for _ in range(14)]
    graph_ = spark.createDataFrame(data, "`from` string, `to` string, rel string")
    for depth in (0, 1, 2, 12):
        assert rows(traverse.impact(graph_, "v3", depth)) == _brute(data, "v3", depth)
    assert rows(traverse.impact(graph_, "not there", 4)) == rows(traverse.impact(graph_.limit(0), "v3", 4)) == []


@pytest.mark.parametrize("seed", range(3))
def test_impact_across_repositories_equals_plain_search(spark, rows, seed):
    rng = random.Random(seed)
    paths = [f"r{i % 4}/d{i % 3}/f{i}.x" for i in range(24)]
    data, plain = [], []
    for _ in range(40):
        src, dst = rng.sample(paths, 2)
        repo, rest = dst.split("/", 1)
        data.append((src, f"external:{repo}:{rest}" if rng.random() < 0.5 else dst, "imports"))
        plain.append((src, dst, "imports"))
    e = spark.createDataFrame(data, "`from` string, `to` string, rel string")
    assert rows(traverse.impact(e, paths[0], 5, external=True)) == _brute(plain, paths[0], 5)
    assert rows(traverse.impact(e, paths[0], 5)) == _brute(data, paths[0], 5)


def test_external_names_are_suffixes_and_literal(edges, rows):
    e = edges(("a", "local:x.h"), ("b", "external:r:s:x.h"), ("c", "x.h"), ("d", "local:y_h"), ("e", "local:yxh"), ("f", "xx.h"))
    assert [r[0] for r in rows(traverse.impact(e, "x.h", 1, external=True))] == ["a", "b", "c"]
    assert [r[0] for r in rows(traverse.impact(e, "y_h", 1, external=True))] == ["d"]


def test_walks_write_no_copy_of_the_edges_and_prune_at_every_level(spark, edges, tmp_path, monkeypatch):
    layout = write_layout(edges(*[(f"n{i + 1}", f"n{i}") for i in range(30)]), str(tmp_path / "layout"), "to", 16)
    plans, store = [], traverse.scratch.store

    def seen(df, folder):
        if "/found/" in folder:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, folder)

    monkeypatch.setattr(traverse.scratch, "store", seen)
    done = traverse.walk(layout, "n0", 4)
    assert done.total == 4 and len(plans) == 4
    assert all("dynamicpruning" in p and "PartitionFilters: [isnotnull(bucket" in p for p in plans)


def _brute(edges, root, max_depth, forward=False):
    into = defaultdict(list)
    for src, dst, rel in edges:
        a, b = (src, dst) if forward else (dst, src)
        into[a].append((b, rel))
    depth, level, found = 0, {root}, {}
    while level and depth < max_depth:
        depth, nxt = depth + 1, {}
        for node in level:
            for other, rel in into[node]:
                if other != root and other not in found:
                    nxt[other] = min(rel, nxt.get(other, rel))
        found.update({n: (r, depth) for n, r in nxt.items()})
        level = set(nxt)
    return sorted(((n, r, d) for n, (r, d) in found.items()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_walks_equal_plain_search(spark, rows, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(60)]
    data = [(rng.choice(nodes), rng.choice(nodes[: rng.choice([3, 60])]), rng.choice("xyz")) for _ in range(150)]
    e = spark.createDataFrame(data, "`from` string, `to` string, rel string")
    for root in ("n0", "n7"):
        expected = _brute(data, root, 6)
        assert rows(traverse.impact(e, root, 6)) == expected
        assert rows(traverse.related_multi(e, root, None, 6)) == _brute(data, root, 6, forward=True)
    layout = write_layout(e, f"{spark.conf.get('spark.checkpoint.dir')}/layout{seed}", "to", 4)
    assert rows(traverse.impact(layout, "n0", 6)) == _brute(data, "n0", 6)
    many = traverse.impact_many(e, spark.createDataFrame([(n,) for n in nodes[:5]] + [("n0",)], "path string"), 4)
    expected = sorted(((r, *row) for r in nodes[:5] for row in _brute(data, r, 4)), key=repr)
    assert rows(many.select("root", "path", "relation", "depth")) == expected


def test_depth_limit_is_reported(edges):
    chain = edges(*zip("abc", "bcd"))
    assert traverse.walk(chain, "d", 2).max_depth_reached
    assert traverse.walk(chain, "d", 3).max_depth_reached
    assert not traverse.walk(chain, "d", 4).max_depth_reached
    assert traverse.impact_summary(chain, "d", 9).first()[:] == ("d", 3, False)


def test_chain_brings_start_back(edges, rows):
    assert rows(traverse.transitive_chain(edges(("a", "b"), ("b", "c"), ("c", "a")), "a", 9)) == [("a", 3), ("b", 1), ("c", 2)]


def test_deep_chain(spark):
    chain = spark.range(40).select(
        F.concat(F.lit("f"), "id").alias("from"), F.concat(F.lit("f"), F.col("id") + 1).alias("to"), F.lit("imports").alias("rel")
    )
    assert traverse.impact(chain, "f40", 40).agg(F.count("*"), F.max("depth")).first()[:] == (40, 40)


def _layers(rng, levels, width, back):
    """A deep graph: hops lead to the next layer, and `back` of them to any earlier one."""
    out = []
    for level in range(1, levels):
        for i in range(width):
            to = level - 1 if rng.random() >= back else rng.randrange(level)
            out.append((f"v{level}.{i}", f"v{to}.{rng.randrange(width) if level > 1 else 0}", rng.choice("xyz")))
            out.append((f"v{to}.{i}", f"v{level}.{i}", rng.choice("xyz")) if rng.random() < back else out[-1])
    return out


@pytest.mark.parametrize(("seed", "width", "back", "growth"), [(1, 2, 0.1, 4), (2, 3, 0.05, 64), (3, 3, 0.0, 0)])
def test_deep_walks_equal_plain_search(spark, rows, monkeypatch, seed, width, back, growth):
    # With growth 0 the walk keeps to single hops; the rows stay the same.
    monkeypatch.setattr(traverse, "POWER_GROWTH", growth)
    rng = random.Random(seed)
    data = _layers(rng, 12 if growth == 0 else 30, width, back)
    e = spark.createDataFrame(data, "`from` string, `to` string, rel string")
    assert rows(traverse.impact(e, "v0.0", 99)) == _brute(data, "v0.0", 99)
    done = traverse.walk(e, "v0.0", 12)
    expected = _brute(data, "v0.0", 12)
    assert (done.total, done.max_depth_reached) == (len(expected), any(r[2] == 12 for r in expected))
    many = traverse.impact_many(e, spark.createDataFrame([("v0.0",), ("v3.0",)], "path string"), 99)
    assert rows(many.select("root", "path", "relation", "depth")) == sorted(
        ((r, *row) for r in ("v0.0", "v3.0") for row in _brute(data, r, 99)), key=repr
    )


def test_deep_walks_across_repositories_on_layouts_and_round_cycles(spark, rows):
    ring = [(f"r/f{(i + 1) % 21}", f"external:r:f{i}" if i % 2 else f"r/f{i}", "imports") for i in range(21)]
    e = spark.createDataFrame(ring, "`from` string, `to` string, rel string")
    assert [r[2] for r in sorted(rows(traverse.impact(e, "r/f0", 99, external=True)), key=lambda r: r[2])] == list(range(1, 21))
    plain = [(f"f{(i + 1) % 21}", f"f{i}", "imports") for i in range(21)]
    e = spark.createDataFrame(plain, "`from` string, `to` string, rel string")
    assert sorted(r[1] for r in rows(traverse.transitive_chain(e, "f0", 99))) == list(range(1, 22))
    layout = write_layout(e, f"{spark.conf.get('spark.checkpoint.dir')}/ring", "to", 4)
    assert rows(traverse.impact(layout, "f0", 15)) == _brute(plain, "f0", 15)


def test_a_long_chain_takes_few_steps(spark, monkeypatch):
    steps, store = [], traverse.scratch.store
    monkeypatch.setattr(traverse.scratch, "store", lambda df, folder: (steps.append(folder), store(df, folder))[1])
    chain = spark.range(300).select(F.format_string("f%d", "id").alias("from"), F.format_string("f%d", F.col("id") + 1).alias("to"), F.lit("x").alias("rel"))
    assert traverse.walk(chain, "f300", 300).total == 300
    assert len(steps) <= 30


def test_powers_leave_out_names_where_hops_end(spark, monkeypatch):
    # A chain of 40 names, and six others on each of them, some by an edge without a relation.
    data = [(f"v{i + 1}", f"v{i}", "follows") for i in range(40)]
    data += [(f"leaf{i}-{k}", f"v{i}", rel) for i in range(40) for k in range(6) for rel in ([None, "in"] if k else ["on", "in"])]
    stored, materialize = [], traverse.scratch.materialize

    def counted(df, label):
        out = materialize(df, label)
        stored.append((label, out.count()))
        return out

    monkeypatch.setattr(traverse.scratch, "materialize", counted)
    got = traverse.impact(spark.createDataFrame(data, "`from` string, `to` string, rel string"), "v0", 1 << 30).collect()
    expected = [(f"v{i + 1}", "follows", i + 1) for i in range(40)] + [(f"leaf{i}-{k}", "in", i + 1) for i in range(40) for k in range(6)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert len(stored) > 3 and all(label == "power" and n <= 40 for label, n in stored)


def test_stats(edges, rows):
    e = edges(("a.go", "fmt"), ("b.go", "fmt"), ("c.go", "os"))
    assert graph.graph_stats(e).first()[:3] == (3, 3, 2)
    top = edges(("a.go", "std:fmt"), ("b.go", "std:fmt"), ("c.go", "std:fmt"), ("a.go", "std:os"))
    assert rows(graph.top_dependencies(top, 1)) == [("std:fmt", 3)]
    empty = graph.graph_stats(edges()).first()
    assert empty[:3] == (0, 0, 0) and empty["top_dependencies"] == []


def test_related_and_directions(edges, rows):
    e = edges(("a", "b"), ("c", "b", "tests"))
    assert rows(graph.related(e, "b", direction="REVERSE")) == [("a", "b", "imports"), ("c", "b", "tests")]
    assert rows(graph.related(e, "b", "tests", "in")) == [("c", "b", "tests")]
    assert rows(graph.related(e, "b", direction="sideways")) == []


def test_fallback_takes_first_spelling_with_edges(spark, edges, rows):
    e = edges(("x/a", "t1"), ("/home/x/b", "t2"), ("x/b", "t3"), ("./c", "t4"))
    asked = spark.createDataFrame([("/home/x/a",), ("/home/x/b",), ("././c",), ("/x/a",), ("none",)], "path string")
    assert rows(graph.related_with_fallback(e, asked).select("path", "to")) == [("/home/x/a", "t1"), ("/home/x/b", "t2"), ("/x/a", "t1")]


def test_edge_diff(edges, rows):
    assert rows(graph.edge_diff(edges(("a", "b"), ("a", "c")), edges(("a", "c"), ("a", "d")))) == [
        ("a", "b", "imports", "removed"), ("a", "d", "imports", "added"),
    ]


def test_layout_lookup_prunes_folders(spark, edges, rows):
    e = edges(*[(f"s{i}", f"t{i % 20}") for i in range(200)])
    layout = write_layout(e, f"{spark.conf.get('spark.checkpoint.dir')}/prune", "to", 16)
    wanted = spark.createDataFrame([("t3",)], "path string")
    found = lookup(layout, spark, wanted)
    assert len(found.collect()) == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan


def test_flag_external(spark, edges, rows):
    mounts = spark.createDataFrame([("shared-lib", "/mnt/shared-lib/")], "source string, at string")
    e = edges(("a", "shared-lib//pkg/u.go"), ("a", "shared-lib-extra/main.go"), ("a", "shared-lib"), ("a", "std:fmt"))
    assert [r[1] for r in rows(associate.flag_external(e, mounts))] == [
        "external:shared-lib:pkg/u.go", "shared-lib", "shared-lib-extra/main.go", "std:fmt",
    ]


def test_rendered_relations_have_one_shape(edges):
    e = edges(*[("hub", f"t{i:05d}") for i in range(12_000)], ("a", "b"), ("a", "b"), ("a", "external:r:x"))
    texts = {r["path"]: r["text"] for r in reports.render_relations(e).collect()}
    assert texts == {"hub": "|".join(f"imports:t{i:05d}" for i in range(12_000)), "a": "external:r:x|imports:b"}
    assert reports.relation_entries(e).count() == 12_002


def test_extension_edges(spark, rows):
    files = spark.createDataFrame([("docs/a/b.md",), ("docs/b.md",), ("src/a/b.go",), ("src/x/b.go",)], "path string")
    found = associate.extension_edges(files, "docs/**/*.md", "src/**/*.go", "documented_by")
    assert rows(found) == [("docs/a/b.md", "src/a/b.go", "documented_by")]
