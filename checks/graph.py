"""Registered queries: edge tables, walks and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import edge_view, table, view, with_views
from depscope import scratch
from depscope.operators import associate, extract, graph, reports
from depscope.plans import rules, traverse
from depscope.sources import edges as edge_tables
from depscope.sources.layout import lookup, write_layout
from depscope.sources.tables import query_inventory

EDGES = with_views("fx_edges")
COLUMNS = 'src AS "from", dst AS "to", rel'

QUERIES, ORACLES = {}, {}


def _register(name, query, oracle=None):
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


# -- lookups and counts ------------------------------------------------------
_register(
    "related_forward", lambda s, d: graph.related(edge_view(s, d), "o:7", "contains"),
    f"{EDGES} SELECT {COLUMNS} FROM fx_edges WHERE src = 'o:7' AND rel = 'contains'",
)
_register(
    "related_reverse", lambda s, d: graph.related(edge_view(s, d), "n:3", direction="Incoming"),
    f"{EDGES} SELECT {COLUMNS} FROM fx_edges WHERE dst = 'n:3'",
)
_register(
    "related_many",
    lambda s, d: graph.related_many(
        edge_view(s, d), table(s, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("path")), direction="reverse"
    ),
    f"{EDGES} SELECT dst AS path, {COLUMNS} FROM fx_edges WHERE dst IN (SELECT concat('p:', p_partkey) FROM part)",
)
_register(
    "in_graph",
    lambda s, d: graph.in_graph(
        edge_view(s, d), table(s, d, "lineitem").select(F.concat(F.lit("o:"), F.col("l_orderkey") + F.col("l_suppkey")).alias("path"))
    ),
    f"""{EDGES}, wanted AS (SELECT DISTINCT concat('o:', l_orderkey + l_suppkey) AS path FROM lineitem)
    SELECT path, path IN (SELECT src FROM fx_edges UNION SELECT dst FROM fx_edges) AS in_graph FROM wanted""",
)
_register(
    "related_with_fallback",
    lambda s, d: graph.related_with_fallback(
        edge_view(s, d),
        table(s, d, "orders").select(F.concat(
            F.element_at(F.array(F.lit("/home/"), F.lit("./"), F.lit("/"), F.lit("")), (F.col("o_custkey") % 4 + 1).cast("int")),
            F.lit("o:"), "o_orderkey",
        ).alias("path")),
        direction="forward",
    ),
    f"""{EDGES} SELECT concat(CASE o_custkey % 4 WHEN 0 THEN '/home/' WHEN 1 THEN './' WHEN 2 THEN '/' ELSE '' END, 'o:', o_orderkey) AS path,
    {COLUMNS} FROM orders JOIN fx_edges ON src = concat('o:', o_orderkey)""",
)
_register(
    "external_edges", lambda s, d: graph.external_edges(edge_view(s, d, "fx_cross_repo")),
    f"{with_views('fx_cross_repo')} SELECT {COLUMNS} FROM fx_cross_repo WHERE dst LIKE 'external:%'",
)
_register(
    "local_targets", lambda s, d: graph.local_targets(edge_view(s, d, "fx_cross_repo"), exclude_external=True),
    f"""{with_views('fx_cross_repo')} SELECT DISTINCT dst AS "to" FROM fx_cross_repo WHERE dst NOT LIKE 'external:%'""",
)
_register(
    "count_edges", lambda s, d: graph.count_edges(edge_view(s, d)),
    f"{EDGES} SELECT count(*) AS total_edges FROM fx_edges",
)
_register(
    "group_by_dependency", lambda s, d: graph.group_by_dependency(edge_view(s, d)),
    f'{EDGES} SELECT dst AS "to", rel, count(*) AS cnt FROM fx_edges GROUP BY dst, rel',
)
_register(
    "distinct_files", lambda s, d: graph.distinct_files(edge_view(s, d)),
    f"{EDGES} SELECT DISTINCT 'from' AS side, src AS path FROM fx_edges UNION ALL SELECT DISTINCT 'to', dst FROM fx_edges",
)
_register(
    "top_dependencies", lambda s, d: graph.top_dependencies(edge_view(s, d), 10),
    f'{EDGES} SELECT dst AS "to", count(*) AS cnt FROM fx_edges GROUP BY dst ORDER BY cnt DESC, dst LIMIT 10',
)
_register(
    "graph_stats",
    # The list of top targets is flattened to text for the value comparison.
    lambda s, d: graph.graph_stats(edge_view(s, d)).withColumn(
        "top_dependencies",
        F.array_join(F.transform("top_dependencies", lambda t: F.concat(t["to"], F.lit("="), t["cnt"].cast("string"))), ","),
    ),
    f"""{EDGES}, top AS (SELECT dst, count(*) AS cnt FROM fx_edges GROUP BY dst ORDER BY cnt DESC, dst LIMIT 10)
    SELECT count(*) AS total_edges, count(DISTINCT src) AS unique_files, count(DISTINCT dst) AS unique_dependencies,
    (SELECT string_agg(concat(dst, '=', cnt), ',' ORDER BY cnt DESC, dst) FROM top) AS top_dependencies FROM fx_edges""",
)
_register(
    "edge_diff",
    lambda s, d: graph.edge_diff(
        edge_view(s, d).where("rel <> 'in'"), edge_view(s, d).where("rel <> 'placed_by'")
    ),
    f"""{EDGES} SELECT {COLUMNS}, CASE rel WHEN 'in' THEN 'added' ELSE 'removed' END AS change FROM fx_edges WHERE rel IN ('in', 'placed_by')""",
)
_register(
    "inverse_edges", lambda s, d: associate.inverse_edges(edge_view(s, d, "fx_cross_repo")),
    f"""{with_views('fx_cross_repo')} SELECT dst AS "from", src AS "to", 'imported_by' AS rel FROM fx_cross_repo WHERE rel = 'imports'""",
)
_register(
    "nodes", lambda s, d: edge_tables.nodes(edge_view(s, d)),
    f"{EDGES} SELECT src AS path FROM fx_edges UNION SELECT dst FROM fx_edges",
)


# -- sources and sinks -------------------------------------------------------
def _json_round_trip(s, d):
    folder = scratch.new_folder(s, "edges-json")
    edge_tables.write_edges(edge_view(s, d), folder, max_edges_per_file=5000)
    return edge_tables.read_edges(s, folder)


def _append_dedup(s, d):
    folder = scratch.new_folder(s, "edges-json")
    edge_tables.write_edges(edge_view(s, d).where("rel = 'contains'"), folder)
    edge_tables.append_edges_dedup(edge_view(s, d).unionByName(edge_view(s, d)), folder)
    return edge_tables.read_edges(s, folder).groupBy("rel").agg(F.count("*").alias("edges"))


def _upsert(s, d):
    folder = scratch.new_folder(s, "edges-table")
    edges = edge_view(s, d)
    for part in (edges.where("rel <> 'in'"), edges, edges):
        edge_tables.upsert_edges(part, folder)
    return edge_tables.read_edge_table(s, folder)


def _layout_lookup(s, d):
    layout = write_layout(edge_view(s, d), scratch.new_folder(s, "layout"), "to", 16)
    wanted = table(s, d, "supplier").select(F.concat(F.lit("p:"), "s_suppkey").alias("path"))
    return lookup(layout, s, wanted)


_register("edges_json_round_trip", _json_round_trip, f"{EDGES} SELECT {COLUMNS} FROM fx_edges")
_register("append_edges_dedup", _append_dedup, f"{EDGES} SELECT rel, count(*) AS edges FROM fx_edges GROUP BY rel")
_register("upsert_edges", _upsert, f"{EDGES} SELECT {COLUMNS} FROM fx_edges")
_register(
    "edge_layout_lookup", _layout_lookup,
    f"{EDGES} SELECT {COLUMNS} FROM fx_edges WHERE dst IN (SELECT concat('p:', s_suppkey) FROM supplier)",
)
_register(
    "query_inventory",
    lambda s, d: query_inventory(
        s, "SELECT e.`from`, e.`to`, b.hash FROM edges e JOIN blobs b ON e.`to` = b.path WHERE e.rel = :rel", {"rel": "placed_by"},
        edges=edge_view(s, d),
        blobs=table(s, d, "documents").select(F.concat(F.lit("c:"), "doc_id").alias("path"), F.md5("text").alias("hash")),
    ),
    f"""{EDGES} SELECT src AS "from", dst AS "to", md5(text) AS hash FROM fx_edges JOIN documents ON dst = concat('c:', doc_id) WHERE rel = 'placed_by'""",
)
_register(
    "link_edges", lambda s, d: extract.link_edges(table(s, d, "pages")),
    """SELECT url AS "from", unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS "to", 'links' AS rel FROM pages""",
)


# -- walks -------------------------------------------------------------------
def _walk_oracle(head, edges, seed, depth, at="dst", nxt="src", where="true", tail=""):
    """Names within a number of hops, with the smallest depth and the smallest relation of that depth."""
    return f"""{head}, walk(root, path, depth) AS (
      {seed}
      UNION
      SELECT w.root, e.{nxt}, w.depth + 1 FROM walk w JOIN {edges} e ON e.{at} = w.path WHERE w.depth < {depth} AND {where}
    ), best AS (SELECT root, path, min(depth) AS depth FROM walk GROUP BY root, path)
    SELECT b.root, b.path, min(e.rel) AS relation, CAST(b.depth AS INTEGER) AS depth
    FROM best b JOIN {edges} e ON e.{nxt} = b.path JOIN best p ON p.root = b.root AND p.path = e.{at} AND p.depth = b.depth - 1
    WHERE b.path <> b.root AND {where} GROUP BY b.root, b.path, b.depth {tail}"""


RING = with_views("fx_ring", recursive=True)
_ONE = "SELECT 'r:1', 'r:1', 0"
_IMPACT = _walk_oracle(RING, "fx_ring", _ONE, 5)

_register("impact", lambda s, d: traverse.impact(edge_view(s, d, "fx_ring"), "r:1", 5), f"SELECT path, relation, depth FROM ({_IMPACT})")
_register(
    "impact_wide_steps", lambda s, d: traverse.walk(edge_view(s, d, "fx_ring"), "r:1", 5).rows.drop("root"),
    f"SELECT path, relation, depth FROM ({_IMPACT})",
)
# As many levels as there are orders; the keys are gapless, so a depth is a difference of keys.
_register(
    "impact_deep", lambda s, d: traverse.impact(edge_view(s, d, "fx_deep"), "q:0", 1 << 30),
    """SELECT concat('q:', o_orderkey + 1) AS path, 'follows' AS relation, CAST(o_orderkey + 1 AS INTEGER) AS depth FROM orders
    UNION ALL SELECT DISTINCT concat('l:', l_orderkey, ':', l_linenumber), 'in', CAST(l_orderkey + 1 AS INTEGER) FROM lineitem""",
)
_register(
    "impact_on_layout",
    lambda s, d: traverse.impact(write_layout(edge_view(s, d, "fx_ring"), scratch.new_folder(s, "layout"), "to", 16), "r:1", 3),
    f"SELECT path, relation, depth FROM ({_walk_oracle(RING, 'fx_ring', _ONE, 3)})",
)
_register(
    "impact_many",
    lambda s, d: traverse.impact_many(edge_view(s, d), table(s, d, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("path")), 5),
    _walk_oracle(
        with_views("fx_edges", recursive=True), "fx_edges",
        "SELECT concat('n:', n_nationkey), concat('n:', n_nationkey), 0 FROM nation", 5,
    ),
)
_register(
    "related_multi", lambda s, d: traverse.related_multi(edge_view(s, d, "fx_ring"), "o:11", ["placed_by", "in", "next"], 6),
    "SELECT path, relation, depth FROM (" + _walk_oracle(
        RING, "fx_ring", "SELECT 'o:11', 'o:11', 0", 6, "src", "dst", "e.rel IN ('placed_by', 'in', 'next')"
    ) + ")",
)
_register(
    "transitive_chain", lambda s, d: traverse.transitive_chain(edge_view(s, d, "fx_ring"), "r:2", 7),
    f"""{RING}, chain(name, depth) AS (
      SELECT dst, 1 FROM fx_ring WHERE src = 'r:2'
      UNION SELECT e.dst, c.depth + 1 FROM fx_ring e JOIN chain c ON e.src = c.name WHERE c.depth < 7
    ) SELECT name AS "to", CAST(min(depth) AS INTEGER) AS depth FROM chain GROUP BY name""",
)
_register(
    "impact_external", lambda s, d: traverse.impact(edge_view(s, d, "fx_cross_repo"), "places/n3.go", 4, external=True),
    f"""{with_views('fx_cross_repo', recursive=True)}, names AS (
      SELECT src, dst, rel, unnest(list_concat([concat('=', dst)], list_transform(range(2, len(string_split(dst, ':')) + 1),
        lambda i: concat(':', array_to_string(list_slice(string_split(dst, ':'), i, -1), ':'))))) AS name FROM fx_cross_repo
    ), hop AS (SELECT name, src, rel FROM names), walk(path, depth) AS (
      SELECT 'places/n3.go', 0
      UNION
      SELECT h.src, w.depth + 1 FROM (
        SELECT depth, unnest([concat('=', path), concat(':', regexp_replace(path, '^([^/]*)/', '\\1:'))]) AS name FROM walk WHERE depth < 4
      ) w JOIN hop h ON h.name = w.name
    ), best AS (SELECT path, min(depth) AS depth FROM walk GROUP BY path),
    found AS (SELECT depth, unnest([concat('=', path), concat(':', regexp_replace(path, '^([^/]*)/', '\\1:'))]) AS name FROM best)
    SELECT b.path, min(h.rel) AS relation, CAST(b.depth AS INTEGER) AS depth FROM best b JOIN hop h ON h.src = b.path
    JOIN found p ON p.depth = b.depth - 1 AND h.name = p.name
    WHERE b.depth > 0 GROUP BY b.path, b.depth""",
)
_register(
    "impact_json", lambda s, d: traverse.as_json(traverse.impact(edge_view(s, d, "fx_ring"), "r:1", 5)),
    f"""SELECT concat('{{"path":"', path, '","relation":"', relation, '","depth":', depth, '}}') AS json FROM ({_IMPACT})""",
)
_register(
    "impact_summary", lambda s, d: traverse.impact_summary(edge_view(s, d, "fx_ring"), "r:1", 5),
    f"SELECT 'r:1' AS start, count(*) AS total, bool_or(depth = 5) AS max_depth_reached FROM ({_IMPACT})",
)
_register(
    "render_impact",
    lambda s, d: reports.render_impact(traverse.impact_many(
        edge_view(s, d), table(s, d, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("path")), 2
    )),
    f"""{EDGES} SELECT dst AS path, string_agg(concat('external:', src), '|' ORDER BY src) AS text
    FROM fx_edges WHERE dst LIKE 'c:%' GROUP BY dst""",
)
_register(
    "render_relations", lambda s, d: reports.render_relations(edge_view(s, d)),
    f"""{EDGES} SELECT src AS path, string_agg(concat(rel, ':', dst), '|' ORDER BY concat(rel, ':', dst)) AS text
    FROM fx_edges GROUP BY src""",
)

_register(
    "relation_entries", lambda s, d: reports.relation_entries(edge_view(s, d)),
    f"{EDGES} SELECT DISTINCT src AS path, concat(rel, ':', dst) AS entry FROM fx_edges",
)

# -- rules -------------------------------------------------------------------
COUNT_BY_RELATION = rules.Rule("count-by-relation", "SELECT rel, COUNT(*) AS n FROM edges GROUP BY rel")
BROKEN = rules.Rule("broken", "SELECT nothing FROM edges")


def _stale(s, d):
    return rules.check_rule(s, rules.STALE_FILES, file_registry=view(s, d, "fx_registry")).rows


def _untested(s, d):
    edges = edge_view(s, d)
    imports = edges.withColumn("rel", F.lit("imports"))
    tested = table(s, d, "part").where("p_size < 10").select(
        F.concat(F.lit("p:"), "p_partkey").alias("from"), F.lit("t").alias("to"), F.lit("tested_by").alias("rel")
    )
    return rules.query(s, rules.UNTESTED_CRITICAL, edges=imports.unionByName(tested))


def _check_all(s, d):
    done = rules.check_all(s, [COUNT_BY_RELATION, BROKEN], edges=edge_view(s, d))
    return done.select("rule", "ok", F.array_join("row", ",").alias("row"), F.col("error").isNotNull().alias("failed"))


_register(
    "rule_stale_files", _stale,
    f"""{with_views('fx_registry')} SELECT path, last_modified, last_tested FROM fx_registry
    WHERE last_modified > last_tested OR last_tested IS NULL""",
)
_register(
    "rule_untested_critical", _untested,
    f"""{EDGES} SELECT dst AS file, count(*) AS dependents FROM fx_edges
    WHERE dst NOT IN (SELECT concat('p:', p_partkey) FROM part WHERE p_size < 10) GROUP BY dst HAVING count(*) > 5""",
)
_register(
    "rule_check_all", _check_all,
    f"""{EDGES} SELECT 'count-by-relation' AS rule, true AS ok, concat(rel, ',', count(*)) AS row, false AS failed FROM fx_edges GROUP BY rel
    UNION ALL SELECT 'broken', false, NULL, true""",
)

# -- reports -----------------------------------------------------------------
_register(
    "most_connected", lambda s, d: reports.most_connected(edge_view(s, d), 20),
    f"""{EDGES} SELECT path, count(*) AS degree FROM (SELECT src AS path FROM fx_edges UNION ALL SELECT dst FROM fx_edges)
    GROUP BY path ORDER BY degree DESC, path LIMIT 20""",
)
_register(
    "edge_types", lambda s, d: reports.edge_types(edge_view(s, d)),
    f"{EDGES} SELECT rel, count(*) AS cnt FROM fx_edges GROUP BY rel",
)
