"""Input tables of the registered queries, derived from the given Parquet tables.

Most are one SQL text that Spark and DuckDB both run; the oracles put it in front
of their own query as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from depscope import scratch

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: str) -> str:
    return f"CAST({value} AS VARCHAR(20))"


# A layered graph: region <- nation <- customer, supplier <- order -> part.
FX_EDGES = f"""
SELECT DISTINCT src, dst, rel FROM (
  SELECT concat('o:', {_text('o_orderkey')}) AS src, concat('c:', {_text('o_custkey')}) AS dst, 'placed_by' AS rel FROM orders
  UNION ALL SELECT concat('c:', {_text('c_custkey')}), concat('n:', {_text('c_nationkey')}), 'in' FROM customer
  UNION ALL SELECT concat('s:', {_text('s_suppkey')}), concat('n:', {_text('s_nationkey')}), 'in' FROM supplier
  UNION ALL SELECT concat('n:', {_text('n_nationkey')}), concat('r:', {_text('n_regionkey')}), 'in' FROM nation
  UNION ALL SELECT concat('o:', {_text('l_orderkey')}), concat('p:', {_text('l_partkey')}), 'contains' FROM lineitem
) e
"""

# The same graph with a ring of regions.
FX_RING = f"""
SELECT src, dst, rel FROM ({FX_EDGES}) g
UNION ALL
SELECT concat('r:', {_text('r_regionkey')}), concat('r:', {_text('(r_regionkey + 1) % 5')}), 'next' FROM region
"""

# A deep graph: each order file follows the one before, and line files hang on both their order and the next.
FX_DEEP = f"""
SELECT concat('q:', {_text('o_orderkey + 1')}) AS src, concat('q:', {_text('o_orderkey')}) AS dst, 'follows' AS rel FROM orders
UNION ALL SELECT concat('l:', {_text('l_orderkey')}, ':', {_text('l_linenumber')}), concat('q:', {_text('l_orderkey')}), 'in' FROM lineitem
UNION ALL SELECT concat('l:', {_text('l_orderkey')}, ':', {_text('l_linenumber')}), concat('q:', {_text('l_orderkey + 1')}), 'after' FROM lineitem
"""

# Paths in repositories: an order file refers to its customer's file, in another repository as an external target.
FX_CROSS_REPO = f"""
SELECT DISTINCT src, dst, rel FROM (
  SELECT concat('orders/o', {_text('o_orderkey')}, '.go') AS src,
         CASE o_custkey % 3 WHEN 0 THEN concat('external:people:c', {_text('o_custkey')}, '.go')
           WHEN 1 THEN concat('people/c', {_text('o_custkey')}, '.go')
           ELSE concat('local:c', {_text('o_custkey')}, '.go') END AS dst,
         'imports' AS rel
  FROM orders
  UNION ALL
  SELECT concat('people/c', {_text('c_custkey')}, '.go'), concat('external:places:n', {_text('c_nationkey')}, '.go'), 'imports' FROM customer
  UNION ALL
  SELECT concat('lines/', {_text('l_linenumber')}, '.go'), concat('orders/o', {_text('l_orderkey')}, '.go'), 'uses' FROM lineitem
) e
"""

_LINES = {
    0: ("go", [
        "'package m'", "'import \"fmt\"'", "'import ('", "concat(chr(9), '\"os\"')",
        f"concat(chr(9), 'x \"example.org/p', {_text('o_custkey')}, '\"')", "')'",
        "CASE o_custkey % 4 WHEN 0 THEN 'func main() {}' WHEN 1 THEN 'func Run() {}' ELSE 'func run() {}' END",
    ]),
    1: ("py", [
        "'import os, sys as s'", f"concat('from pkg_', {_text('o_custkey')}, ' import a')", "'    import json'",
        "CASE o_custkey % 4 WHEN 0 THEN 'if __name__ == \"__main__\":' WHEN 1 THEN 'def f(): pass' ELSE 'x = 1' END",
    ]),
    2: ("ts", [
        f"concat('import a from \"./m', {_text('o_custkey')}, '\"')", "'import {'", "'  b,'", "'} from \"lib\"'", "'import \"side\"'",
        "CASE o_custkey % 4 WHEN 0 THEN 'export default a' WHEN 1 THEN 'export const c = 1' ELSE 'let d = 2' END",
    ]),
    3: ("rs", [
        "'use std::io;'", f"concat('pub use dep', {_text('o_custkey')}, '::x;')", "'use crate::y;'", "'extern crate libc;'",
        "CASE o_custkey % 4 WHEN 0 THEN 'fn main() {}' WHEN 1 THEN concat('pub fn a() {}', chr(10), 'pub async fn b() {}', chr(10), '  pub fn c() {}')"
        " ELSE 'pub fn f() {}' END",
    ]),
    4: ("js", [
        f"concat('const a = require(\"lib', {_text('o_custkey')}, '\")')", "'const b = require( \"/abs\" )'",
        "CASE o_custkey % 4 WHEN 0 THEN 'module.exports = a' WHEN 1 THEN 'export { a }' ELSE 'a()' END",
    ]),
    5: ("java", [
        "'import java.util.List;'", f"concat('import static a.b', {_text('o_custkey')}, '.C;')",
        "CASE o_custkey % 4 WHEN 0 THEN 'public static void main(String[] a) {}' WHEN 1 THEN 'public class C {}' ELSE 'class D {}' END",
    ]),
    6: ("c", [
        "'#include <stdio.h>'", f"concat('#include \"h', {_text('o_custkey')}, '.h\"')",
        "CASE o_custkey % 4 WHEN 0 THEN 'int main(void) { return 0; }' WHEN 1 THEN 'int f(int); int g(int);' ELSE 'int x;' END",
    ]),
    7: ("cpp", [
        "'#include <vector>'", f"concat('  #include \"h', {_text('o_custkey')}, '.hpp\"')",
        "CASE o_custkey % 4 WHEN 0 THEN 'void main() {}' WHEN 1 THEN 'int f(int); int g(int);' ELSE 'int main();' END",
    ]),
    8: ("rb", [
        "'require \"json\"'", f"concat('require \"gem', {_text('o_custkey')}, '\"')", "'require_relative \"near\"'",
        "CASE o_custkey % 4 WHEN 0 THEN '#!/usr/bin/env ruby' WHEN 1 THEN concat('module M', chr(10), 'def f; end') ELSE 'puts 1' END",
    ]),
}
_CONTENT = " ".join(f"WHEN {k} THEN concat_ws(chr(10), {', '.join(lines)})" for k, (_, lines) in _LINES.items())
_EXTENSION = " ".join(f"WHEN {k} THEN '{ext}'" for k, (ext, _) in _LINES.items())
_FOLDER = (
    "CASE o_custkey % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'lib' WHEN 2 THEN 'examples' WHEN 3 THEN 'scripts'"
    " WHEN 4 THEN 'src/vendor' ELSE 'src/auth' END"
)
_TEST_NAME = (
    "CASE o_orderkey % 9 WHEN 0 THEN concat(m, '_test.go') WHEN 1 THEN concat('test_', m, '.py') WHEN 2 THEN concat(m, '.spec.ts')"
    " WHEN 3 THEN concat(m, '_test.rs') WHEN 4 THEN concat('test_', m, '.js') WHEN 5 THEN concat(m, 'Test.java')"
    " WHEN 6 THEN concat('test_', m, '.c') WHEN 7 THEN concat(m, '_test.cpp') ELSE concat(m, '_test.rb') END"
)
_ORDERS = f"""(SELECT o_orderkey, o_custkey, o_orderpriority, concat('mod_', {_text('o_orderkey')}) AS m,
  concat('repo', {_text('o_custkey % 7')}, '/', {_FOLDER}, '/') AS folder FROM orders) o"""

# One source file per order, in nine languages, and a test file for every fifth.
FX_FILES = f"""
SELECT concat(folder, m, '.', CASE o_orderkey % 9 {_EXTENSION} END) AS path,
       concat(CASE WHEN o_orderpriority = '1-URGENT' THEN concat('DO NOT EDIT', chr(10)) ELSE '' END,
              CASE o_orderkey % 9 {_CONTENT} END, chr(10)) AS content
FROM {_ORDERS}
UNION ALL
SELECT concat(folder, {_TEST_NAME}) AS path, 'x' AS content FROM {_ORDERS} WHERE o_orderkey % 5 = 0
"""

# Per language: an extension, a text in which `{n}` is the customer's number and `~` a line break, and the targets it imports (`_` is a space).
_TRICKY = [
    ("go", """package m~x := `~import "fake"~`~// import "fake"~/* import "fake"~*/ import "fmt"; import "example.org/p{n}"~s := "x; import (fake)"~c := '"'~import (~y "os" // "fake"~)~""",
     "std:fmt pkg:example.org/p{n} std:os"),
    ("py", """s = "x; import fake"~t = 'a: import fake'~u = \"\"\"~import fake~\"\"\"~# import fake~import m{n} as q, os; from lib{n} import (a,~b)~v = f"{{x}}; import fake"~if x: import late~""",
     "pkg:m{n} pkg:os pkg:lib{n} pkg:late"),
    ("ts", """const t = `~import a from "fake"~${{ f({{ k: "}}", g: `}} ${{1}}` }}) }}~import b from "fake"~`~// import c from 'fake'~import d from "./m{n}"~import {{~e,~}} from 'lib{n}'; import 'side'~const u = "import f from 'fake'"~""",
     "local:./m{n} pkg:lib{n} pkg:side"),
    ("js", """/* require('fake') */ const a = require("lib{n}"), b = require( '/abs' )~const s = "require('fake')", t = `${{x}} require('fake')`~""", "pkg:lib{n} local:/abs"),
    ("rs", """use {{a{n}::b, c::{{d, e::{{f}}}}, self::g}};~use ::std::io;~/* /* use fake; */ use fake; */~let s = r#"~use fake;~"x" "#;~let c = '"'; use d{n}::x;~let t = "~use fake;~";~fn f<'a>(x: &'a str) {{}}~pub(crate) use h::{{i,~j}};~extern crate libc;~""",
     "pkg:a{n} pkg:c pkg:std pkg:d{n} pkg:h pkg:libc"),
    ("java", """import a.B{n}; import c.D; // import fake.X;~String s = "~import fake.Y;~";~String t = \"\"\"~import fake.Z;~\"\"\";~char c = '"';~import static e.F.*;~""".replace('"~import fake.Y;~"', '"import fake.Y;"'),
     "pkg:a.B{n} pkg:c.D pkg:static_e.F.*"),
    ("c", """/*~#include <fake.h>~*/~#include <stdio.h> // "x~char c = '"';~#include "h{n}.h"~char *s = "\\~#include <no>";~""".replace('"\\\\~#include <no>"', '"#include <no>"'), "sys:stdio.h local:h{n}.h"),
    ("cpp", """auto s = R"x(~#include <fake>~)" )x";~#include <vector>~  #  include "h{n}.hpp"~""", "sys:vector local:h{n}.hpp"),
    ("rb", """=begin~require 'fake'~=end~require 'json'~x = <<~~T~require 'fake'~T~# require 'fake'~require "gem{n}"~s = "#{{y}}; require 'fake'"~__END__~require 'fake'~""", "pkg:json pkg:gem{n}"),
]


def _tricky_case(pick) -> str:
    def sql(text: str) -> str:
        lines = text.replace("~~", chr(1)).replace("~", chr(10)).replace(chr(1), "~").replace("{{", "{").replace("}}", "}")
        # The engines read quotes and backslashes in literals differently.
        for mark in ("'", "\\", chr(10)):
            lines = lines.replace(mark, f"{chr(2)}{ord(mark)}{chr(3)}")
        joined = f", {_text('o_custkey')}, ".join(f"'{part}'" for part in lines.split("{n}"))
        joined = joined.replace(chr(2), "', chr(").replace(chr(3), "), '")
        return f"concat({joined})"

    return " ".join(f"WHEN {k} THEN {sql(pick(row))}" for k, row in enumerate(_TRICKY))


FX_TRICKY_FILES = f"""
SELECT concat('src/t', {_text('o_orderkey')}, '.', CASE o_orderkey % 9 {" ".join(f"WHEN {k} THEN '{row[0]}'" for k, row in enumerate(_TRICKY))} END) AS path,
       CASE o_orderkey % 9 {_tricky_case(lambda row: row[1])} END AS content,
       CASE o_orderkey % 9 {_tricky_case(lambda row: row[2].replace(' ', '|').replace('_', ' '))} END AS expected
FROM orders
"""

FX_EVENTS = f"""
SELECT event_id,
       concat('src/m', {_text('user_id % 10')}, '/f', {_text('user_id')},
         CASE user_id % 3 WHEN 0 THEN '.go' WHEN 1 THEN '.py' ELSE '.rs' END) AS path,
       CASE event_type WHEN 'view' THEN 'write' WHEN 'purchase' THEN 'write'
         WHEN 'click' THEN 'create' WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' END AS event_type,
       ts
FROM events
"""

FX_REGISTRY = f"""
SELECT concat('src/mod_', {_text('o_orderkey')}, '.py') AS path,
       MAX(l_shipdate) AS last_modified,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE MIN(l_shipdate) END AS last_tested
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_orderstatus
"""

# Metadata writes: several versions of some keys of each file.
FX_METADATA = f"""
SELECT concat('f', {_text('l_orderkey')}) AS path,
       CASE l_linenumber % 4 WHEN 0 THEN 'user.vfs.role' WHEN 1 THEN 'user.vfs.status' WHEN 2 THEN 'user.vfs.hash' ELSE 'user.other' END AS key,
       concat('v', {_text('l_partkey')}) AS value,
       l_suppkey AS version
FROM lineitem
"""
FX_UPDATES = f"""
SELECT concat('f', {_text('o_orderkey')}) AS path,
       CASE o_custkey % 2 WHEN 0 THEN 'role' ELSE 'user.vfs.status' END AS key,
       concat('u', {_text('o_custkey')}) AS value,
       CAST(o_custkey % 200 AS BIGINT) AS version
FROM orders
"""

# Paths that touch every default access rule.
FX_PATHS = f"""
SELECT concat(CASE p_partkey % 14
  WHEN 0 THEN '.git/objects/' WHEN 1 THEN 'a/vendor/' WHEN 2 THEN './src/' WHEN 3 THEN 'lib/' WHEN 4 THEN 'web/node_modules/x/'
  WHEN 5 THEN '.github/workflows/' WHEN 6 THEN 'api/' WHEN 7 THEN 'cmd/' WHEN 8 THEN 'docs/' WHEN 9 THEN '.vfs/graph/'
  WHEN 10 THEN 'srcx/' WHEN 11 THEN 'vendor/' WHEN 12 THEN './.github/' ELSE 'src/vendor/' END,
  'p', {_text('p_partkey')},
  CASE p_size % 5 WHEN 0 THEN '.lock' WHEN 1 THEN '.pb.go' WHEN 2 THEN '.go' WHEN 3 THEN '.sum' ELSE '.gen.go' END) AS path
FROM part
"""

# A rule per order: whole paths, beginnings, ends, inner parts, and a class of characters.
FX_RULES = f"""
SELECT o_orderkey AS ord, o_orderkey % 5 AS form, {_text('o_orderkey % 20011')} AS n, CAST(256 + o_custkey % 256 AS INTEGER) AS mode,
       o_custkey % 2 = 0 AS allow_delete,
       CASE o_orderkey % 5 WHEN 0 THEN concat('docs/p', {_text('o_orderkey % 20011')}, '.go') WHEN 1 THEN concat('src/p', {_text('o_orderkey % 20011')}, '*')
         WHEN 2 THEN concat('**/p', {_text('o_orderkey % 20011')}, '.sum') WHEN 3 THEN concat('**/vendor/p', {_text('o_orderkey % 20011')}, '.*')
         ELSE concat('api/p', {_text('o_orderkey % 20011')}, '[.x]go') END AS glob
FROM orders
"""

# Mounts over nations; /data/n1 is also a string prefix of /data/n12.
FX_MOUNTS = f"""
SELECT CASE n_nationkey % 3 WHEN 0 THEN 's3' WHEN 1 THEN 'remote' ELSE 'local' END AS kind,
       n_nationkey AS ord,
       concat('/data/n', {_text('n_nationkey')}) AS mount_at,
       CASE WHEN n_nationkey % 3 = 0 THEN concat('bucket', {_text('n_regionkey')}) END AS bucket,
       CASE WHEN n_nationkey % 2 = 0 THEN 'pre' END AS prefix,
       CASE WHEN n_nationkey % 3 = 1 THEN concat('https://git.example.org/n', {_text('n_nationkey')}) END AS url,
       CASE WHEN n_nationkey % 3 = 2 THEN concat('/srv/n', {_text('n_nationkey')}) END AS path,
       CASE WHEN n_nationkey % 4 <> 1 THEN '/cache' END AS cache,
       CAST(n_nationkey * 100 AS BIGINT) AS ttl,
       n_nationkey % 5 = 0 AS writable
FROM nation
"""
FX_MOUNTED_PATHS = f"""
SELECT concat(CASE WHEN c_custkey % 11 = 0 THEN '/other/n' ELSE '/data/n' END, {_text('c_nationkey')}, '/c', {_text('c_custkey')}) AS path
FROM customer
"""
FX_INVENTORY = f"""
SELECT concat('/cache/c', {_text('c_custkey')}) AS path, CAST(1700000000 + c_custkey AS BIGINT) AS mtime FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT concat('/srv/n', {_text('n_nationkey')}), CAST(1700000000 AS BIGINT) FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT concat('/work/other/n', {_text('c_nationkey')}, '/c', {_text('c_custkey')}), CAST(1700000000 AS BIGINT) FROM customer WHERE c_custkey % 22 = 0
"""

# Workspaces of nations: customers are repositories, suppliers backends, and both are mounted.
FX_REPOS = f"""
SELECT concat('w', {_text('c_nationkey')}) AS workspace, c_custkey AS ord,
       CASE WHEN c_custkey % 50 = 0 THEN '' ELSE concat('r', {_text('c_custkey % 600')}) END AS name,
       CASE WHEN c_custkey % 40 = 0 THEN '' ELSE concat('https://git.example.org/', {_text('c_custkey')}) END AS url,
       CASE WHEN c_custkey % 30 = 0 THEN '' ELSE 'main' END AS ref,
       c_custkey % 2 = 0 AS writable
FROM customer
"""
FX_BACKENDS = f"""
SELECT concat('w', {_text('s_nationkey')}) AS workspace, s_suppkey AS ord,
       concat('b', {_text('s_suppkey % 60')}) AS name,
       CASE s_suppkey % 4 WHEN 0 THEN 's3' WHEN 1 THEN 'git' WHEN 2 THEN 'local' ELSE 'ftp' END AS type,
       CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE concat('/mnt/', {_text('s_suppkey')}) END AS mount_point
FROM supplier
"""
FX_WORKSPACE_MOUNTS = f"""
SELECT concat('w', {_text('c_nationkey')}) AS workspace, c_custkey AS ord,
       CASE WHEN c_custkey % 45 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN concat('b', {_text('c_custkey % 60')})
         ELSE concat('r', {_text('(c_custkey + c_custkey % 2) % 600')}) END AS source,
       CASE WHEN c_custkey % 70 = 0 THEN '' ELSE concat('/mnt/vfs/m', {_text('c_custkey % 700')}, '/') END AS mount_at
FROM customer
"""

VIEWS = {
    "fx_edges": FX_EDGES, "fx_ring": FX_RING, "fx_deep": FX_DEEP, "fx_cross_repo": FX_CROSS_REPO, "fx_files": FX_FILES, "fx_tricky_files": FX_TRICKY_FILES, "fx_events": FX_EVENTS,
    "fx_registry": FX_REGISTRY, "fx_metadata": FX_METADATA, "fx_updates": FX_UPDATES, "fx_paths": FX_PATHS, "fx_rules": FX_RULES,
    "fx_mounts": FX_MOUNTS, "fx_mounted_paths": FX_MOUNTED_PATHS, "fx_inventory": FX_INVENTORY,
    "fx_repos": FX_REPOS, "fx_backends": FX_BACKENDS, "fx_workspace_mounts": FX_WORKSPACE_MOUNTS,
}


_stored: dict[tuple[str, str, str], str] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table. Its SQL runs once per session over the whole given tables.

    It is stored, so that operators meet columns of a table, as they do in use,
    and not the expressions a test table is made of. Edge ends and mount points
    have other names in SQL, where `from` and `at` are keywords.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        text = VIEWS[name]
        for t in TABLES:
            if t in text:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        folder = scratch.new_folder(spark, name)
        scratch.store(spark.sql(text).withColumnRenamed("mount_at", "at"), folder)
        _stored[key] = folder
    return spark.read.parquet(_stored[key])


def edge_view(spark: SparkSession, sf_dir: str, name: str = "fx_edges") -> DataFrame:
    return view(spark, sf_dir, name).select(F.col("src").alias("from"), F.col("dst").alias("to"), "rel")


def with_views(*names: str, recursive: bool = False) -> str:
    """The head of an oracle that uses derived tables."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts)
