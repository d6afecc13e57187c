import os
import random

import pytest
from pyspark.sql import functions as F

from depscope import scratch
from depscope.functions import globs, paths
from depscope.operators import access, associate, catalog, classify, extract, hooks, metadata, resolve
from depscope.plans import discover, folders, rules
from depscope.schemas import EDGE, METADATA, MOUNT
from depscope.sources import edges as edge_tables
from depscope.sources import files as file_source
from depscope.sources import tables

SNIPPETS = [
    ("a.go", 'import "fmt"', ["std:fmt"]),
    ("b.go", 'import (\n\t"os"\n\tc "github.com/spf13/cobra"\n)\n', ["pkg:github.com/spf13/cobra", "std:os"]),
    ("c.py", "import os\nfrom collections import defaultdict\nimport a.b as c, d\n", ["pkg:a.b", "pkg:collections", "pkg:d", "pkg:os"]),
    ("d.ts", "import { x } from './utils'\nimport e from 'express'\nimport{y}from\"z\"\n", ["local:./utils", "pkg:express", "pkg:z"]),
    ("e.js", "const a = require('fs'), b = require( \"./c\" )\nnotrequire('x')\n", ["local:./c", "pkg:fs"]),
    ("f.rs", "use std::io;\nuse crate::x;\nuse self::y;\nuse super::z;\npub use a::b;\nextern crate libc;\n", ["pkg:a", "pkg:libc", "pkg:std"]),
    ("g.java", "import java.util.List;\nimport static a.B.*;\n", ["pkg:java.util.List", "pkg:static a.B.*"]),
    ("h.c", '#include <stdio.h>\n#include "local.h"\n', ["local:local.h", "sys:stdio.h"]),
    ("i.hpp", "#include <vector>\n", ["sys:vector"]),
    ("j.rb", "require 'json'\nrequire_relative 'x'\n", ["pkg:json"]),
    ("k.h", "#include <stdio.h>\n", []),
    ("l.txt", "import os\n", []),
    (".py", "import os\n", []),
]


def test_an_update_wins_over_an_equal_version(spark, rows):
    meta = spark.createDataFrame([("a", "user.vfs.x", "zzz", 5), ("b", "user.vfs.x", "old", 6), ("c", "user.vfs.x", "old", 4)], METADATA)
    updates = spark.createDataFrame([("a", "x", "aaa", 5), ("b", "x", "new", 5), ("c", "x", "new", 5)], METADATA)
    assert rows(metadata.set_metadata(meta, updates).select("path", "value")) == [("a", "aaa"), ("b", "old"), ("c", "new")]


@pytest.mark.parametrize("path, text, expected", [
    ("a.go", 'import (\n  "fmt" // see (x)\n  /* "no" */ "os"\n  u "a.b/c"\n)\nvar s = "// import"\n// import "gone"\n', ["std:fmt", "std:os", "pkg:a.b/c"]),
    ("a.py", 'import os, \\\n  sys\nx = 1; import w\ntry: import q\n"""\nimport gone\n"""\ns = "# no" # import gone\nfrom a.b import c\n', ["pkg:a.b", "pkg:os", "pkg:sys", "pkg:w", "pkg:q"]),
    ("a.c", '#  include <x.h>\n# include "y.h"\n// #include <gone.h>\n/*\n#include "gone.h"\n*/\n', ["local:y.h", "sys:x.h"]),
    ("a.ts", "import x\nlet s = 'from'\nimport {\n  a,\n  b as c,\n} from './m'\nimport d, * as e from \"p\"\n// import z from 'gone'\nimport 'side'\nimport type { T } from 't'\n", ["local:./m", "pkg:p", "pkg:side", "pkg:t"]),
    ("a.rs", "// use gone::x;\nuse std::io;\nfn f<'a>(x: &'a str) {}\n/* use gone; */ pub use serde::de;\n", ["pkg:std", "pkg:serde"]),
    ("a.rb", "# require 'gone'\nrequire 'json'\nx = '# no'\n", ["pkg:json"]),
    ("a.java", "/* import gone.X; */\nimport java.util.List; // c\n", ["pkg:java.util.List"]),
    ("b.c", '"' + "x" * 200_000 + "\n/*" + "*" * 100_000 + "\n", []),
])
def test_comments_strings_and_continued_lines(spark, path, text, expected):
    got = extract.extract_imports(spark.createDataFrame([(path, text)], "path string, content string"))
    assert sorted(r["to"] for r in got.collect()) == sorted(expected)


def test_extract_imports(spark):
    files = spark.createDataFrame([s[:2] for s in SNIPPETS], "path string, content string")
    found = {}
    for row in extract.extract_imports(files).collect():
        found.setdefault(row["from"], []).append(row["to"])
    assert {p: sorted(t) for p, t in found.items()} == {p: t for p, _, t in SNIPPETS if t}
    relative = extract.extract_imports(files.where("path = 'j.rb'"), ruby_relative=True)
    assert sorted(r["to"] for r in relative.collect()) == ["local:x", "pkg:json"]


def test_whole_texts_are_read(spark):
    text = "x = 1\n" * 200_000 + "import last\n"
    files = spark.createDataFrame([("a.py", text)], "path string, content string")
    assert [r["to"] for r in extract.extract_imports(files).collect()] == ["pkg:last"]


CASES = [
    ("src/foo_test.go", "", "test", "beta"), ("pkg/tests/a.py", "", "test", "beta"), ("test_a.py", "", "test", "beta"),
    ("src/FooTest.java", "", "test", "beta"), ("spec/a_spec.rb", "", "test", "beta"),
    ("src/main.rs", "", "entrypoint", "stable"), ("src/domain.rs", "", "entrypoint", "stable"), ("pkg/__main__.py", "", "entrypoint", "stable"),
    ("web/index.ts", "", "entrypoint", "stable"),
    ("a/b.rs", "fn main() {}", "entrypoint", "stable"), ("a/b.rs", "pub fn main() {}", "unknown", "unknown"),
    ("a/b.go", "func main() {}", "entrypoint", "stable"), ("a/b.c", "int main(void) {\n}", "entrypoint", "stable"),
    ("a/b.c", "int main(void);", "unknown", "unknown"), ("x/src/lib.go", "func Run() {}", "library", "stable"),
    ("src/lib.go", "func Run() {}", "library", "beta"), ("x/src/example/a.go", "type Foo struct{}", "library", "beta"),
    ("a/m.go", "func (r *T) Name() {}", "unknown", "unknown"), ("a/b.rs", "pub fn a(){}\npub async fn b(){}\n  pub fn c(){}", "library", "beta"),
    ("a/b.h", "int f(int); int g();", "library", "beta"), ("x/examples/a.go", "func run() {}", "example", "stable"),
    ("x/scripts/a.go", "func run() {}", "script", "beta"), ("a/B.PY", "x = 1", "unknown", "unknown"), ("a/b.rb", "module M\ndef f; end", "library", "beta"),
]


def test_classification(spark):
    files = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "i int, path string, content string")
    labels = files.select("i", classify.classification(
        F.lower("path"), extract.language_of(F.col("path"), extract.CLASSIFIED_LANGUAGES, True), F.col("content")
    ).alias("c")).select("i", "c.*").collect()
    for row in labels:
        assert (row["role"], row["status"]) == CASES[row["i"]][2:], CASES[row["i"]]
        assert row["reason"]


GLOBS = [
    ("src/**", "src/a/b.rs", True), ("src/**", "src", False), ("src/**", "xsrc/a", False), ("**/*.lock", "Cargo.lock", True),
    ("**/*.lock", "a/b/c.lock", True), ("*.go", "a/b.go", True), ("**/vendor/**", "src/vendor/lib.rs", True), ("**/vendor/**", "vendors/a", False),
    ("a?c", "a/c", True), ("[ab]x", "bx", True), ("[!ab]x", "bx", False), ("[a-c]x", "cx", True), ("[]a]x", "]x", True), ("a**", "ab", False),
    ("**a", "ba", False), ("[a", "[a", False), ("***", "a", False), ("a.b", "axb", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
    ("[x-a]", "b", False), ("Src/**", "src/a", False), (".gitignore", ".gitignore", True),
]


def test_globs(spark):
    one = spark.range(1)
    for pattern, path, expected in GLOBS:
        assert one.select(globs.matches_glob(F.lit(path), pattern)).first()[0] is expected, (pattern, path)


def test_access_rules(spark):
    modes = {
        "src/vendor/lib.rs": 0o444, "./src/a.rs": 0o644, ".git/config": 0o444, "go.sum": 0o444, "a/b.lock": 0o444, "README.md": 0o644,
        ".github/workflows/ci.yml": 0o444, ".github/other": 0o644, "x.pb.go": 0o444, "web/node_modules/a.js": 0o444,
    }
    frame = spark.createDataFrame([(p,) for p in modes], "path string")
    got = {r["path"]: r["mode"] for r in access.compute_mode(frame, access.DEFAULT_PROTECTIONS).collect()}
    assert got == modes
    first = [access.AccessRule(("a/**",), 0o400), access.AccessRule(("**",), 0o111)]
    one = spark.createDataFrame([("a/x",), ("b",)], "path string")
    allowed = {op: [r["allowed"] for r in access.check_access(one, first, op).orderBy("path").collect()] for op in access.OPERATIONS}
    assert allowed == {"read": [True, False], "write": [False, False], "execute": [False, True], "rw": [False, False]}
    assert access.rules_table(spark).count() == 13


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda column: one.select(column).first()[0]
    assert value(paths.parse_external(F.lit("external:shared-lib:pkg/utils.go")))[:] == ("shared-lib", "pkg/utils.go")
    assert value(paths.parse_external(F.lit("std:fmt"))) is None
    assert [value(paths.octal_mode(F.lit(t))) for t in ("0644", "755", "0o444", "9", "")] == [0o644, 0o755, 0o444, None, None]
    durations = {"500ms": 500, "2s": 2000, "30s": 30000, "7": 7, "x": 0, "": 0, "1h": 0, "1.5s": 0, "99999999999999999999s": 0}
    assert {t: value(paths.duration_ms(F.lit(t))) for t in durations} == durations
    assert value(paths.repo_folder_name(F.lit("git@host.org:a/b.git"))) == "host_org_a_b_git"
    assert value(paths.cache_path(F.lit("/c"), F.lit("b"), F.lit("/k/v"))) == "/c/b/k/v"
    assert [value(paths.extension(F.lit(p))) for p in ("a/b.tar.gz", ".bashrc", "a.b/c", "x.")] == ["gz", "", "", ""]
    odd = ("a/.bashrc", "..", "a/..b", ".a.py", "a.b/c.", "", "/", "a/b", "x.y/.z.w", "a\n.py\n", "a./", ".")
    assert [value(paths.extension(F.lit(p))) for p in odd] == ["", "", "b", "py", "", "", "", "", "w", "py\n", "", ""]
    assert [value(paths.parent_prefix(F.lit(p))) for p in odd] == ["a/", "", "a/", "", "a.b/", "", "/", "a/", "x.y/", "", "a./", ""]
    assert [value(paths.file_name(F.lit(p))) for p in odd] == [p.rpartition("/")[2] for p in odd]


def test_content_hash(spark):
    hashes = spark.createDataFrame([(b"hello world",), (b"",)], "c binary").select(metadata.content_hash(F.col("c"))).collect()
    assert [h[0] for h in hashes] == [
        "sha256:b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9",
        "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    ]


@pytest.fixture
def tree(tmp_path):
    texts = {
        "pkg/__init__.py": "import os\n", "_private/a.go": 'import "fmt"\n', "pkg/b.PY": "x", "pkg/deep/er/c.rs": "use a::b;\n",
        ".hidden/d.py": "import no\n", "target/e.py": "import no\n", "pkg/vendor/f.py": "import no\n", ".venv/g.py": "import no\n",
        "pkg/h.h": "int x;\n", "notes.txt": "n\n", "pkg/.i.py": "import no\n", "pkg/test_j.py": "", "pkg/j.py": "",
    }
    for name, text in texts.items():
        full = tmp_path / name
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)
    (tmp_path / "pkg" / "bad.py").write_bytes(b"\xff\xfe import x")
    os.symlink(tmp_path / "pkg" / "j.py", tmp_path / "pkg" / "link.py")
    return str(tmp_path)


def test_scan(spark, tree):
    scanned = {r["path"]: r["content"] for r in file_source.scan_files(spark, tree).collect()}
    assert sorted(scanned) == ["_private/a.go", "pkg/__init__.py", "pkg/deep/er/c.rs", "pkg/j.py", "pkg/test_j.py"]
    assert scanned["pkg/__init__.py"] == "import os\n"
    other = sorted(r["path"] for r in file_source.scan_files(spark, f"file://{tree}", "classify").collect())
    assert other == [
        ".hidden/d.py", ".venv/g.py", "_private/a.go", "pkg/.i.py", "pkg/__init__.py", "pkg/b.PY", "pkg/deep/er/c.rs", "pkg/h.h",
        "pkg/j.py", "pkg/link.py", "pkg/test_j.py",
    ]
    keys = sorted(r["key"] for r in file_source.list_objects(spark, tree, "pkg/de").collect())
    assert keys == ["pkg/deep/er/c.rs"]


def test_discover_tree(spark, tree, rows):
    files = file_source.scan_files(spark, tree)
    found = discover.discover(files)
    assert rows(found) == [
        ("_private/a.go", "std:fmt", "imports"), ("pkg/__init__.py", "pkg:os", "imports"), ("pkg/deep/er/c.rs", "pkg:a", "imports"),
        ("pkg/j.py", "pkg/test_j.py", "tests"), ("pkg/test_j.py", "pkg/j.py", "tested_by"),
    ]
    assert discover.discover_summary(files, found).first()[:] == (5, 3, 3)


def test_names_of_tests(spark):
    names = {
        "a_test.go": "a.go", "test_a_test.rb": "test_a.rb", "test_a.py": "a.py", "test_a.js": None, "test_a.test.ts": None, "a.spec.ts": "a.ts",
        "ATest.java": "A.java", "a.py": None, "test_.c": ".c",
    }
    frame = spark.createDataFrame([(n,) for n in names], "n string").select("n", associate.source_of_test(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in frame.collect()} == names


def test_edges_json(spark, tmp_path, rows):
    path = tmp_path / "edges"
    path.mkdir()
    (path / "a.jsonl").write_text('{"from":"a","to":"b","rel":"x"}\n\nbroken\n{"from":"a"}\n')
    assert rows(edge_tables.read_edges(spark, str(path))) == [("a", "b", "x")]
    more = spark.createDataFrame([("a", "b", "x"), ("c", "d", "x"), ("c", "d", "x")], EDGE)
    assert edge_tables.append_edges_dedup(more, str(path)) == 1
    assert edge_tables.append_edges_dedup(more, str(path)) == 0
    assert edge_tables.append_edges_dedup(more, str(tmp_path / "new" / "edges")) == 2
    assert rows(edge_tables.read_edges(spark, str(path))) == [("a", "b", "x"), ("c", "d", "x")]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "table")
    three = spark.createDataFrame([("a", "b", "i"), ("b", "c", "i"), ("c", "d", "i")], EDGE)
    counts = []
    for batch in (three, three, spark.createDataFrame([("a", "b", "i"), ("x", "y", "i")], EDGE)):
        edge_tables.upsert_edges(batch, path)
        counts.append(edge_tables.read_edge_table(spark, path).count())
    assert counts == [3, 3, 4]


def test_mount_tables(spark, tmp_path):
    assert tables.read_mounts(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "blank.json").write_text("  \n")
    assert tables.read_mounts(spark, str(tmp_path / "blank.json")).count() == 0


def test_metadata(spark, rows):
    meta = spark.createDataFrame([("f", "user.vfs.role", "a", 1), ("f", "user.other", "z", 1)], METADATA)
    updates = spark.createDataFrame([("f", "role", "b", 2), ("f", "user.vfs.role", "c", 3), ("g", "role", "d", 1)], METADATA)
    merged = metadata.set_metadata(meta, updates)
    assert rows(merged) == [("f", "user.other", "z", 1), ("f", "user.vfs.role", "c", 3), ("g", "user.vfs.role", "d", 1)]
    assert rows(metadata.previous_values(meta, updates)) == [("f", "user.vfs.role", "c", "a"), ("g", "user.vfs.role", "d", None)]
    assert rows(metadata.list_metadata(merged)) == [("f", "user.vfs.role"), ("g", "user.vfs.role")]
    assert rows(metadata.metadata_map(merged)) == [("f", {"user.vfs.role": "c"}), ("g", {"user.vfs.role": "d"})]
    assert spark.range(1).select(metadata.full_key(F.lit("user.vfs.user.vfs.x"))).first()[0] == "user.vfs.user.vfs.x"


def test_resolution(spark, rows):
    mounts = spark.createDataFrame([
        ("local", 0, "/data", None, None, None, "/srv/data", None, None, True), ("s3", 1, "/data/models", "b", "prod", None, None, "/cache", 60, False),
        ("s3", 2, "/raw", "b2", None, None, None, None, 60, False), ("remote", 0, "/git", None, None, "https://h/r", None, None, None, None),
    ], MOUNT)
    asked = spark.createDataFrame([("/data/models/a.pt",), ("/data/x",), ("/raw/y",), ("/git/z",), ("/free",), ("/gone",)], "path string")
    present = spark.createDataFrame([("/cache/a.pt",), ("/work/free",)], "path string")
    assert rows(resolve.resolve_paths(asked, mounts, present, "/work")) == [
        ("/data/models/a.pt", "/cache/a.pt", "s3", True, "unknown"), ("/data/x", "/srv/data", "local", False, "synced"),
        ("/free", "/work/free", "local", True, "synced"), ("/git/z", "/tmp/https:__h_r", "git", False, "unknown"),
        ("/gone", "/work/gone", "local", False, "not found on disk"), ("/raw/y", "s3://b2/", "s3", False, "unknown"),
    ]
    assert [r["name"] for r in resolve.list_mounts(mounts, "/").collect()] == ["data/models", "raw", "git", "data"]


def test_staleness_bounds(spark):
    at = lambda n: F.lit(n).cast("bigint")
    value = lambda c: spark.range(1).select(c).first()[0]
    assert value(catalog.is_fresh(F.lit(True), at(0), at(0), at(10**9)))
    assert value(catalog.is_fresh(F.lit(True), at(100), at(60), at(159))) and not value(catalog.is_fresh(F.lit(True), at(100), at(60), at(160)))
    assert not value(catalog.is_fresh(F.lit(False), at(None), at(0), at(1)))
    assert not value(catalog.needs_pull(at(100), at(60), at(160))) and value(catalog.needs_pull(at(100), at(60), at(160), inclusive=True))
    assert value(catalog.needs_pull(at(None), at(60), at(160)))


def test_hooks(spark, rows):
    registry = hooks.HookRegistry()
    registry.register("late", "file_write", lambda r: [hooks.warning(r["path"], "late")], priority=30)
    registry.register("early", "file_write", lambda r: [hooks.add_edge(r["path"], r["role"], "x")], priority=5, languages=["go"])
    files = spark.createDataFrame([("a.go",), ("b.py",)], "path string")
    meta = spark.createDataFrame([("a.go", "user.vfs.role", "lib", 1)], METADATA)
    results = hooks.dispatch_hooks(hooks.with_lookups(files, meta=meta, keys=["role"]), registry, "file_write")
    edges, _, warnings = hooks.split_hook_results(results)
    assert rows(edges) == [("a.go", "lib", "x")]
    assert rows(warnings.select("path")) == [("a.go",), ("b.py",)]
    assert [p for p, _ in registry.matching("file_write")] == [5, 30]
    assert hooks.dispatch_hooks(files, registry, "file_read").count() == 0


def test_rules(spark, edges, rows):
    rules.register(edges=edges(("a.go", "b.go"), ("b.go", "c.go"), ("x.go", "y.go", "calls")))
    by_rel = rules.Rule("by-rel", "SELECT * FROM edges WHERE rel = :rel", args={"rel": "imports"})
    assert rules.check_rule(spark, by_rel).total == 2
    counts = rules.check_rule(spark, rules.Rule("counts", "SELECT rel, COUNT(*) AS n FROM edges GROUP BY rel"))
    assert rows(counts.rows) == [("calls", 1), ("imports", 2)]
    bad = rules.check_rule(spark, rules.Rule("bad", "SELEC 1"))
    assert bad.rows is None and "parse" in bad.error
    failing = rules.check_rule(spark, rules.Rule("failing", "SELECT CAST(`from` AS INT) AS n FROM edges"))
    assert failing.rows is None and failing.error.startswith("Query execution error")
    mixed = rules.check_all(spark, [by_rel, rules.Rule("bad", "SELECT nothing FROM edges")])
    assert sorted((r["rule"], r["ok"]) for r in mixed.collect()) == [("bad", False), ("by-rel", True), ("by-rel", True)]
    with pytest.raises(LookupError, match="available: stale-files, untested-critical"):
        rules.find_rule(rules.SHIPPED_RULES, "none")
    assert rules.list_rules(rules.rules_table(spark, rules.SHIPPED_RULES)).count() == 2


def test_only_names_that_are_gone_are_left_out(spark, tmp_path, monkeypatch):
    import errno
    import os

    from depscope.sources import files as source

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_text("x")

    class Count:
        n = 0

        def add(self, k):
            self.n += k

    real = os.scandir

    def failing(code):
        def scan(path):
            if str(path).endswith("/sub"):
                raise OSError(code, os.strerror(code), path)
            return real(path)

        return scan

    count, root, rules = Count(), str(tmp_path), source.PROFILES["discover"]
    monkeypatch.setattr(os, "scandir", failing(errno.ETIMEDOUT))
    with pytest.raises(OSError, match="timed out"):
        source._list_folder(root, "sub", rules, count)
    for code in (errno.EACCES, errno.ENOENT):
        monkeypatch.setattr(os, "scandir", failing(code))
        assert source._list_folder(root, "sub", rules, count) == []
    assert count.n == 2
    monkeypatch.undo()
    with pytest.raises(FileNotFoundError):
        source._list_folder(f"{root}/lost", "", rules)
    skipped = spark.sparkContext.accumulator(0)
    listed = scratch.materialize(source.list_files(spark, root, "discover", skipped), "listed")
    (tmp_path / "sub" / "a.py").unlink()
    assert source.read_contents(listed, root, skipped=skipped).count() == 0 and skipped.value == 1


def test_workspaces_do_not_take_each_others_mounts(spark, rows):
    plan = spark.createDataFrame(
        [("w1", "r", "/trees/r", "/mnt/m1", True, 1), ("w2", "b", "/mnt/b/", "/mnt/m1/", False, 1), ("w2", "c", "/mnt/c", "/x/m1", False, 2)],
        "workspace string, name string, backing_path string, at string, writable boolean, ord int")
    paths = spark.createDataFrame([("w1", "/m1/a"), ("w2", "/m1/a"), ("w3", "/m1/a"), ("w2", "m1")], "workspace string, path string")
    assert rows(resolve.route_workspace(paths, plan)) == sorted([
        ("w1", "/m1/a", "r", "/trees/r/a", True), ("w2", "/m1/a", "b", "/mnt/b/a", False), ("w2", "m1", "b", "/mnt/b/", False), ("w3", "/m1/a", None, None, None)], key=repr)
    with pytest.raises(ValueError, match="workspace"):
        resolve.route_workspace(paths.drop("workspace"), plan)
    assert rows(resolve.route_workspace(paths.drop("workspace").limit(1), plan.where("workspace = 'w1'").drop("workspace"))) == [("/m1/a", "r", "/trees/r/a", True)]


@pytest.mark.parametrize("path, text, expected", [
    ("a.go", 'package m\nvar s = `\nimport "fake"\n`\nimport "fmt"\n', ["std:fmt"]),
    ("a.py", 's = "x; import fake"\nimport os\n', ["pkg:os"]),
    ("a.ts", "const t = `\nimport x from 'fake'\n`\nimport y from 'lib'\n", ["pkg:lib"]),
    ("a.rs", "use {a::b, c::d};\nuse ::std::x;\n/* /* use e; */ use f; */\n", ["pkg:a", "pkg:c", "pkg:std"]),
    ("a.java", "import a.B; import c.D;\n", ["pkg:a.B", "pkg:c.D"]),
    ("a.rb", "=begin\nrequire 'fake'\n=end\nrequire 'json'\n", ["pkg:json"]),
])
def test_imports_inside_comments_and_literals_do_not_count(spark, path, text, expected):
    files = spark.createDataFrame([(path, text)], "path string, content string")
    assert sorted(r["to"] for r in extract.extract_imports(files).collect()) == expected


def test_very_long_tokens_need_no_stack(spark):
    n = 300_000
    rows = [
        ("a.js", f"const t = `{'a${ {b: 1} }' * (n // 12)}`\nimport 'x'\n", "pkg:x"), ("b.js", f"/*{'* /' * (n // 3)}*/\nimport 'x'\n", "pkg:x"),
        ("c.rs", f"let s = r#\"{'\" ' * (n // 2)}\"#;\nuse x::y;\n", "pkg:x"), ("d.rs", "/*" * 3 + "a*b/c" * (n // 5) + "*/" * 3 + "\nuse x::y;\n", "pkg:x"),
        ("e.py", f"s = \"\"\"{'\"a\\\\' * (n // 4)}\"\"\"\nimport x\n", "pkg:x"), ("f.c", f"char *s = \"{'a\\\\n' * (n // 3)}\";\n#include <x>\n", "sys:x"),
        ("g.rb", f"=begin\n{'require 1' * (n // 9)}\n=end\nrequire 'x'\n", "pkg:x"), ("h.go", f"s := `{'a' * n}`\nimport \"x\"\n", "std:x"),
        ("i.rb", f"x = <<~EOS\n{'line\n' * (n // 5)}EOS\nrequire 'x'\n", "pkg:x"), ("j.java", f"String s = \"{'x' * n}\"; import x;\n", "pkg:x"),
        ("k.cpp", f"auto s = R\"({'a)b' * (n // 3)})\";\n#include <x>\n", "sys:x"), ("l.js", "`" + "a" * n + "\nimport 'x'\n", "pkg:x"),
    ]
    got = extract.extract_imports(spark.createDataFrame([r[:2] for r in rows], "path string, content string")).collect()
    assert sorted((r["from"], r["to"]) for r in got) == [(p, t) for p, _, t in rows]


def test_rule_texts_may_end_in_semicolons_and_keep_their_order(spark):
    e = spark.createDataFrame([(f"n{i * 7 % 20:02d}", "x", "r") for i in range(20)], EDGE).repartition(7)
    for text in ("SELECT `from` FROM edges ORDER BY `from` DESC;", "-- newest first\nSELECT `from` FROM edges ORDER BY `from` DESC ;\n; "):
        assert [r[0] for r in tables.query_inventory(spark, text, edges=e).collect()] == [f"n{i:02d}" for i in reversed(range(20))]
    assert tables.query_inventory(spark, "WITH a AS (SELECT 1 AS x FROM edges) SELECT count(*) AS n FROM a;", edges=e).first().n == 20


def test_rules_of_a_table_equal_rules_in_order(spark, rows):
    globs = [
        "src/**", "**/*.go", "**/vendor/**", "a/**/b.go", "*", "[ab]/?", "x.py", "lib/*test*/[!q]*.rs", "***", "a**", "[z", "**/é*x/**", "docs/ab.md", "", "**", "?",
    ]
    paths = ["src/a.go", "./src/b.c", "vendor/q", "k/vendor/q/r", "a/b.go", "a/c/d/b.go", "b/x", "x.py", "lib/mytests/w.rs", "lib/mytests/q.rs", "éax/y", "m/éx/y", "docs/ab.md", "", "z", "a\nb"]
    asked = spark.createDataFrame([(p, 7) for p in [*paths, "x.py", None]], "path string, mode int")
    rng = random.Random(4)
    for count in (0, 1, 6, len(globs)):
        chosen = [access.AccessRule((g, rng.choice(globs)), 0o400 + i, i % 2 == 0) for i, g in enumerate(rng.sample(globs, count))]
        got = access.compute_mode_by_table(asked, access.rules_table(spark, chosen))
        expected = access.compute_mode(asked, chosen).withColumn("allow_delete", access.deletable(F.col("path"), chosen))
        assert rows(got.select("path", "mode", "allow_delete")) == rows(expected.select("path", "mode", "allow_delete"))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_rules_that_share_a_folder_are_not_candidates_of_every_path_in_it(spark):
    shared = [f"**/vendor/p{n}.*" for n in range(300)] + [f"src/vendor/**/x{n}" for n in range(300)]
    index = access.index_rules(access.rules_table(spark, [access.AccessRule((g,), 0o444) for g in shared]))
    assert index.count() == 600 and index.groupBy("anchor").count().agg(F.max("count")).first()[0] <= 2


def test_folder_totals(spark, rows):
    data = [("/a/b/c/x", 5), ("a/b/y", 2), ("a/b/y", 2), ("z", None), ("a/d/w", 1), ("é/ü/v", 9), (None, 4)]
    files = spark.createDataFrame(data, "path string, length long")
    assert rows(folders.folder_totals(files)) == [
        ("", 6, 19, 3), ("a", 4, 10, 2), ("a/b", 3, 9, 3), ("a/b/c", 1, 5, 1), ("a/d", 1, 1, 1), ("é", 1, 9, 1), ("é/ü", 1, 9, 1),
    ]
    assert rows(folders.folder_totals(files.limit(0))) == []


def test_a_flat_folder_leaves_a_task_in_slices(spark, tmp_path, monkeypatch):
    for i in range(25):
        (tmp_path / f"f{i}.go").write_bytes(b"x" * i)
    monkeypatch.setattr(file_source, "LISTED_ROWS", 4)
    frames = list(file_source._listed(str(tmp_path), [""], file_source.PROFILES["all"]))
    assert [len(f) for f in frames] == [4] * 6 + [1] and len({n for f in frames for n in f["name"]}) == 25
    # Contents leave in batches of bounded size too.
    listing = file_source.list_files(spark, str(tmp_path))
    got = file_source.read_contents(listing, str(tmp_path), batch_bytes=7).collect()
    assert sorted((r.path, r.length, bytes(r.data)) for r in got) == sorted((f"f{i}.go", i, b"x" * i) for i in range(25))
    assert sorted(r.mtime for r in got) == sorted(r.mtime for r in listing.collect())


def test_a_prefix_enters_its_own_folder_only(spark, tmp_path, monkeypatch):
    for name in ("a/b/c1", "a/b/c2/d", "a/bc/e", "a/x/f", "z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    listed = lambda prefix: sorted(r["key"] for r in file_source.list_objects(spark, str(tmp_path), prefix).collect())
    assert listed("a/b") == ["a/b/c1", "a/b/c2/d", "a/bc/e"]
    assert listed("a/b/c") == ["a/b/c1", "a/b/c2/d"] and listed("a/b/c2/") == ["a/b/c2/d"]
    assert len(listed("")) == 5 and listed("none/x") == listed("a//b") == listed("a/b/c1/") == listed("../") == []
