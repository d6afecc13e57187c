"""Registered queries: source files, classification, metadata and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import edge_view, table, view, with_views
from depscope import scratch
from depscope.functions import paths as path_functions
from depscope.operators import associate, classify, extract, hooks, metadata, reports
from depscope.plans import discover
from depscope.sources import files as file_source
from depscope.sources import tables

FILES = with_views("fx_files")
QUERIES, ORACLES = {}, {}


def _register(name, query, oracle=None):
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def _files(s, d):
    return view(s, d, "fx_files")


# -- extraction --------------------------------------------------------------
def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _all(pattern: str) -> str:
    return f"regexp_extract_all(content, {_quoted(pattern)}, 1)"


# Patterns of their own, for the lines that files of `fx_files` have.
_GO = f"[concat(CASE WHEN p LIKE '%.%' THEN 'pkg:' ELSE 'std:' END, p) FOR p IN {_all(chr(34) + '([^' + chr(34) + ']+)' + chr(34))}]"
_PYTHON = f"""[concat('pkg:', m) FOR m IN list_concat({_all('(?m)^from ([a-z_0-9]+) import')},
  [split_part(trim(p), ' ', 1) FOR p IN flatten([string_split(n, ',') FOR n IN {_all('(?m)^ *import (.+)$')}])])]"""
_JS = f"""[concat(CASE WHEN p LIKE '.%' OR p LIKE '/%' THEN 'local:' ELSE 'pkg:' END, p) FOR p IN {_all('(?m)(?:from |^import |require[(] ?)"([^"]+)"')}]"""
_RUST = f"""[concat('pkg:', c) FOR c IN list_concat([u FOR u IN {_all('(?m)^(?:pub )?use ([a-z0-9]+)::')} IF u <> 'crate'], {_all('(?m)^extern crate ([a-z]+);')})]"""
_JAVA = f"[concat('pkg:', p) FOR p IN {_all('(?m)^import (.+);$')}]"
_C = f"""list_concat([concat('local:', p) FOR p IN {_all('#include "(.+)"')}], [concat('sys:', p) FOR p IN {_all('#include <(.+)>')}])"""
_RUBY = f"[concat('pkg:', p) FOR p IN {_all('(?m)^require .([a-z0-9]+).$')}]"

_FORMS = {
    "go": ("'go'", _GO), "python": ("'py'", _PYTHON), "javascript": ("'ts', 'tsx', 'js', 'jsx'", _JS), "rust": ("'rs'", _RUST),
    "java": ("'java'", _JAVA), "c": ("'c', 'cpp', 'cc', 'cxx', 'hpp', 'hxx'", _C), "ruby": ("'rb'", _RUBY),
}
_TARGETS = "CASE " + " ".join(f"WHEN ext IN ({exts}) THEN {form}" for exts, form in _FORMS.values()) + " END"
_WITH_EXT = f"{FILES}, known AS (SELECT path, content, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM fx_files)"
_IMPORTS = f"""SELECT path AS "from", unnest({_TARGETS}) AS "to", 'imports' AS rel FROM known"""

_register("extract_imports", lambda s, d: extract.extract_imports(_files(s, d)), f"{_WITH_EXT} {_IMPORTS}")
for _name, (_exts, _form) in _FORMS.items():
    _register(
        f"extract_imports_{_name}",
        lambda s, d, exts=_exts: extract.extract_imports(
            _files(s, d).where(path_functions.extension(F.col("path")).isin(*[e.strip(" '") for e in exts.split(",")]))
        ),
        f"""{_WITH_EXT} SELECT path AS "from", unnest({_form}) AS "to", 'imports' AS rel FROM known WHERE ext IN ({_exts})""",
    )
_register(
    # Files in which imports stand among comments and literals that spell others; what they import is known from how they are made.
    "extract_imports_tricky", lambda s, d: extract.extract_imports(view(s, d, "fx_tricky_files").select("path", "content")),
    f"""{with_views('fx_tricky_files')} SELECT path AS "from", unnest(string_split(expected, '|')) AS "to", 'imports' AS rel FROM fx_tricky_files""",
)
_register(
    "language_of",
    lambda s, d: _files(s, d).select(extract.language_of(F.col("path")).alias("language")).groupBy("language").agg(F.count("*").alias("files")),
    f"""{_WITH_EXT} SELECT CASE ext WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'js' THEN 'javascript'
    WHEN 'rb' THEN 'ruby' ELSE ext END AS language, count(*) AS files FROM known GROUP BY 1""",
)

# -- tests and other repositories --------------------------------------------
_NAMED = f"""{FILES}, named AS (
  SELECT path, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM fx_files
)"""
_SOURCE_OF = """CASE
  WHEN name LIKE '%\\_test.go' ESCAPE '\\' OR name LIKE '%\\_test.rs' ESCAPE '\\' OR name LIKE '%\\_test.cpp' ESCAPE '\\'
    OR name LIKE '%\\_test.rb' ESCAPE '\\' THEN regexp_replace(name, '_test(\\.[a-z]+)$', '\\1')
  WHEN name LIKE 'test\\_%' ESCAPE '\\' THEN CASE WHEN name LIKE '%.py' OR name LIKE '%.c' THEN name[6:] END
  WHEN name LIKE '%.test.ts' OR name LIKE '%.spec.ts' THEN regexp_replace(name, '\\.(test|spec)\\.ts$', '.ts')
  WHEN name LIKE '%Test.java' THEN regexp_replace(name, 'Test\\.java$', '.java') END"""
_TESTS_OF = """CASE
  WHEN name LIKE '%.go' THEN [concat(name[:-4], '_test.go')] WHEN name LIKE '%.py' THEN [concat('test_', name)]
  WHEN name LIKE '%.ts' THEN [concat(name[:-4], '.test.ts'), concat(name[:-4], '.spec.ts')]
  WHEN name LIKE '%.rs' THEN [concat(name[:-4], '_test.rs')] WHEN name LIKE '%.java' THEN [concat(name[:-6], 'Test.java')]
  WHEN name LIKE '%.c' THEN [concat('test_', name)] WHEN name LIKE '%.cpp' THEN [concat(name[:-5], '_test.cpp')]
  WHEN name LIKE '%.rb' THEN [concat(name[:-4], '_test.rb')] END"""
_TESTED_BY = f"""SELECT path AS "from", concat(folder, {_SOURCE_OF}) AS "to", 'tested_by' AS rel FROM named
  WHERE {_SOURCE_OF} IS NOT NULL AND concat(folder, {_SOURCE_OF}) IN (SELECT path FROM fx_files)"""
_TESTS = f"""SELECT path AS "from", concat(folder, t) AS "to", 'tests' AS rel FROM (SELECT path, folder, unnest({_TESTS_OF}) AS t FROM named)
  WHERE concat(folder, t) IN (SELECT path FROM fx_files)"""

_register("tested_by", lambda s, d: associate.tested_by(_files(s, d)), f"{_NAMED} {_TESTED_BY}")
_register("tests", lambda s, d: associate.tests(_files(s, d)), f"{_NAMED} {_TESTS}")
_register(
    "flag_external",
    lambda s, d: associate.flag_external(
        edge_view(s, d, "fx_cross_repo"),
        s.createDataFrame([("shared", "/mnt/people/"), ("copy", "/other/people"), ("base", "orders")], "source string, at string"),
    ),
    f"""{with_views('fx_cross_repo')} SELECT src AS "from", CASE WHEN dst LIKE 'people/%' THEN concat('external:copy:', dst[8:])
    WHEN dst LIKE 'orders/%' THEN concat('external:base:', dst[8:]) ELSE dst END AS "to", rel FROM fx_cross_repo""",
)
_DISCOVERED = f"""{_WITH_EXT}, named AS (
  SELECT path, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM fx_files
), found AS ({_IMPORTS} UNION ALL {_TESTED_BY} UNION ALL {_TESTS})"""
_register("discover", lambda s, d: discover.discover(_files(s, d)), f'{_DISCOVERED} SELECT "from", "to", rel FROM found')
_register(
    "discover_summary", lambda s, d: discover.discover_summary(_files(s, d), discover.discover(_files(s, d))),
    f"""{_DISCOVERED} SELECT count(*) AS edges, count(DISTINCT CASE WHEN rel = 'imports' THEN "from" END) AS sources,
    (SELECT count(DISTINCT ext) FROM known) AS languages FROM found""",
)
_register(
    "extension_edges",
    lambda s, d: associate.extension_edges(
        _files(s, d).select(F.regexp_replace("path", r"/mod_\d*?(\d\d?)\.", "/m$1.").alias("path")).distinct(),
        "repo1/**", "repo2/**/*.py", "documented_by",
    ),
    f"""{FILES}, short AS (SELECT DISTINCT regexp_replace(path, '/mod_\\d*?(\\d\\d?)\\.', '/m\\1.') AS path FROM fx_files),
    placed AS (SELECT path, regexp_replace(path[7:], '\\.[^./]*$', '') AS place FROM short)
    SELECT a.path AS "from", b.path AS "to", 'documented_by' AS rel FROM placed a JOIN placed b ON a.place = b.place
    WHERE a.path LIKE 'repo1/%' AND b.path LIKE 'repo2/%.py'""",
)

# -- classification ----------------------------------------------------------
_TEST_PATH = """(contains(p, '_test.') OR contains(p, '.test.') OR contains(p, '_spec.') OR starts_with(p, 'test_') OR contains(p, '/test/')
  OR contains(p, '/tests/') OR p LIKE '%test.java' OR p LIKE '%tests.java' OR contains(p, '__test__'))"""
_ENTRY = """CASE ext WHEN 'rs' THEN regexp_matches(content, '(?m)^[ \\t]*fn main\\(') WHEN 'py' THEN contains(content, 'if __name__ == "__main__"')
  WHEN 'go' THEN regexp_matches(content, '(?m)^func main\\(\\)')
  WHEN 'js' THEN contains(content, 'module.exports') OR contains(content, 'export default') OR contains(content, 'exports.')
  WHEN 'ts' THEN contains(content, 'module.exports') OR contains(content, 'export default') OR contains(content, 'exports.')
  WHEN 'java' THEN contains(content, 'public static void main(') WHEN 'rb' THEN regexp_matches(content, '(?m)^[ \\t]*#!/usr/bin/env ruby')
  ELSE regexp_matches(content, '(int|void) main\\([^;{}]*\\{') END"""
_PUBLIC = """CASE ext WHEN 'rs' THEN len(regexp_extract_all(content, '(?m)^[ \\t]*pub (?:async )?fn\\b')) >= 3
  WHEN 'py' THEN contains(content, '__all__') OR contains(content, 'def ') OR contains(content, 'class ')
  WHEN 'go' THEN regexp_matches(content, '(?m)^[ \\t]*(func|type) +[A-Z]') WHEN 'js' THEN contains(content, 'export ') OR contains(content, 'module.exports')
  WHEN 'ts' THEN contains(content, 'export ') OR contains(content, 'module.exports')
  WHEN 'java' THEN contains(content, 'public class') OR contains(content, 'public interface')
  WHEN 'rb' THEN contains(content, 'def ') AND (contains(content, 'module ') OR contains(content, 'class '))
  ELSE (length(content) - length(replace(content, ');', ''))) / 2 >= 2 END"""
_NAME = """CASE ext WHEN 'rs' THEN 'Rust' WHEN 'py' THEN 'Python' WHEN 'go' THEN 'Go' WHEN 'js' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript'
  WHEN 'java' THEN 'Java' WHEN 'c' THEN 'C' WHEN 'cpp' THEN 'Cpp' ELSE 'Ruby' END"""
_CLASSIFIED = f"""{_WITH_EXT}, steps AS (SELECT path, {_NAME} AS lang, CASE WHEN {_TEST_PATH} THEN 1 WHEN {_ENTRY} THEN 2 WHEN {_PUBLIC} THEN 3
    WHEN contains(p, '/example') THEN 4 WHEN contains(p, '/scripts/') THEN 5 ELSE 6 END AS step,
    CASE WHEN contains(p, '/src/') AND NOT contains(p, '/test') AND NOT contains(p, '/example') THEN 'stable' ELSE 'beta' END AS lib
    FROM (SELECT *, lower(path) AS p FROM known)),
  classified AS (SELECT path,
    ['test', 'entrypoint', 'library', 'example', 'script', 'unknown'][step] AS role,
    ['beta', 'stable', lib, 'stable', 'beta', 'unknown'][step] AS status,
    [concat('filename matches test pattern for ', lang), concat('contains entrypoint pattern for ', lang),
     concat('has public API surface for ', lang), 'in examples directory', 'in scripts directory', 'no classification pattern matched'][step] AS reason
    FROM steps)"""
_register("classify_files", lambda s, d: classify.classify_files(_files(s, d)), f"{_CLASSIFIED} SELECT * FROM classified")
_register(
    "role_summary", lambda s, d: classify.role_summary(classify.classify_files(_files(s, d))),
    f"{_CLASSIFIED} SELECT role, count(*) AS files FROM classified GROUP BY role",
)
_register(
    "classify_totals", lambda s, d: classify.classify_totals(classify.classify_files(_files(s, d))),
    f"{_CLASSIFIED} SELECT count(*) AS files, count(*) AS classified, 0 AS errors FROM classified",
)
_register(
    "classification_metadata",
    lambda s, d: metadata.set_metadata(
        s.createDataFrame([], metadata.METADATA), classify.classification_metadata(classify.classify_files(_files(s, d)), 7)
    ),
    f"""{_CLASSIFIED} SELECT path, 'user.vfs.role' AS key, role AS value, 7 AS version FROM classified
    UNION ALL SELECT path, 'user.vfs.status', status, 7 FROM classified""",
)

# -- metadata ----------------------------------------------------------------
META = with_views("fx_metadata")
_LATEST = f"""{with_views('fx_metadata', 'fx_updates')}, latest AS (
  SELECT path, key, max(row(version, value)) AS best FROM fx_metadata GROUP BY path, key
), old AS (SELECT path, key, best[2] AS value, best[1] AS version FROM latest),
updates AS (SELECT path, concat('user.vfs.', replace(key, 'user.vfs.', '')) AS key, value, version FROM fx_updates)"""


def _meta(s, d):
    return view(s, d, "fx_metadata")


def _updates(s, d):
    return view(s, d, "fx_updates")


_register(
    "set_metadata", lambda s, d: metadata.set_metadata(_meta(s, d), _updates(s, d)),
    f"""{_LATEST}, merged AS (
      SELECT path, key, value, version, 0 AS given FROM fx_metadata UNION ALL SELECT path, key, value, version, 1 FROM updates
    ) SELECT path, key, value, version FROM merged
    QUALIFY row_number() OVER (PARTITION BY path, key ORDER BY version DESC, given DESC, value DESC) = 1""",
)
_register(
    "metadata_previous_values", lambda s, d: metadata.previous_values(_meta(s, d), _updates(s, d)),
    f"{_LATEST} SELECT path, key, u.value, o.value AS previous_value FROM updates u LEFT JOIN old o USING (path, key)",
)
_register(
    "get_metadata", lambda s, d: metadata.get_metadata(_meta(s, d), _updates(s, d), ["role", "user.vfs.hash"]),
    f"""{_LATEST}, asked AS (SELECT DISTINCT path, unnest(['user.vfs.role', 'user.vfs.hash']) AS key FROM fx_updates)
    SELECT path, key, value FROM asked LEFT JOIN old USING (path, key)""",
)
_register(
    "list_metadata", lambda s, d: metadata.list_metadata(_meta(s, d)),
    f"{META} SELECT DISTINCT path, key FROM fx_metadata WHERE key LIKE 'user.vfs.%'",
)
_register(
    "remove_metadata", lambda s, d: metadata.remove_metadata(_meta(s, d), _updates(s, d)),
    f"{_LATEST} SELECT path, key, value, version FROM fx_metadata m WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.path = m.path AND u.key = m.key)",
)
_register(
    "metadata_map",
    # The map is flattened to sorted text for the value comparison.
    lambda s, d: metadata.metadata_map(_meta(s, d)).select("path", F.array_join(F.array_sort(F.transform(
        F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("metadata")),
    f"{_LATEST} SELECT path, string_agg(concat(key, '=', value), ',' ORDER BY concat(key, '=', value)) AS metadata FROM old WHERE key LIKE 'user.vfs.%' GROUP BY path",
)
_register(
    "metadata_columns", lambda s, d: metadata.metadata_columns(_meta(s, d), ["role", "status"]),
    f"""{_LATEST} SELECT path, max(CASE WHEN key = 'user.vfs.role' THEN value END) AS role, max(CASE WHEN key = 'user.vfs.status' THEN value END) AS status
    FROM old WHERE key IN ('user.vfs.role', 'user.vfs.status') GROUP BY path""",
)
_DOCUMENTS = "SELECT concat('docs/', doc_id) AS path, text AS content FROM documents"


def _documents(s, d):
    return table(s, d, "documents").select(F.concat(F.lit("docs/"), "doc_id").alias("path"), F.col("text").alias("content"))


_register(
    "content_hash", lambda s, d: metadata.hash_metadata(_documents(s, d), 1),
    f"SELECT path, 'user.vfs.hash' AS key, concat('sha256:', sha256(content)) AS value, 1 AS version FROM ({_DOCUMENTS})",
)


def _blob_index(s, d):
    folder = scratch.new_folder(s, "blobs")
    tables.append_blob_index(tables.blob_rows(_documents(s, d), 1700000000), folder)
    tables.append_blob_index(tables.blob_rows(_documents(s, d), 1700000001), folder)
    return tables.read_blob_index(s, folder)


_register(
    "append_blob_index", _blob_index,
    f"""SELECT path, concat('sha256:', sha256(content)) AS hash, 's3' AS backend, 1700000000 + i AS uploaded_at
    FROM ({_DOCUMENTS}), (SELECT unnest([0, 1]) AS i)""",
)

# -- reports -----------------------------------------------------------------
_register(
    "untested_files", lambda s, d: reports.untested_files(_files(s, d), associate.tests(_files(s, d))),
    f"""{_NAMED}, tested AS ({_TESTS}) SELECT path FROM named WHERE {_SOURCE_OF} IS NULL AND path NOT IN (SELECT "from" FROM tested)""",
)
_register(
    "module_stats", lambda s, d: reports.module_stats(_files(s, d), discover.discover(_files(s, d))),
    f"""{_DISCOVERED}, out AS (SELECT "from" AS path, count(*) AS n, max(CASE rel WHEN 'tests' THEN 1 END) AS tested FROM found GROUP BY 1)
    SELECT regexp_extract(path, '^[^/]*') AS module, count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS edges_count,
    round(count(tested) * 100.0 / count(*), 1) AS test_coverage_pct FROM fx_files LEFT JOIN out USING (path) GROUP BY 1""",
)
_register(
    "orphans", lambda s, d: reports.orphans(_files(s, d), associate.test_associations(_files(s, d))),
    f"""{_NAMED}, found AS ({_TESTED_BY} UNION ALL {_TESTS}) SELECT path FROM fx_files
    WHERE path NOT IN (SELECT "from" FROM found UNION SELECT "to" FROM found)""",
)
_register(
    "infer_features",
    lambda s, d: reports.infer_features(
        _files(s, d), _files(s, d).where(F.col("path").endswith("7.go")).select("path", F.lit("special").alias("feature"))
    ),
    f"""{FILES} SELECT path, CASE WHEN path LIKE '%7.go' THEN 'special' WHEN regexp_matches(path, '(^|/)src/[^/]+/')
    THEN concat(regexp_extract(path, '(?:^|/)src/([^/]+)/', 1), '-module') END AS feature FROM fx_files""",
)
_register(
    "detect_generated", lambda s, d: reports.detect_generated(_files(s, d)),
    f"{FILES} SELECT path FROM fx_files WHERE contains(content, 'DO NOT EDIT')",
)
_register(
    "loc_metrics", lambda s, d: reports.loc_metrics(_documents(s, d)),
    f"""SELECT path, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - (CASE WHEN content LIKE concat('%', chr(10)) THEN 1 ELSE 0 END) END AS loc
    FROM ({_DOCUMENTS})""",
)
_register(
    "select_scanned", lambda s, d: file_source.select_scanned(_files(s, d).select("path")),
    f"{FILES} SELECT path FROM fx_files WHERE path NOT LIKE '%/vendor/%'",
)

# -- scans: a tree with a file per document, below hidden, skipped and plain folders ------------------------
_TREE = """SELECT concat(coalesce(source, 'none'), '/', CASE WHEN doc_id % 7 = 0 THEN 'node_modules/' WHEN doc_id % 7 = 1 THEN '.hidden/' WHEN doc_id % 7 = 2 THEN '_build/x/' ELSE '' END,
  'd', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 5 WHEN 0 THEN '.go' WHEN 1 THEN '.PY' WHEN 2 THEN '.md' WHEN 3 THEN '.rs' ELSE '' END) AS path,
  coalesce(text, '') AS content FROM documents WHERE doc_id IS NOT NULL"""
_trees: dict[tuple[str, str], str] = {}


def _write_files(root):
    def write(batches):
        from pyarrow import fs

        system, base = (fs.LocalFileSystem(), root.removeprefix("file:")) if "://" not in root else fs.FileSystem.from_uri(root)
        for batch in batches:
            # One text at a time leaves the batch.
            for path, content in zip(batch.column("path"), batch.column("content")):
                full = f"{base}/{path.as_py()}"
                system.create_dir(full.rpartition("/")[0], recursive=True)
                with system.open_output_stream(full) as out:
                    out.write(content.as_py().encode())
            yield batch.select(["path"])

    return write


def _tree(s, d) -> str:
    """The folder of the tree, written once per session below the shared folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _trees:
        root = scratch.new_folder(s, "tree")
        table(s, d, "documents").createOrReplaceTempView("documents")
        s.sql(_TREE).mapInArrow(_write_files(root), "path string").write.format("noop").mode("overwrite").save()
        _trees[key] = root
    return _trees[key]


_SCANNED = f"SELECT path, content, CAST(strlen(content) AS BIGINT) AS length FROM ({_TREE})"
_register(
    "scan_files", lambda s, d: file_source.scan_files(s, _tree(s, d)).drop("mtime"),
    f"{_SCANNED} WHERE NOT contains(path, 'node_modules/') AND NOT contains(path, '/.') AND (path LIKE '%.go' OR path LIKE '%.rs')",
)
_register(
    "scan_files_classify", lambda s, d: file_source.scan_files(s, _tree(s, d), "classify").drop("mtime"),
    f"{_SCANNED} WHERE NOT contains(path, 'node_modules/') AND (path LIKE '%.go' OR path LIKE '%.PY' OR path LIKE '%.rs')",
)
_register(
    "list_objects", lambda s, d: file_source.list_objects(s, _tree(s, d), "src1").drop("mtime"),
    f"SELECT path AS key, length FROM ({_SCANNED}) WHERE starts_with(path, 'src1')",
)
_register(
    "list_objects_of_folder", lambda s, d: file_source.list_objects(s, _tree(s, d), "src2/_build/x/d1").drop("mtime"),
    f"SELECT path AS key, length FROM ({_SCANNED}) WHERE starts_with(path, 'src2/_build/x/d1')",
)


# -- hooks -------------------------------------------------------------------
def _measure(row):
    return [
        hooks.add_edge(row["path"], f"size:{len(row['content']) // 100}", "sized"),
        hooks.set_value(row["path"], "lines", str(row["content"].count("\n"))),
        hooks.warning(row["path"], f"{len(row['content'])} characters"),
    ]


def _hook_results(s, d):
    registry = hooks.HookRegistry()
    registry.register("measure", "file_write", _measure, priority=20, languages=["go"])
    registry.register("note", "file_write", lambda row: [hooks.warning(row["path"], "noted")], priority=10, languages=["go", "rust"])
    registry.register("reader", "file_read", lambda row: [hooks.warning(row["path"], "read")])
    return hooks.dispatch_hooks(_files(s, d), registry, "file_write")


_LINES = "length(content) - length(replace(content, chr(10), ''))"
_register(
    "dispatch_hooks", _hook_results,
    f"""{_WITH_EXT} SELECT 'measure' AS hook, 20 AS priority, 'add_edge' AS kind, path, concat('size:', length(content) // 100) AS target, 'sized' AS relation,
      NULL AS key, NULL AS value, NULL AS message FROM known WHERE ext = 'go'
    UNION ALL SELECT 'measure', 20, 'set_xattr', path, NULL, NULL, 'lines', CAST({_LINES} AS VARCHAR), NULL FROM known WHERE ext = 'go'
    UNION ALL SELECT 'measure', 20, 'warning', path, NULL, NULL, NULL, NULL, concat(length(content), ' characters') FROM known WHERE ext = 'go'
    UNION ALL SELECT 'note', 10, 'warning', path, NULL, NULL, NULL, NULL, 'noted' FROM known WHERE ext IN ('go', 'rs')""",
)
_register(
    "split_hook_metadata", lambda s, d: hooks.split_hook_results(_hook_results(s, d), 3)[1],
    f"{_WITH_EXT} SELECT path, 'user.vfs.lines' AS key, CAST({_LINES} AS VARCHAR) AS value, 3 AS version FROM known WHERE ext = 'go'",
)
