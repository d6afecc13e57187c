"""Registered queries: access rules, mounts, workspaces and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import table, view, with_views
from depscope import scratch
from depscope.functions import globs, paths
from depscope.operators import access, catalog, resolve
from depscope.plans import folders
from depscope.sources import tables

QUERIES, ORACLES = {}, {}


def _register(name, query, oracle=None):
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


# -- access rules ------------------------------------------------------------
_MODE = """CASE WHEN p LIKE '.vfs/%' OR p LIKE '.git/%' OR p = '.gitignore' OR p LIKE '%.sum' OR p LIKE '%.lock' OR p LIKE '%.pb.go' OR p LIKE '%.gen.go'
  OR p LIKE 'vendor/%' OR p LIKE '%/vendor/%' OR p LIKE 'node_modules/%' OR p LIKE '%/node_modules/%' OR p LIKE '.github/workflows/%' THEN 292
  ELSE 420 END"""
_MODES = f"{with_views('fx_paths')}, modes AS (SELECT *, {_MODE} AS mode FROM (SELECT path, regexp_replace(path, '^(\\./)+', '') AS p FROM fx_paths))"
RULES = access.DEFAULT_PROTECTIONS


def _paths(s, d):
    return view(s, d, "fx_paths")


_register("compute_mode", lambda s, d: access.compute_mode(_paths(s, d), RULES), f"{_MODES} SELECT path, mode FROM modes")
_register(
    "compute_mode_files", lambda s, d: access.compute_mode(view(s, d, "fx_files").select("path"), RULES).groupBy("mode").agg(F.count("*").alias("files")),
    f"""{with_views('fx_files')} SELECT CASE WHEN path LIKE '%/vendor/%' THEN 292 ELSE 420 END AS mode, count(*) AS files FROM fx_files GROUP BY 1""",
)
_register(
    "compute_mode_by_table",
    lambda s, d: access.compute_mode_by_table(
        _paths(s, d), view(s, d, "fx_rules").select("ord", F.array("glob").alias("paths"), "mode", "allow_delete")
    ),
    f"""{with_views('fx_paths', 'fx_rules')}, asked AS (SELECT DISTINCT path, regexp_replace(path, '^(\\./)+', '') AS p FROM fx_paths),
    hit AS (SELECT path, arg_min(mode, ord) AS mode, arg_min(allow_delete, ord) AS allow_delete FROM asked JOIN fx_rules ON CASE form
      WHEN 0 THEN p = concat('docs/p', n, '.go') WHEN 1 THEN starts_with(p, concat('src/p', n)) WHEN 2 THEN p = concat('p', n, '.sum') OR ends_with(p, concat('/p', n, '.sum'))
      WHEN 3 THEN starts_with(p, concat('vendor/p', n, '.')) OR contains(p, concat('/vendor/p', n, '.')) ELSE p IN (concat('api/p', n, '.go'), concat('api/p', n, 'xgo')) END
      GROUP BY path)
    SELECT f.path, coalesce(h.mode, 420) AS mode, h.allow_delete FROM fx_paths f LEFT JOIN hit h USING (path)""",
)
_register(
    "apply_rule",
    lambda s, d: access.apply_rule(_paths(s, d), access.AccessRule(("src/**", "docs/p[0-4]*"), 0o444)).select("path", "permission.*"),
    f"""{_MODES} SELECT path, CASE WHEN hit THEN 292 END AS mode, CASE WHEN hit THEN true END AS readable, CASE WHEN hit THEN false END AS writable
    FROM (SELECT path, (p LIKE 'src/%' OR regexp_matches(p, '^docs/p[0-4]')) AS hit FROM modes)""",
)
_register(
    "check_access",
    lambda s, d: access.check_access(_paths(s, d), RULES, "write").select(
        "path", "mode", "allowed", F.col("denied.path").alias("denied_path"), F.col("denied.operation").alias("operation")
    ).unionByName(access.check_access(_paths(s, d), RULES, "rw").where("allowed").select(
        "path", "mode", "allowed", F.lit(None).cast("string").alias("denied_path"), F.lit("rw").alias("operation")
    )),
    f"""{_MODES} SELECT path, mode, mode = 420 AS allowed, CASE mode WHEN 292 THEN p END AS denied_path, CASE mode WHEN 292 THEN 'write' END AS operation FROM modes
    UNION ALL SELECT path, mode, true, NULL, 'rw' FROM modes WHERE mode = 420""",
)
_register(
    "default_protections",
    lambda s, d: access.compute_mode(_paths(s, d), RULES).withColumn("allow_delete", access.deletable(F.col("path"), RULES)).groupBy(
        "mode", "allow_delete"
    ).agg(F.count("*").alias("paths")),
    f"""{_MODES} SELECT mode, CASE WHEN mode = 292 THEN false WHEN p LIKE 'src/%' OR p LIKE 'lib/%' OR p LIKE 'cmd/%' THEN true END AS allow_delete,
    count(*) AS paths FROM modes GROUP BY 1, 2""",
)
_register(
    "mask_read_only",
    lambda s, d: access.mask_read_only(
        table(s, d, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("path"), F.lit(0o644).alias("mode"), (F.col("c_custkey") % 3 == 0).alias("writable"))
    ),
    "SELECT concat('f', c_custkey) AS path, CASE WHEN c_custkey % 3 = 0 THEN 420 ELSE 292 END AS mode, c_custkey % 3 = 0 AS writable FROM customer",
)

# -- mounts ------------------------------------------------------------------
MOUNTED = with_views("fx_mounts", "fx_mounted_paths", "fx_inventory")
_RESOLVED = f"""{MOUNTED}, ranked AS (
  SELECT p.path, m.* EXCLUDE (path), m.path AS target,
    row_number() OVER (PARTITION BY p.path ORDER BY CASE kind WHEN 's3' THEN 0 WHEN 'remote' THEN 1 ELSE 2 END, ord) AS rn
  FROM (SELECT DISTINCT path FROM fx_mounted_paths) p LEFT JOIN fx_mounts m ON starts_with(p.path, m.mount_at)
), placed AS (SELECT path, kind, cache, ttl, mount_at,
    CASE WHEN kind IS NULL THEN concat('/work', path)
      WHEN kind = 's3' AND cache IS NOT NULL THEN concat(cache, '/', ltrim(substring(path, length(mount_at) + 1), '/'))
      WHEN kind = 's3' THEN concat('s3://', bucket, '/', coalesce(prefix, ''))
      WHEN kind = 'remote' THEN concat(coalesce(cache, '/tmp'), '/', replace(url, '/', '_')) ELSE target END AS real_path
  FROM ranked WHERE rn = 1
), resolved AS (SELECT *, real_path IN (SELECT path FROM fx_inventory) AS present FROM placed)"""
_RESOLVED_ROWS = """SELECT path, real_path, CASE kind WHEN 's3' THEN 's3' WHEN 'remote' THEN 'git' ELSE 'local' END AS backend,
  present AND NOT (coalesce(kind, '') = 's3' AND cache IS NULL) AS cached,
  CASE WHEN kind IS NULL THEN CASE WHEN present THEN 'synced' ELSE 'not found on disk' END WHEN kind = 'local' THEN 'synced' ELSE 'unknown' END AS sync_status
  FROM resolved"""


def _mounts(s, d):
    return view(s, d, "fx_mounts")


_register(
    "resolve_paths", lambda s, d: resolve.resolve_paths(view(s, d, "fx_mounted_paths"), _mounts(s, d), view(s, d, "fx_inventory"), "/work"),
    f"{_RESOLVED} {_RESOLVED_ROWS}",
)
_register(
    "list_mounts",
    lambda s, d: resolve.list_mounts(_mounts(s, d), "/data/n1").unionByName(resolve.list_mounts(_mounts(s, d), "/")),
    f"""{MOUNTED}, named AS (SELECT ltrim(mount_at, '/') AS name, 'directory' AS entry_type,
      CASE kind WHEN 'remote' THEN 'git' ELSE kind END AS backend, CAST(NULL AS BIGINT) AS size, true AS virtual, mount_at FROM fx_mounts)
    SELECT name, entry_type, backend, size, virtual FROM named WHERE starts_with(mount_at, '/data/n1')
    UNION ALL SELECT name, entry_type, backend, size, virtual FROM named""",
)
_register(
    "list_children",
    lambda s, d: resolve.list_children(view(s, d, "fx_files").withColumn("length", F.length("content")), "repo1/src"),
    f"""{with_views('fx_files')}, below AS (SELECT substring(path, 11) AS rest, length(content) AS n FROM fx_files WHERE path LIKE 'repo1/src/%')
    SELECT string_split(rest, '/')[1] AS name, CASE WHEN max(contains(rest, '/')::INT) = 1 THEN 'directory' ELSE 'file' END AS entry_type,
    CASE WHEN max(contains(rest, '/')::INT) = 0 THEN CAST(sum(n) AS BIGINT) END AS size FROM below GROUP BY 1""",
)
_register(
    "folder_totals",
    lambda s, d: folders.folder_totals(view(s, d, "fx_files").withColumn("length", F.length("content"))),
    f"""{with_views('fx_files')}, above AS (SELECT path, length(content) AS n, string_split(path, '/') AS parts FROM fx_files),
    inside AS (SELECT path, n, array_to_string(parts[1:i], '/') AS folder, array_to_string(parts[1:i + 1], '/') AS child, i + 1 = len(parts) AS own
      FROM (SELECT *, unnest(range(0, len(parts))) AS i FROM above))
    SELECT folder, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes, count(*) FILTER (own) + count(DISTINCT child) FILTER (NOT own) AS children FROM inside GROUP BY folder""",
)
_register(
    "to_backend_path",
    lambda s, d: resolve.to_backend_path(view(s, d, "fx_mounted_paths"), "/data/n0", "/cache", view(s, d, "fx_inventory")),
    f"""{MOUNTED}, placed AS (SELECT path, concat('/cache/', ltrim(CASE WHEN starts_with(path, '/data/n0') THEN substring(path, 9) ELSE path END, '/')) AS real_path
      FROM fx_mounted_paths) SELECT *, real_path IN (SELECT path FROM fx_inventory) AS found FROM placed""",
)

# -- workspaces --------------------------------------------------------------
WORKSPACES = with_views("fx_repos", "fx_backends", "fx_workspace_mounts")


def _workspaces(s, d):
    return [view(s, d, n) for n in ("fx_workspace_mounts", "fx_repos", "fx_backends")]


_PLAN = f"""{WORKSPACES}, repo AS (SELECT *, row_number() OVER (PARTITION BY workspace, name ORDER BY ord) AS rn FROM fx_repos),
backend AS (SELECT *, row_number() OVER (PARTITION BY workspace, name ORDER BY ord) AS rn FROM fx_backends),
plan AS (SELECT m.workspace, m.source AS name, CASE WHEN r.name IS NOT NULL THEN concat('/trees/', m.source) ELSE b.mount_point END AS backing_path,
  m.mount_at, CASE WHEN r.name IS NOT NULL THEN r.writable ELSE false END AS writable, m.ord
  FROM fx_workspace_mounts m LEFT JOIN repo r ON r.workspace = m.workspace AND r.name = m.source AND r.rn = 1
  LEFT JOIN backend b ON b.workspace = m.workspace AND b.name = m.source AND b.rn = 1
  WHERE r.name IS NOT NULL OR b.name IS NOT NULL)"""
_register("mount_plan", lambda s, d: catalog.mount_plan(*_workspaces(s, d), "/trees"), f'{_PLAN} SELECT workspace, name, backing_path, mount_at AS "at", writable, ord FROM plan')
_register(
    # Every customer's path, in the workspace of the customer's nation.
    "route_workspace",
    lambda s, d: resolve.route_workspace(
        table(s, d, "customer").select(
            F.concat(F.lit("w"), "c_nationkey").alias("workspace"),
            F.concat(F.lit("/m"), F.col("c_custkey") % 900, F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("/a/f"), "c_custkey")).otherwise("")).alias("path")),
        catalog.mount_plan(*_workspaces(s, d), "/trees"),
    ),
    f"""{_PLAN}, owners AS (SELECT workspace, regexp_extract(mount_at, '([^/]*)/*$', 1) AS segment, min(row(ord, name, backing_path, writable)) AS o FROM plan GROUP BY 1, 2),
    asked AS (SELECT concat('w', c_nationkey) AS workspace, concat('m', c_custkey % 900) AS segment, CASE WHEN c_custkey % 5 > 0 THEN concat('a/f', c_custkey) END AS rest FROM customer)
    SELECT workspace, concat('/', segment, CASE WHEN rest IS NULL THEN '' ELSE concat('/', rest) END) AS path, o[2] AS mount,
    CASE WHEN o IS NULL THEN NULL WHEN rest IS NULL THEN o[3] WHEN o[3] LIKE '%/' THEN concat(o[3], rest) ELSE concat(o[3], '/', rest) END AS real_path,
    o[4] AS writable FROM asked LEFT JOIN owners USING (workspace, segment)""",
)
_register(
    "validate_catalog", lambda s, d: catalog.validate_catalog(*[_workspaces(s, d)[i] for i in (1, 2, 0)]),
    f"""{WORKSPACES}, findings AS (
      SELECT workspace, 'repos[].name' AS field, 'repo name must not be empty' AS message FROM fx_repos WHERE name = ''
      UNION ALL SELECT workspace, concat('repos.', name, '.url'), 'repo url must not be empty' FROM fx_repos WHERE url = ''
      UNION ALL SELECT workspace, concat('repos.', name, '.ref'), 'repo ref must not be empty' FROM fx_repos WHERE ref = ''
      UNION ALL SELECT workspace, concat('repos.', name), 'duplicate repo name' FROM (SELECT *, row_number() OVER (PARTITION BY workspace, name ORDER BY ord) AS rn FROM fx_repos) WHERE rn > 1
      UNION ALL SELECT workspace, 'backends[].name', 'backend name must not be empty' FROM fx_backends WHERE name = ''
      UNION ALL SELECT workspace, concat('backends.', name, '.type'), concat('invalid backend type ''', type, ''', must be s3/git/local') FROM fx_backends WHERE type NOT IN ('s3', 'git', 'local')
      UNION ALL SELECT workspace, concat('backends.', name, '.mount_point'), 'backend mount_point must not be empty' FROM fx_backends WHERE mount_point = ''
      UNION ALL SELECT workspace, concat('backends.', name), 'duplicate backend name' FROM (SELECT *, row_number() OVER (PARTITION BY workspace, name ORDER BY ord) AS rn FROM fx_backends) WHERE rn > 1
      UNION ALL SELECT workspace, 'mounts[].source', 'mount source must not be empty' FROM fx_workspace_mounts WHERE source = ''
      UNION ALL SELECT workspace, concat('mounts.', source, '.source'), concat('mount source ''', source, ''' does not reference a declared repo or backend')
        FROM fx_workspace_mounts m WHERE source <> '' AND NOT EXISTS (SELECT 1 FROM (SELECT workspace, name FROM fx_repos UNION SELECT workspace, name FROM fx_backends) n
          WHERE n.workspace = m.workspace AND n.name = m.source)
      UNION ALL SELECT workspace, 'mounts[].at', 'mount path must not be empty' FROM fx_workspace_mounts WHERE mount_at = ''
      UNION ALL SELECT workspace, concat('mounts.at=', mount_at), 'duplicate mount point' FROM (SELECT *, row_number() OVER (PARTITION BY workspace, mount_at ORDER BY ord) AS rn FROM fx_workspace_mounts) WHERE rn > 1
    ) SELECT workspace, field, message, count(*) AS occurrences FROM findings GROUP BY 1, 2, 3""",
)

# -- reports -----------------------------------------------------------------
_register(
    "backend_summary", lambda s, d: catalog.backend_summary(_mounts(s, d)),
    f"""{MOUNTED} SELECT CASE kind WHEN 'remote' THEN 'git' ELSE kind END AS backend,
    CASE kind WHEN 's3' THEN concat('s3://', bucket, '/', coalesce(prefix, '')) WHEN 'remote' THEN url ELSE path END AS location, mount_at AS "at",
    CASE kind WHEN 's3' THEN writable END AS writable, 'configured' AS status FROM fx_mounts""",
)
_register(
    "staleness_report",
    lambda s, d: catalog.staleness_report(
        table(s, d, "orders").select(
            F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey")).alias("cached_at"),
            (F.col("o_orderkey") % 5 * 100).alias("ttl"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("fetched_at"),
            (F.col("o_orderkey") % 4 * 250).alias("pull_interval"),
        ), 1000,
    ).select("id", "fresh", "needs_pull"),
    """SELECT o_orderkey AS id, o_orderkey % 7 > 0 AND (o_orderkey % 5 = 0 OR greatest(1000 - o_custkey, 0) < o_orderkey % 5 * 100) AS fresh,
    o_orderkey % 3 = 0 OR greatest(1000 - o_custkey, 0) > o_orderkey % 4 * 250 AS needs_pull FROM orders""",
)
_BLOBS = "SELECT concat('/data/n', c_nationkey, '/c', c_custkey) AS path, concat('h', c_custkey % 13) AS hash, c_custkey % 99 AS uploaded_at FROM customer"
_register(
    "backend_status",
    lambda s, d: catalog.backend_status(
        view(s, d, "fx_mounted_paths"), _mounts(s, d), view(s, d, "fx_inventory"),
        table(s, d, "customer").select(
            F.concat(F.lit("/data/n"), "c_nationkey", F.lit("/c"), "c_custkey").alias("path"),
            F.concat(F.lit("h"), F.col("c_custkey") % 13).alias("hash"), (F.col("c_custkey") % 99).alias("uploaded_at"),
        ), "/work", 1700001500,
    ),
    f"""{_RESOLVED}, rows AS ({_RESOLVED_ROWS}), blobs AS ({_BLOBS}), last AS (SELECT path, max(row(uploaded_at, hash)) AS b FROM blobs GROUP BY path),
    stamped AS (SELECT path AS real_path, max(mtime) AS mtime FROM fx_inventory GROUP BY 1)
    SELECT rows.path, backend, rows.real_path, cached AND (coalesce(ttl, 0) = 0 OR coalesce(1700001500 - mtime < ttl, false)) AS cache_hit,
    b[1] AS last_synced, b[2] AS hash FROM rows JOIN resolved ON resolved.path = rows.path LEFT JOIN stamped ON stamped.real_path = rows.real_path
    LEFT JOIN last ON last.path = rows.path""",
)


def _mounts_round_trip(s, d):
    folder = scratch.new_folder(s, "mounts")
    tables.write_mounts(_mounts(s, d).select("*"), folder)
    return tables.read_mounts(s, folder)


_register(
    "mounts_round_trip", _mounts_round_trip,
    f"""{MOUNTED} SELECT kind, ord, mount_at AS "at", bucket, prefix, url, path, cache, ttl, writable FROM fx_mounts""",
)

# -- scalar functions --------------------------------------------------------
def _key():
    return F.col("c_custkey").cast("string")


_register(
    "external_targets",
    lambda s, d: view(s, d, "fx_cross_repo").select(
        F.col("dst").alias("target"), paths.is_external(F.col("dst")).alias("external"), paths.parse_external(F.col("dst")).alias("p"),
        paths.format_external(F.lit("base"), F.col("src")).alias("formatted"),
    ).select("target", "external", "p.repo", "p.path", "formatted"),
    f"""{with_views('fx_cross_repo')} SELECT dst AS target, dst LIKE 'external:%' AS external, CASE WHEN dst LIKE 'external:%' THEN string_split(dst, ':')[2] END AS repo,
    CASE WHEN dst LIKE 'external:%' THEN string_split(dst, ':')[3] END AS path, concat('external:base:', src) AS formatted FROM fx_cross_repo""",
)
_register(
    "glob_match",
    lambda s, d: view(s, d, "fx_paths").select(
        "path", globs.matches_glob(F.col("path"), "src/**/p?*[02468].go").alias("a"), globs.matches_glob(F.col("path"), "*[!a-y]").alias("b"),
        globs.matches_glob(F.col("path"), "**/p1*").alias("c"), globs.matches_glob(F.col("path"), "a**").alias("invalid"),
    ),
    f"""{with_views('fx_paths')} SELECT path, regexp_matches(path, '^src/(.*/)?p..*[02468]\\.go$') AS a, NOT regexp_matches(path, '[a-y]$') AS b,
    regexp_matches(path, '^(.*/)?p1.*$') AS c, false AS invalid FROM fx_paths""",
)
_register(
    "setting_values",
    lambda s, d: table(s, d, "customer").select(
        "c_custkey",
        paths.octal_mode(F.concat(F.lit("0"), F.col("c_custkey") % 8, F.lit("44"))).alias("mode"),
        paths.duration_ms(F.concat(_key(), F.element_at(F.array(F.lit("ms"), F.lit("s"), F.lit(""), F.lit("h")), (F.col("c_custkey") % 4 + 1).cast("int")))).alias("duration"),
        paths.repo_folder_name(F.concat(F.lit("https://git.example.org/a/r"), _key(), F.lit(".git"))).alias("folder"),
        paths.cache_path(F.lit("/cache"), F.lit("bucket"), F.concat(F.lit("//k/"), _key())).alias("cached"),
        paths.render_template(F.lit("lint {{ .FilePath }} --x {{ .FilePath }}"), _key()).alias("command"),
    ),
    """SELECT c_custkey, CAST(c_custkey % 8 * 64 + 36 AS INTEGER) AS mode,
    CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey * 1000 WHEN 2 THEN c_custkey ELSE 0 END AS duration,
    concat('git_example_org_a_r', c_custkey, '_git') AS folder, concat('/cache/bucket/k/', c_custkey) AS cached,
    concat('lint ', c_custkey, ' --x ', c_custkey) AS command FROM customer""",
)
