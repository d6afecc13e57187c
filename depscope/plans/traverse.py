"""Walks over an edge table, level by level.

A walk keeps one table in the shared checkpoint folder, with a folder per step.
Each step joins the newest depth with the edges, keeps one row per name with the
smallest relation, and drops the names found before. No step holds a plan that
grows with the number of steps, and a lost executor repeats one step at most.

The newest depth is a stored table, so Spark can broadcast it when its files are
small enough, and prune the folders of an edge layout by it; otherwise the step is
a shuffled join whose hot keys are split at run time. Edges are read where they
lie, three columns a level, and never copied. An edge table that is walked often,
or that is costly to derive, should be stored first, best as a layout.

A walk that is still growing after PLAIN_LEVELS doubles its reach instead. The k-th
power of the hops holds (a, b) where b lies at the end of exactly 2^k hops from a. The
beginning of a shortest path is itself shortest, so every name with a depth in
(d, d + 2^k] ends 2^k hops that begin at a name with a depth in (d - 2^k, d]: one join
with the power finds them all, and their smallest depth. A walk of n levels then takes
about 3 log2(n) jobs. Powers can grow where many hops cross (a power of a dense graph
holds all pairs), so the next one is built only while the join that makes it has at most
POWER_GROWTH times as many rows as there are hops; until the walk ends it goes on by the
last power. That choice changes the number of jobs and never the rows.

Powers hold only names from which a hop goes on. Names where all hops end, often most of
them, are reached at last by one more hop from all the others, which also gives every
name its relation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from depscope import scratch
from depscope.operators.graph import lookup_column
from depscope.schemas import WALK
from depscope.sources.layout import EdgeLayout

DEFAULT_DEPTH = 5
PLAIN_LEVELS = 6
POWER_GROWTH = 4


@dataclass(frozen=True)
class Walk:
    """Names reached by a walk and whether it stopped at its depth limit."""

    rows: DataFrame
    total: int
    max_depth_reached: bool


def _hop_columns(edges: DataFrame, direction: str, external: bool) -> DataFrame:
    """(at, next, rel): a hop leads from `at` to `next`."""
    at = lookup_column(direction)
    nxt = "from" if at == "to" else "to"
    hops = edges.select(F.col(at).alias("at"), F.col(nxt).alias("next"), "rel")
    if not external:
        return hops
    # A target `external:repo:path` is also found by every part after a colon.
    pieces = F.split("at", ":")
    tails = F.when(
        F.size(pieces) > 1,
        F.transform(
            F.sequence(F.lit(2), F.size(pieces)),
            lambda i: F.concat(F.lit(":"), F.array_join(F.slice(pieces, i, F.size(pieces)), ":")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.array(F.concat(F.lit("="), "at")), tails)
    return hops.select(F.explode(names).alias("at"), "next", "rel")


_EXACT_NAME = "path"
# With external targets a path is looked up as it is and as `repo:rest`.
_EXTERNAL_NAMES = "explode(array(concat('=', path), concat(':', regexp_replace(path, '^([^/]*)/', '$1:'))))"


def _step(frontier, hops, layout, external):
    names = _EXTERNAL_NAMES if external else _EXACT_NAME
    on = "h.at = f.at"
    if layout is not None:
        # Same rule as the layout: few names open few folders.
        on = f"h.bucket = cast(pmod(xxhash64(f.at), {layout.buckets}) AS int) AND " + on
    return frontier.sparkSession.sql(
        f"""
        WITH f AS (SELECT root, depth, {names} AS at FROM {{frontier}})
        SELECT root, h.next AS path, min(h.rel) AS relation, cast(min(f.depth) + 1 AS int) AS depth
        FROM {{hops}} h JOIN f ON {on}
        GROUP BY root, h.next
        """,
        frontier=frontier, hops=hops,
    )


def _first_power(hops: DataFrame, newest: DataFrame, external: bool) -> DataFrame:
    """The hops as distinct pairs of names, without those that lead to a name from which no hop goes on."""
    spark = hops.sparkSession
    if not external:
        pairs = spark.sql("SELECT at AS a, next AS b FROM {hops} WHERE next IS NOT NULL AND at IS NOT NULL", hops=hops)
    else:
        pairs = scratch.materialize(spark.sql(
            f"""
            WITH names AS (SELECT next AS path FROM {{hops}} WHERE next IS NOT NULL UNION SELECT path FROM {{newest}}),
            n AS (SELECT path, {_EXTERNAL_NAMES} AS at FROM names)
            SELECT DISTINCT n.path AS a, h.next AS b FROM {{hops}} h JOIN n ON h.at = n.at WHERE h.next IS NOT NULL
            """,
            hops=hops, newest=newest,
        ), "pairs")
    return pairs.join(pairs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b").distinct()


# Rows of the join of a power with itself, before they are made distinct.
_NEXT_POWER_ROWS = """
    SELECT coalesce(sum(CAST(e.n AS DOUBLE) * s.n), 0)
    FROM (SELECT b AS mid, count(*) AS n FROM {power} GROUP BY b) e JOIN (SELECT a AS mid, count(*) AS n FROM {power} GROUP BY a) s ON e.mid = s.mid
"""


def _reach(run: str, hops: DataFrame, known: DataFrame, base: int, max_depth: int, external: bool, one_root: bool) -> DataFrame:
    """(root, path, depth) of the names beyond depth `base` from which a hop goes on, stored step by step below `run`.

    `known` has every name found so far with its depth, and the starts if they cannot return.
    """
    spark = hops.sparkSession
    newest = known.where(F.col("depth") == base)
    power = _first_power(hops, newest, external)
    if one_root:
        # Shortest paths to new names leave the newest depth and never touch a name found earlier.
        behind = known.where(F.col("depth") < base)
        power = power.join(behind.select(F.col("path").alias("a")), "a", "left_anti")
        power = power.join(known.select(F.col("path").alias("b")), "b", "left_anti").select("a", "b")
    power = scratch.materialize(power, "power")
    # Where a name has one hop at most, or one leads to it, that holds for every power: none outgrows the names, and no pair occurs twice.
    pairs, begins, ends = power.agg(F.count("*"), F.count_distinct("a"), F.count_distinct("b")).first()
    single, most = pairs in (begins, ends), POWER_GROWTH * pairs
    folder, depth, span, step, growing = f"{run}/reach", base, 1, 0, True
    schema = "root string, path string, depth int"
    found = spark.createDataFrame([], schema)
    while depth < max_depth:
        window = newest.unionByName(found).where(F.col("depth") > depth - span)
        grown = spark.sql(
            f"""
            SELECT w.root, p.b AS path, cast(min(w.depth) + {span} AS int) AS depth
            FROM {{window}} w JOIN {{power}} p ON w.path = p.a WHERE w.depth + {span} <= {max_depth} GROUP BY w.root, p.b
            """,
            window=window, power=power,
        )
        before = known.unionByName(found).select("root", "path")
        step += 1
        added = scratch.store(grown.join(before, ["root", "path"], "left_anti").select("root", "path", "depth"), f"{folder}/step={step}")
        next_rows = "0" if single else f"({_NEXT_POWER_ROWS})"
        last, next_rows = spark.sql(f"SELECT (SELECT max(depth) FROM {{added}}), {next_rows}", added=added, power=power).first()
        found = spark.read.schema(schema).parquet(folder).select("root", "path", "depth")
        depth += span
        if last is None or last < depth:
            break
        if growing := growing and next_rows <= most and depth < max_depth:
            doubled = spark.sql("SELECT l.a, r.b FROM {power} l JOIN {power} r ON l.b = r.a", power=power)
            doubled = scratch.materialize(doubled if single else doubled.distinct(), "power")
            scratch.drop(power)
            power, span = doubled, 2 * span
    scratch.drop(power)
    return found


def _with_relations(parents: DataFrame, known: DataFrame, hops: DataFrame, external: bool, max_depth: int) -> DataFrame:
    """The names that hops from the parents lead to and that are not known, with their depth and the smallest relation that gives it."""
    names = _EXTERNAL_NAMES if external else _EXACT_NAME
    reached = hops.sparkSession.sql(
        f"""
        WITH f AS (SELECT root, depth, {names} AS at FROM {{parents}} WHERE depth < {max_depth})
        SELECT root, path, best.rel AS relation, best.depth FROM (
          SELECT f.root, h.next AS path, min(struct(cast(f.depth + 1 AS int) AS depth, h.rel IS NULL AS unnamed, h.rel AS rel)) AS best
          FROM f JOIN {{hops}} h ON h.at = f.at WHERE h.next IS NOT NULL GROUP BY f.root, h.next
        )
        """,
        parents=parents, hops=hops,
    )
    before = known.select(F.col("root").alias("_root"), F.col("path").alias("_path")).distinct()
    return reached.join(before, F.col("root").eqNullSafe(F.col("_root")) & (F.col("path") == F.col("_path")), "left_anti")


def walk(
    edges: DataFrame | EdgeLayout,
    root: str | DataFrame,
    max_depth: int = DEFAULT_DEPTH,
    direction: str = "reverse",
    relations: list[str] | None = None,
    external: bool = False,
    start_can_return: bool = False,
) -> Walk:
    """Breadth-first walk from a name, or from every name in `root.root`, each on its own.

    A table with a column `path` too starts each root's walk at all of its paths at once.
    `relation` is the smallest relation of the edges that lead to a name from the
    depth before. A start is never part of its own result unless asked for.
    """
    spark = SparkSession.active() if isinstance(edges, EdgeLayout) else edges.sparkSession
    starts = spark.sql("SELECT :root AS root", {"root": root}) if isinstance(root, str) else root
    layout = edges if isinstance(edges, EdgeLayout) else None
    if layout is not None and (external or layout.key != lookup_column(direction)):
        edges, layout = layout.read(spark), None
    run = scratch.new_folder(spark, "walk")

    if layout is not None:
        hops = layout.read(spark)
        other = "from" if layout.key == "to" else "to"
        hops = hops.select(F.col(layout.key).alias("at"), F.col(other).alias("next"), "rel", "bucket")
        if relations is not None:
            hops = hops.where(F.col("rel").isin(*relations))
    else:
        kept = edges if relations is None else edges.where(F.col("rel").isin(*relations))
        hops = _hop_columns(kept, direction, external)

    found = f"{run}/found"
    seeds = starts.select(
        "root", F.col("path" if "path" in starts.columns else "root").alias("path"), F.lit(None).cast("string").alias("relation"), F.lit(0).alias("depth")
    )
    # Stored like every later depth, so that the first step prunes and broadcasts by its size too.
    seeds = scratch.store(seeds.distinct(), f"{run}/seeds")
    newest, before = seeds, None if start_can_return else seeds
    depth, total, added, at_limit = 0, 0, 0, False
    while depth < min(max_depth, PLAIN_LEVELS):
        grown = _step(newest.where(F.col("depth") == depth), hops, layout, external)
        if before is not None:
            grown = grown.join(before.select("root", "path"), ["root", "path"], "left_anti")
        depth += 1
        newest = scratch.store(grown.select(*WALK.names), f"{found}/step={depth}")
        added = newest.count()
        total += added
        at_limit = depth == max_depth and added > 0
        if not added:
            break
        reached = spark.read.schema(WALK).parquet(found).select(*WALK.names)
        before = reached if start_can_return else seeds.unionByName(reached)
    if depth == PLAIN_LEVELS < max_depth and added:
        known = before.select("root", "path", "depth")
        deeper = _reach(run, hops, known, depth, max_depth, external, isinstance(root, str))
        parents = known.where(F.col("depth") == depth).unionByName(deeper)
        related = _with_relations(parents, known, hops, external, max_depth)
        deep = scratch.store(related.select(*WALK.names), f"{found}/step={depth + 1}")
        added, last = deep.agg(F.count("*"), F.max("depth")).first()
        total, at_limit = total + added, last == max_depth
        scratch.discard(spark, f"{run}/reach")
    rows = spark.read.schema(WALK).parquet(found).select(*WALK.names) if depth else spark.createDataFrame([], WALK)
    return Walk(rows, total, at_limit)


def impact(edges, start: str, max_depth: int = DEFAULT_DEPTH, external: bool = False, **options) -> DataFrame:
    """Everything that depends on a name, directly or not: (path, relation, depth)."""
    return walk(edges, start, max_depth, external=external, **options).rows.drop("root")


def impact_many(edges, starts: DataFrame, max_depth: int = DEFAULT_DEPTH, external: bool = False, **options) -> DataFrame:
    """`impact` for a table of names (column `path`), keyed by root."""
    return walk(edges, starts.select(F.col("path").alias("root")), max_depth, external=external, **options).rows


def related_multi(edges, path: str, relations: list[str] | None = None, max_depth: int = DEFAULT_DEPTH, **options) -> DataFrame:
    """Names a path leads to over the given relations: (path, relation, depth)."""
    return walk(edges, path, max_depth, "forward", relations, **options).rows.drop("root")


def transitive_chain(edges, path: str, max_depth: int = DEFAULT_DEPTH, **options) -> DataFrame:
    """The dependency chain of a path as (to, depth); a cycle brings the path itself back."""
    done = walk(edges, path, max_depth, "forward", start_can_return=True, **options)
    return done.rows.select(F.col("path").alias("to"), "depth")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON document per dependent, so that a result of any size stays distributed."""
    return rows.select(F.to_json(F.struct("path", "relation", "depth")).alias("json"))


def impact_summary(edges, start: str, max_depth: int = DEFAULT_DEPTH, external: bool = False) -> DataFrame:
    """One row: number of dependents and whether the walk stopped at its depth limit."""
    done = walk(edges, start, max_depth, external=external)
    return done.rows.sparkSession.createDataFrame([(start, done.total, done.max_depth_reached)], "start string, total bigint, max_depth_reached boolean")
