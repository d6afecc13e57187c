"""Named SQL rules over registered tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from depscope import scratch
from depscope.schemas import RULE
from depscope.sources.tables import query_inventory


@dataclass(frozen=True)
class Rule:
    name: str
    query: str
    description: str = ""
    args: dict = field(default_factory=dict)


# Names and descriptions of the shipped rules.
STALE_FILES = Rule(
    "stale-files",
    """
    SELECT path, last_modified, last_tested FROM file_registry
    WHERE last_modified > last_tested OR last_tested IS NULL
    ORDER BY last_modified DESC
    """,
    "Files changed since last test pass",
)
# An anti join instead of NOT IN: `from` is never null, and an anti join does not
# need the other side in one place.
UNTESTED_CRITICAL = Rule(
    "untested-critical",
    """
    SELECT e.`to` AS file, COUNT(*) AS dependents FROM edges e
    LEFT ANTI JOIN (SELECT DISTINCT `from` FROM edges WHERE rel = 'tested_by') t ON e.`to` = t.`from`
    WHERE e.rel = 'imports'
    GROUP BY e.`to` HAVING COUNT(*) > 5 ORDER BY dependents DESC
    """,
    "Critical path files with no tests",
)
SHIPPED_RULES = (STALE_FILES, UNTESTED_CRITICAL)


@dataclass(frozen=True)
class RuleResult:
    """Rows of a rule, or the reason why there are none."""

    rule: str
    description: str
    rows: DataFrame | None
    total: int
    error: str | None


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.description, r.query) for r in rules], RULE)


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.select("name", "description")


def find_rule(rules: Sequence[Rule], name: str) -> Rule:
    for rule in rules:
        if rule.name == name:
            return rule
    raise LookupError(f"no rule named '{name}'; available: {', '.join(r.name for r in rules)}")


def register(**tables: DataFrame) -> None:
    """Make tables visible to all rules of the session under their names."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def _message(error: PySparkException) -> str:
    return (error.getMessage() or str(error)).strip()


def query(spark: SparkSession, rule: Rule, **tables: DataFrame) -> DataFrame:
    """The rule as a frame; nothing runs yet and faults are raised. Given tables are known to this rule only."""
    return query_inventory(spark, rule.query, rule.args, **tables)


def check_rule(spark: SparkSession, rule: Rule, **tables: DataFrame) -> RuleResult:
    """Run a rule. Its rows are stored, so that a fault while it runs is caught here too."""
    try:
        planned = query(spark, rule, **tables)
    except PySparkException as error:
        return RuleResult(rule.name, rule.description, None, 0, f"SQL parse error: {_message(error)}")
    try:
        rows = scratch.materialize(planned, "rule")
        return RuleResult(rule.name, rule.description, rows, rows.count(), None)
    except PySparkException as error:
        return RuleResult(rule.name, rule.description, None, 0, f"Query execution error: {_message(error)}")


def check_all(spark: SparkSession, rules: Sequence[Rule], **tables: DataFrame) -> DataFrame:
    """Rows of all rules as (rule, ok, row, error); a rule that fails has one row with its error."""
    result = spark.createDataFrame([], "rule string, ok boolean, row array<string>, error string")
    for rule in rules:
        done = check_rule(spark, rule, **tables)
        if done.error is not None:
            part = spark.createDataFrame([(rule.name, False, None, done.error)], result.schema)
        else:
            cells = F.array(*[F.col(f"`{name}`").cast("string") for name in done.rows.columns])
            part = done.rows.select(
                F.lit(rule.name).alias("rule"), F.lit(True).alias("ok"), cells.alias("row"), F.lit(None).cast("string").alias("error")
            )
        result = result.unionByName(part)
    return result
