"""Guarded ad-hoc SQL: lint, automatic limit, bounded pages, batches, and introspection of what can be asked.

The guard looks at the parsed plan, not at the text: a statement is read-only if its plan is a query. What it needs of
Spark's internals is in ``parse_kind`` alone.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 200
CELL = 4096
#: Share of likeness from which a column name is repaired, and by how much it must lead the next.
TYPO, AMBIGUITY = 0.85, 0.05
#: Parsed statements that change something although they are no commands.
_WRITES = ("InsertIntoStatement", "DeleteFromTable", "UpdateTable", "MergeIntoTable")


class Refused(ValueError):
    """The statement is not a single read-only query."""


def strip_comments(sql: str) -> str:
    """SQL without comments; quoted text is left alone."""
    return re.sub(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", sql, flags=re.S)


def statements(sql: str) -> list[str]:
    """Statements between semicolons that are not quoted."""
    parts = re.findall(r"(?:'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|[^;'\"`])+", strip_comments(sql))
    return [p.strip() for p in parts if p.strip()]


def parse_kind(spark: SparkSession, sql: str) -> list[str]:
    """Class names of the plan's nodes, the root first; common table expressions included."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    names, todo = [], [plan]
    while todo:
        node = todo.pop(0)
        names.append(node.getClass().getSimpleName())
        for group in (node.children(), node.innerChildren()):
            todo += [c for c in (group.apply(i) for i in range(group.size())) if hasattr(c, "children") and "plans" in c.getClass().getName()]
    return names


def lint(spark: SparkSession, sql: str) -> str:
    """The one statement of ``sql`` if it is a query, else ``Refused``."""
    found = statements(sql)
    if len(found) != 1:
        raise Refused(f"one statement is asked for, not {len(found)}")
    kinds = parse_kind(spark, found[0])
    root = kinds[0]
    if any(k in _WRITES for k in kinds) or re.search("Command|Drop|Create|Alter|Truncate|Set|Refresh|Cache|Load|Analyze|Repair|Rename|Replace|Comment", root):
        if root not in ("SetOperation",) and not root.startswith("Union"):
            raise Refused(f"only queries are allowed; this is {root}")
    return found[0]


def auto_limit(spark: SparkSession, sql: str, most: int = MAX_ROWS) -> tuple[str, bool]:
    """The statement with a limit, and whether it was added. Set operations and CTEs are wrapped."""
    kinds = parse_kind(spark, sql)
    if kinds[0] in ("GlobalLimit", "LocalLimit", "ShowTablesCommand", "ExplainCommand") or kinds[:2] == ["UnresolvedWith", "GlobalLimit"]:
        return sql, False
    if kinds[0] in ("UnresolvedWith", "Union", "Distinct", "Intersect", "Except"):
        return f"SELECT * FROM ({sql}) LIMIT {most}", True
    return f"{sql} LIMIT {most}", True


@dataclass
class Page:
    """A bounded result: ``truncated`` says that the page is full and there was more, ``limited`` that a limit was added."""

    columns: list[str]
    rows: list[tuple]
    truncated: bool
    limited: bool
    notes: list[str] = field(default_factory=list)


def bound_cells(df: DataFrame, cell: int = CELL) -> DataFrame:
    return df.select([F.left(c, F.lit(cell)).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def repair_column(name: str, columns: list[str]) -> str | None:
    """The column that ``name`` is a typo of: like enough, and clearly more so than any other."""
    scored = sorted(((difflib.SequenceMatcher(None, name.lower(), c.lower()).ratio(), c) for c in columns), reverse=True)
    if not scored or scored[0][0] < TYPO or (len(scored) > 1 and scored[0][0] - scored[1][0] < AMBIGUITY):
        return None
    return scored[0][1]


def run_query(spark: SparkSession, sql: str, most: int = MAX_ROWS, args: dict | None = None) -> Page:
    """Lint, bound and run one query. One row more than the page is asked for, to know whether there are more."""
    statement = lint(spark, sql)
    _, limited = auto_limit(spark, statement, most)
    df = bound_cells(spark.sql(statement, args=args))
    rows = df.limit(most + 1).collect()  # bounded by the page
    return Page(df.columns, [tuple(r) for r in rows[:most]], len(rows) > most, limited)


def run_batch(spark: SparkSession, queries: list[str], most: int = MAX_ROWS) -> list[Page | str]:
    """Each query on its own; an error stands in its place and the others run."""
    out: list[Page | str] = []
    for sql in queries:
        try:
            out.append(run_query(spark, sql, most))
        except Exception as error:
            out.append(str(error).split("\n")[0])
    return out


# ---------------------------------------------------------------- introspection
#: Foreign keys of the tables; the catalog has none.
RELATIONSHIPS = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe_table(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]


def search_names(spark: SparkSession, word: str) -> list[str]:
    """Tables and columns whose name has ``word`` in it."""
    found = []
    for t in list_tables(spark):
        found += [t] * (word.lower() in t.lower()) + [f"{t}.{c}" for c, _ in describe_table(spark, t) if word.lower() in c.lower()]
    return found
