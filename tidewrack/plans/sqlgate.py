"""Read-only SQL over the corpus: one statement, no side effects, and suggestions for names that are not there."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tidewrack.functions.limits import BadArgument, limit

#: Plan nodes that are commands: anything that would write, create, drop, set or load.
COMMAND = re.compile(r"Command|^'?(Insert|Create|Drop|Alter|Overwrite|Append|Delete|Update|Merge|Replace|Truncate|Load|Set|Cache|Uncache|Refresh|Add|Analyze|Use)")
#: Functions that run code of the driver or the executors, or reach beyond the corpus.
UNSAFE = {"reflect", "java_method", "try_reflect", "read_files", "input_file_name"}
#: A relation of two parts whose first is a format is a file, not a table.
FORMATS = {"parquet", "csv", "json", "orc", "text", "avro", "binaryfile", "xml", "delta", "image", "libsvm", "jdbc", "binary"}
#: Names that are no columns and what to use.
HINTS = {"project": "project_path", "tool": "tool_name or name", "created_at": "started_at", "tokens": "input_tokens and output_tokens"}


@dataclass
class Answer:
    rows: DataFrame
    row_count: int
    truncated: bool
    warnings: list[str] = field(default_factory=list)


def statement(sql: str) -> str:
    """The one statement in ``sql``, without comments before it; others are refused."""
    text = re.sub(r"^(?:\s+|--[^\n]*\n|/\*.*?\*/)+", "", sql + "\n", flags=re.S).strip()
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", text).rstrip("; \n")
    if ";" in bare:
        raise BadArgument("one statement at a time")
    text = text.rstrip("; \n")
    if not re.match(r"(?i)(select|with|explain|describe|show\s+(tables|columns))\b", text):
        raise BadArgument("only SELECT, WITH, EXPLAIN, DESCRIBE and SHOW TABLES or COLUMNS")
    return text


def _nodes(plan):
    """All nodes of a parsed plan, subqueries and the plans of WITH included, by Catalyst's own traversal."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for seq in (node.children(), node.innerChildren(), node.subqueries()):
            todo += [seq.apply(k) for k in range(seq.size())]


def guard(spark: SparkSession, text: str) -> None:
    """Refuse a statement whose parsed plan has a command, a function that runs code, or a relation that is a file."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if COMMAND.search(name):
            raise BadArgument("the statement would change something")
        if name == "UnresolvedRelation":
            parts = [node.multipartIdentifier().apply(k) for k in range(node.multipartIdentifier().size())]
            if len(parts) > 1 and parts[0].lower() in FORMATS:
                raise BadArgument("only tables can be read, not files")
    words = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    called = {m.lower() for m in re.findall(r"`?([A-Za-z_][A-Za-z0-9_]*)`?\s*\(", words)}
    if called & UNSAFE:
        raise BadArgument(f"{', '.join(sorted(called & UNSAFE))} cannot be called")


def predicate(spark: SparkSession, text: str) -> str:
    """A condition that came as text: one expression, under the same guard as a statement."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", text)
    if ";" in bare or "--" in bare or "/*" in bare:
        raise BadArgument("a condition is one expression without comments")
    guard(spark, f"SELECT 1 FROM t WHERE ({text})")
    spark._jsparkSession.sessionState().sqlParser().parseExpression(f"({text})")
    return text


def query(spark: SparkSession, sql: str, asked_limit: object = None) -> Answer:
    """Run one read-only statement. The parsed plan is inspected before anything runs."""
    text, n = statement(sql), limit("query", asked_limit)
    if re.match(r"(?i)select|with", text):
        try:
            guard(spark, text)
        except ParseException as bad:
            raise BadArgument(str(bad)) from bad
    try:
        rows = spark.sql(text)
        rows.schema  # noqa: B018  analysed here, so that unknown names are told below
    except AnalysisException as bad:
        raise BadArgument(f"{bad}\n{suggest(spark, str(bad))}".strip()) from bad
    count = rows.count()
    return Answer(rows.limit(n), count, count > n)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def closest(name: str, known: list[str], most: int = 3) -> list[str]:
    """Up to three known names within an edit distance of max(3, a third of the length)."""
    reach = max(3, -(-len(name) // 3))
    ranked = sorted((distance(name.lower(), k.lower()), k) for k in known)
    return [k for d, k in ranked if d <= reach][:most]


def suggest(spark: SparkSession, message: str) -> str:
    """What may have been meant by a table or column that is not known."""
    m = re.search(r"(?:table or view|TABLE_OR_VIEW_NOT_FOUND)[^`]*`([^`]+)`", message)
    tables = [t.name for t in spark.catalog.listTables()]
    if m:
        found = closest(m[1].split(".")[-1], tables)
        return f"Did you mean {', '.join(found)}?" if found else ""
    m = re.search(r"with name `(?:[^`]+`\.`)?([^`]+)`", message)
    if not m:
        return ""
    name = m[1]
    columns = sorted({c.name for t in tables for c in spark.catalog.listColumns(t)})
    found = closest(name, columns)
    hint = f" Use {HINTS[name.lower()]}." if name.lower() in HINTS else ""
    return (f"Did you mean {', '.join(found)}?" if found else "") + hint
