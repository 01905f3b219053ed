"""Read-only SQL for callers that are not trusted with more.

The statement becomes a subquery of a SELECT, so whatever is not a query fails to parse; words such
as `updated_at` or a literal 'Drop' stay allowed. What it may read is decided on the plan that Spark's
parser makes of it, before any name is looked up: a relation that is neither a registered view nor a
common table expression of the statement is refused, whether or not such a table or file exists, and
without a file being opened. The analysed plan is looked at as well: calls into the JVM by name are
refused wherever they stand, and so is any leaf but views and rows of the statement's own. What a
registered view contains is its owner's business.
"""

import re
from collections.abc import Iterator, Sequence

from py4j.java_gateway import JavaObject
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from wattquill.fixed_values import DEFAULT_ROW_LIMIT

_VIEW = "View"
# leaves that hold no stored data
_OWN_ROWS = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}
_WRAPPERS = {"SubqueryAlias", "WithCTE"}


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _items(sequence: JavaObject) -> list[JavaObject]:
    return [sequence.apply(i) for i in range(sequence.size())]


def _expressions(expression: JavaObject) -> Iterator[JavaObject]:
    pending = [expression]
    while pending:
        current = pending.pop()
        yield current
        pending += _items(current.children())


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    """The nodes of a plan and of the subqueries in its expressions, down to registered views."""
    pending = [plan]
    while pending:
        node = pending.pop()
        yield node
        if _kind(node) != _VIEW:
            pending += _items(node.children()) + _items(node.subqueries())


def _parts(relation: JavaObject) -> list[str]:
    return _items(relation.multipartIdentifier())


def _refuse_unregistered_relations(spark: SparkSession, plan: JavaObject) -> None:
    """Decides on the parser's plan, in which no relation has been resolved.

    A name of a common table expression is let through wherever it stands: outside of its scope it
    would be a table of the catalog, which the analysed plan shows.
    """
    catalog = spark._jsparkSession.sessionState().catalog()
    expressions: set[str] = set()
    relations: list[list[str]] = []
    pending = [plan]
    while pending:
        node = pending.pop()
        kind = _kind(node)
        if kind == "UnresolvedRelation":
            relations.append(_parts(node))
        elif "UnresolvedIdentifier" in kind:
            raise ValueError("only registered views may be read, by a name written out")
        if kind == "UnresolvedWith":
            inner = _items(node.innerChildren())
            expressions |= {str(alias.alias()).lower() for alias in inner}
            pending += inner
        pending += _items(node.children()) + _items(node.subqueries())
    for parts in relations:
        known = len(parts) == 1 and (
            parts[0].lower() in expressions or catalog.getTempView(parts[0]).isDefined()
        )
        if not known:
            raise ValueError(f"only registered views may be read, not {'.'.join(parts)}")


def _refuse_what_is_not_a_query_over_views(plan: JavaObject) -> None:
    for node in _nodes(plan):
        if _kind(node) == _VIEW:
            continue
        if not node.children().size() and _kind(node) not in _OWN_ROWS:
            raise ValueError(f"only registered views may be read, not a {_kind(node)}")
        for top in _items(node.expressions()):
            for expression in _expressions(top):
                if "Reflect" in _kind(expression):
                    name = expression.prettyName()
                    raise ValueError(f"{name} is not allowed, only read-only SELECT is")


def _has_own_limit(plan: JavaObject) -> bool:
    """Whether the statement inside the outer SELECT, not one of its subqueries, ends in LIMIT."""
    node = plan.children().apply(0)
    while _kind(node) in _WRAPPERS:
        node = node.plan() if _kind(node) == "WithCTE" else node.children().apply(0)
    return _kind(node) == "GlobalLimit"


def dedup_names(names: Sequence[str]) -> list[str]:
    """`id, id` becomes `id, id_1`, as after SELECT * over a join."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, n = name, 0
        while candidate.lower() in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate.lower())
        result.append(candidate)
    return result


def guarded_sql(
    spark: SparkSession,
    query: str,
    row_limit: int | None = DEFAULT_ROW_LIMIT,
    strict: bool = True,
) -> DataFrame:
    """The result of a SELECT as a lazy DataFrame of at most `row_limit` rows.

    `row_limit=None` leaves the result whole, for use inside a larger job. With `strict=False` a
    LIMIT of the statement's own replaces `row_limit`, even a larger one. A refused statement raises
    ValueError, a failing one RuntimeError.
    """
    text = re.sub(r"[;\s]+\Z", "", query)
    statement = f"SELECT * FROM (\n{text}\n)"
    try:
        _refuse_unregistered_relations(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(statement))
        df = spark.sql(statement)
        plan = df._jdf.queryExecution().analyzed()
    except PySparkException as error:
        if "PARSE_SYNTAX_ERROR" in str(error):
            raise ValueError(f"only a single read-only SELECT is allowed: {error}") from error
        raise RuntimeError(f"query failed: {error}") from error
    _refuse_what_is_not_a_query_over_views(plan)
    if row_limit is not None and (strict or not _has_own_limit(plan)):
        df = df.limit(int(row_limit))
    return df.toDF(*dedup_names(df.columns))


def preview(df: DataFrame, row_limit: int = DEFAULT_ROW_LIMIT) -> dict:
    """Columns, rows and row count of the first rows: the only place where rows reach the driver."""
    rows = [list(row) for row in df.limit(row_limit).collect()]
    return {"columns": df.columns, "rows": rows, "row_count": len(rows)}
