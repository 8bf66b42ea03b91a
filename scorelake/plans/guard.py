"""Guard for SQL of unknown origin: decided on the parsed plan, not on the text.

A statement passes if it parses as one query, names only known single-part relations or its own CTEs,
and calls only allowed functions.  Files named as tables, table functions, reflection calls and
commands don't pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

#: Functions that reach outside the query or its session (fixed values).
FORBIDDEN = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user current_database current_catalog version raise_error sleep".split())


def parse(spark: SparkSession, sql: str) -> JavaObject:
    """Catalyst's parsed (unresolved) plan."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _sequence(items: JavaObject) -> Iterator[JavaObject]:
    it = items.iterator()
    while it.hasNext():
        yield it.next()


def kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def expressions(node: JavaObject) -> Iterator[JavaObject]:
    """Expressions of a plan node and all below them."""
    stack = list(_sequence(node.expressions()))
    while stack:
        e = stack.pop()
        yield e
        stack += _sequence(e.children())


def nodes(plan: JavaObject, depth: int = 1) -> Iterator[tuple[JavaObject, int]]:
    """Plan nodes with their query depth: CTE bodies, subqueries in expressions and derived tables are
    one deeper than the query that holds them."""
    stack = [(plan, depth)]
    while stack:
        node, d = stack.pop()
        yield node, d
        if kind(node) == "UnresolvedWith":
            stack += [(pair._2(), d) for pair in _sequence(node.cteRelations())]  # derived tables by their names
        deeper = d + 1 if kind(node) == "SubqueryAlias" and kind(node.child()) not in ("UnresolvedRelation", "UnresolvedInlineTable") else d
        stack += [(c, deeper) for c in _sequence(node.children())]
        for e in expressions(node):
            if kind(e) in SUBQUERIES and kind(e) != "InSubquery":  # that one holds a ListQuery
                stack.append((e.plan(), d + 1))


SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "UnresolvedScalarSubquery", "LateralSubquery")
#: Plan nodes of queries.
QUERY_NODES = frozenset("Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct Join SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith CTERelationDef Union Intersect Except OneRowRelation UnresolvedInlineTable WithWindowDefinition Window LocalRelation".split())


def why_not(spark: SparkSession, sql: object, relations: Iterable[str] = ("df",)) -> str | None:
    """Reason to refuse ``sql``, None if it may run."""
    if not isinstance(sql, str) or not sql.strip():
        return "no SQL"
    try:
        plan = parse(spark, sql.strip().rstrip(";"))
    except (Py4JJavaError, PySparkException) as e:
        return f"it doesn't parse: {str(e).strip().splitlines()[0][:200]}"
    known = {r.lower() for r in relations}
    found = list(nodes(plan))
    for node, _ in found:
        if kind(node) == "UnresolvedWith":
            known |= {pair._1().lower() for pair in _sequence(node.cteRelations())}
    for node, _ in found:
        if kind(node) not in QUERY_NODES:
            return f"{kind(node)} isn't part of a query"
        if kind(node) == "UnresolvedRelation":
            parts = list(_sequence(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in known:
                return f"unknown relation {'.'.join(parts)}"
        for e in expressions(node):
            if kind(e) == "UnresolvedFunction":
                name = list(_sequence(e.nameParts()))
                if len(name) != 1 or name[0].lower() in FORBIDDEN:
                    return f"function {'.'.join(name)} isn't allowed"
            elif kind(e) in ("PythonUDF", "ScalaUDF"):
                return f"{kind(e)} isn't allowed"
    return None


def is_read_only(spark: SparkSession, sql: object, relations: Iterable[str] = ("df",)) -> bool:
    return why_not(spark, sql, relations) is None
