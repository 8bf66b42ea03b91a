"""Row lineage of SQL text: which base rows each output row came from, by Catalyst's parsed plan.

A query's nodes are rebuilt from below over frames with one hidden column, the row's own name
(``__out``); lineage is a long table (``__out``, ``row_id``) beside them.  Filters, projections, sorts and limits
keep names, so lineage stays as it is; a group names its rows by a digest of its keys, and its lineage
is the child's with those names.  No list of ids is gathered for any group, and a statement is run
once, not once for each of its clauses.

Joins, set operations, windows and recursive CTEs are refused, by name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import difficulty, guard
from .guard import kind
from .validate import Source

OUT = "__out"
#: Reason by plan node (fixed values: what callers get told).
REFUSED = {"Join": "joins_not_supported", "LateralJoin": "joins_not_supported", "Union": "set_ops_not_supported", "Intersect": "set_ops_not_supported", "Except": "set_ops_not_supported", "Window": "window_not_supported", "WithWindowDefinition": "window_not_supported"}
#: Step kinds that the progression shows (fixed values).
SHOWN = ("filter_where", "group_by", "filter_having", "project", "order_by")


class Refused(ValueError):
    """A statement that has no lineage here; its text is the reason."""


@dataclass
class Step:
    node_type: str
    label: str
    fragment: str
    rows: DataFrame  # row_id, distinct


@dataclass
class _Traced:
    frame: DataFrame  # with OUT
    lineage: DataFrame | None  # OUT, row_id; None: OUT is the row's id
    pending: str | None = None  # a projection that isn't told yet

    def ids(self) -> DataFrame:
        """Base rows of the frame's rows."""
        return self.long().select("row_id").distinct()

    def long(self) -> DataFrame:
        if self.lineage is None:
            return self.frame.select(OUT, F.col(OUT).alias("row_id"))
        return self.lineage.join(self.frame.select(OUT).distinct(), OUT, "left_semi").select(OUT, "row_id")


@dataclass
class Trace:
    """``result`` with ``__out``, ``lineage`` (``__out``, ``row_id``), the base rows scanned, and the steps."""

    result: DataFrame
    lineage: DataFrame
    scanned: DataFrame
    steps: list[Step] = field(default_factory=list)

    def answer(self) -> DataFrame:
        return self.result.drop(OUT)

    def contributing(self) -> DataFrame:
        return self.lineage.select("row_id").distinct()

    def progression(self, most_rows: int = 100_000) -> dict[str, object]:
        """Steps that change rows with their base rows, for one question's small table; more rows raise."""
        entries = []
        for s in self.steps:
            if s.node_type in SHOWN and s.fragment != "GLOBAL AGGREGATE":
                rows = sorted(r.row_id for r in s.rows.limit(most_rows + 1).collect())
                if len(rows) > most_rows:
                    raise ValueError(f"a step has more than {most_rows} rows")
                entries.append({"step_index": len(entries), "label": s.label, "node_type": s.node_type, "row_indices": rows, "row_count": len(rows)})
        return {"num_steps": len(entries), "max_row_count": max((e["row_count"] for e in entries), default=0), "steps": entries}

    def output_rows(self, most_rows: int = 100_000) -> list[list[object]]:
        """Base rows of each output row, in the result's order; more rows raise."""
        order = [r[OUT] for r in self.result.select(OUT).limit(most_rows + 1).collect()]
        if len(order) > most_rows:
            raise ValueError(f"the result has more than {most_rows} rows")
        found: dict[object, list] = {}
        for r in self.lineage.select(OUT, "row_id").collect():
            found.setdefault(r[OUT], []).append(r.row_id)
        return [sorted(found.get(name, [])) for name in order]


class _Walker:
    def __init__(self, base: DataFrame, key: str, relation: str) -> None:
        named = base.withColumn(OUT, F.col(key))
        self.source = Source(named, relation)
        self.session, self.jvm = self.source.session, self.source.session._jvm
        self.relations: dict[str, DataFrame | None] = {relation.lower(): None}
        self.base = self.session.table(relation).select(F.col(OUT).alias("row_id"))
        self.steps: list[Step] = []

    def _frame(self, plan: JavaObject) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.session._jsparkSession, plan), self.session)

    def _over(self, node: JavaObject, child: DataFrame) -> DataFrame:
        """``node`` with ``child`` in the place of its own."""
        return self._frame(node.withNewChildren(self._seq([child._jdf.queryExecution().analyzed()])))

    def _seq(self, items: list[JavaObject]) -> JavaObject:
        return self.jvm.org.apache.spark.api.python.PythonUtils.toSeq(items)

    def _expression(self, sql: str) -> JavaObject:
        return self.session._jsparkSession.sessionState().sqlParser().parseExpression(sql)

    def _column(self, expression: JavaObject):
        from pyspark.sql.classic.column import Column

        return Column(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))

    def _inside(self, expression: JavaObject, depth: int, children: list[JavaObject]) -> JavaObject:
        """``expression`` with ``children`` below its only descendant at ``depth``."""
        if depth:
            children = [self._inside(expression.children().head(), depth - 1, children)]
        return expression.withNewChildren(self._seq(children))

    def _tell(self, node_type: str, label: str, fragment: str, at: _Traced) -> None:
        self.steps.append(Step(node_type, label, fragment, at.ids()))

    def _flush(self, label: str, at: _Traced) -> None:
        if at.pending is not None:
            self._tell("project", label, at.pending, at)
            at.pending = None

    def query(self, plan: JavaObject, label: str) -> _Traced:
        """A whole SELECT with what stands around it."""
        if kind(plan) == "UnresolvedWith":
            if plan.allowRecursion():
                raise Refused("recursive_cte_not_supported")
            for pair in guard._sequence(plan.cteRelations()):
                name = pair._1()
                made = self.query(pair._2().child(), f"cte:{name}")
                made.frame.createOrReplaceTempView(name)
                self.relations[name.lower()] = made.lineage
            plan = plan.child()
        done = self.walk(plan, label)
        self._flush(label, done)
        self._tell("query", label, "", done)
        return done

    def walk(self, node: JavaObject, label: str) -> _Traced:
        name = kind(node)
        if name in REFUSED:
            raise Refused(REFUSED[name])
        if any(kind(e) in ("WindowExpression", "UnresolvedWindowExpression") for e in guard.expressions(node)):
            raise Refused("window_not_supported")
        if name == "UnresolvedRelation":
            relation = list(guard._sequence(node.multipartIdentifier()))[-1]
            if relation.lower() not in self.relations:
                raise Refused(f"unknown relation {relation}")
            at = _Traced(self._frame(node), self.relations[relation.lower()])
            self._tell("scan", label, relation, at)
            return at
        if name == "OneRowRelation":  # what needs no table is put down to all of it
            one = self._frame(node).withColumn(OUT, F.lit("all"))
            return _Traced(one, self.base.select(F.lit("all").alias(OUT), "row_id"))
        if name == "SubqueryAlias":
            inner = node.child()
            at = self.walk(inner, label) if kind(inner) == "UnresolvedRelation" else self.query(inner, f"subquery:{node.alias()}")
            return _Traced(self._over(node, at.frame), at.lineage)
        children = list(guard._sequence(node.children()))
        if len(children) != 1:
            raise Refused("from_shape_not_supported")
        at = self.walk(children[0], label)
        if name == "Filter":
            out = _Traced(self._over(node, at.frame), at.lineage)
            self._tell("filter_where", label, "WHERE", out)
            return out
        if name == "UnresolvedHaving":
            out = _Traced(self._over(node, at.frame), at.lineage, at.pending)
            self._tell("filter_having", label, "HAVING", out)
            return out
        if name == "Aggregate":
            return self._group(node, at, label)
        if name == "Project":
            columns = list(guard._sequence(node.projectList()))
            if any(kind(e) == "UnresolvedFunction" and list(guard._sequence(e.nameParts()))[-1].lower() in difficulty.AGGREGATES for c in columns for e in _all(c)):
                return self._aggregate([], columns, at, label)
            if not any(kind(c) in ("UnresolvedStar", "UnresolvedStarExceptOrReplace") for c in columns):
                columns.append(self._expression(OUT))
            plan = self.jvm.org.apache.spark.sql.catalyst.plans.logical.Project(self._seq(columns), at.frame._jdf.queryExecution().analyzed())
            return _Traced(self._frame(plan), at.lineage, "SELECT")
        if name == "Distinct":
            self._flush(label, at)
            shown = [c for c in at.frame.columns if c != OUT]
            named = at.frame.withColumn("__new", F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in shown)))))
            lineage = self._renamed(named.select("__new", OUT), at)
            return _Traced(named.groupBy("__new", *(f"`{c}`" for c in shown)).agg(F.lit(1).alias("__one")).drop("__one").withColumnRenamed("__new", OUT), lineage)
        if name in ("Sort", "GlobalLimit", "LocalLimit", "Offset"):
            self._flush(label, at)
            out = _Traced(self._over(node, at.frame), at.lineage)
            if name == "Sort":
                self._tell("order_by", label, "ORDER BY", out)
            return out
        raise Refused(f"{name} isn't supported")

    def _group(self, node: JavaObject, at: _Traced, label: str) -> _Traced:
        columns = list(guard._sequence(node.aggregateExpressions()))
        there = {c.lower() for c in at.frame.columns}
        aliases = {c.name().lower(): c.child() for c in columns if kind(c) == "Alias"}
        keys = []
        for g in guard._sequence(node.groupingExpressions()):
            if kind(g) == "UnresolvedAttribute" and g.name().lower() not in there and g.name().lower() in aliases:
                g = aliases[g.name().lower()]
            elif kind(g) == "UnresolvedOrdinal" or kind(g) == "Literal" and isinstance(g.value(), int):
                place = columns[(g.ordinal() if kind(g) == "UnresolvedOrdinal" else g.value()) - 1]
                g = place.child() if kind(place) in ("Alias", "UnresolvedAlias") else place
            elif kind(g) in ("GroupingSets", "Cube", "Rollup"):
                raise Refused("grouping_sets_not_supported")
            keys.append(g)
        return self._aggregate(keys, columns, at, label)

    def _aggregate(self, keys: list[JavaObject], columns: list[JavaObject], at: _Traced, label: str) -> _Traced:
        if keys:
            names = at.frame.select(F.md5(F.to_json(F.struct(*(self._column(k).alias(f"k{i}") for i, k in enumerate(keys))))).alias("__new"), OUT)
            pairs = [x for i, k in enumerate(keys) for x in (self._expression(f"'k{i}'"), k)]
            hidden = self._inside(self._expression(f"md5(to_json(named_struct({', '.join('x' for _ in pairs)}))) AS {OUT}"), 3, pairs)
        else:
            names = at.frame.select(F.lit("all").alias("__new"), OUT)
            hidden = self._expression(f"'all' AS {OUT}")
        plan = self.jvm.org.apache.spark.sql.catalyst.plans.logical.Aggregate(self._seq(keys), self._seq([*columns, hidden]), at.frame._jdf.queryExecution().analyzed(), self.jvm.scala.Option.empty())
        out = _Traced(self._frame(plan), self._renamed(names, at), "SELECT")
        self._tell("group_by", label, "GROUP BY" if keys else "GLOBAL AGGREGATE", out)
        return out

    @staticmethod
    def _renamed(names: DataFrame, at: _Traced) -> DataFrame:
        """Lineage by new names; ``names`` has ``__new`` and the old ones."""
        if at.lineage is None:
            return names.select(F.col("__new").alias(OUT), F.col(OUT).alias("row_id"))
        return names.join(at.lineage, OUT).select(F.col("__new").alias(OUT), "row_id").distinct()


def _all(expression: JavaObject):  # noqa: ANN202
    stack = [expression]
    while stack:
        e = stack.pop()
        yield e
        stack += guard._sequence(e.children())


def _line(error: Exception) -> str:
    """The first line of an error that says something."""
    return next((x.strip() for x in str(error).splitlines() if x.strip()), type(error).__name__)


def trace(base: DataFrame, key: str, sql: str, relation: str = "df") -> Trace:
    """Lineage of ``sql`` over ``base``, whose rows ``key`` names; the guard's refusals and those of shapes raise."""
    walker = _Walker(base, key, relation)
    if why := guard.why_not(walker.session, sql, (relation,)):
        raise Refused(why)
    done = walker.query(guard.parse(walker.session, sql.strip().rstrip(";")), "final_query")
    return Trace(done.frame, done.long(), walker.base, walker.steps)


def describe(base: DataFrame, key: str, sql: str, relation: str = "df") -> dict[str, object]:
    """Lineage of one question's result as plain values; a refusal or an error is told in place of it."""
    try:
        t = trace(base, key, sql, relation)
        outputs, contributing = t.output_rows(), sorted(r.row_id for r in t.contributing().collect())
        scanned = sorted(r.row_id for r in t.scanned.collect())
        steps = [{"node_id": f"n{i + 1}", "node_type": s.node_type, "label": s.label, "sql_fragment": s.fragment} for i, s in enumerate(t.steps)]
        return {
            "provenance_supported": True, "provenance_error": None, "row_indices_scanned": scanned, "row_indices_contributing": contributing, "row_indices_scanned_count": len(scanned),
            "row_indices_contributing_count": len(contributing), "output_row_provenance": outputs, "provenance_steps": steps, "step_row_progression": t.progression(),
        }
    except (Refused, Py4JJavaError, PySparkException) as e:
        return {
            "provenance_supported": False, "provenance_error": _line(e), "row_indices_scanned": [], "row_indices_contributing": [], "row_indices_scanned_count": 0,
            "row_indices_contributing_count": 0, "output_row_provenance": None, "provenance_steps": [], "step_row_progression": {"num_steps": 0, "max_row_count": 0, "steps": []},
        }


def projection(session, sql: str, base_columns: list[str]) -> dict[str, object]:
    """Columns that a statement's stages derive and put out, and the source columns that it names."""
    try:
        plan = guard.parse(session, sql.strip().rstrip(";"))
    except (Py4JJavaError, PySparkException) as e:
        return {"targeted_source_column_count": None, "targeted_source_columns": [], "max_derived_column_count": None, "max_stage_column_count": None, "stage_projection_counts": [], "error": _line(e)}
    stages, named = [], set()
    for node, _ in sorted(guard.nodes(plan), key=lambda n: n[1]):
        if kind(node) not in ("Project", "Aggregate"):
            continue
        columns = list(guard._sequence(node.projectList() if kind(node) == "Project" else node.aggregateExpressions()))
        derived = width = 0
        for c in columns:
            inner = c
            while kind(inner) in ("Alias", "UnresolvedAlias"):
                inner = inner.child()
            star = kind(inner) == "UnresolvedStar"
            derived += not star and kind(inner) != "UnresolvedAttribute"
            width += len(base_columns) if star else 1
            named |= {list(guard._sequence(e.nameParts()))[-1] for e in _all(c) if kind(e) == "UnresolvedAttribute"}
        stages.append({"stage_index": len(stages), "derived_column_count": int(derived), "output_column_count": width})
    return {
        "targeted_source_column_count": len(named), "targeted_source_columns": sorted(named), "max_derived_column_count": max((s["derived_column_count"] for s in stages), default=0),
        "max_stage_column_count": max((s["output_column_count"] for s in stages), default=None), "stage_projection_counts": stages, "error": None,
    }
