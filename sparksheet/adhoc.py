"""One read-only SQL statement over a table called data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .functions.columns import SheetError

MOST_ROWS = 10_000
#: What a statement may be made of, expressions with a query in them, and functions that call into the virtual machine.
NODES = (
    "Project", "Filter", "Aggregate", "Sort", "Distinct", "Deduplicate", "GlobalLimit", "LocalLimit", "Offset", "Join", "LateralJoin", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedWith", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "UnresolvedInlineTable", "OneRowRelation", "WithWindowDefinition", "Generate", "Pivot", "Unpivot", "UnresolvedTableValuedFunction", "Sample",
)
SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")
FORBIDDEN = ("java_method", "reflect", "try_reflect")


def refuse(spark, sql: str) -> None:
    """Raises unless every node of the parsed statement, subqueries too, is one of a query, over the table data or the statement's own."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise SheetError(f"not one statement: {str(e).splitlines()[0]}") from e

    def seq(x) -> list:
        return [x.apply(i) for i in range(x.size())]

    # Each node with the names that its own and the enclosing WITHs give it.
    todo = [(tree, frozenset({"data"}))]
    while todo:
        node, known = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind not in NODES:
            raise SheetError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedWith":
            inner = known
            for pair in seq(node.cteRelations()):  # each sees those before it
                todo.append((pair._2(), inner))
                inner = inner | {pair._1().lower()}
            known = inner
        if kind == "UnresolvedRelation" and (name := ".".join(seq(node.multipartIdentifier())).lower()) not in known:
            raise SheetError(f"no table {name!r}: there is data only")
        todo += [(child, known) for child in seq(node.children())]
        exprs = seq(node.expressions())
        while exprs:
            e = exprs.pop()
            what = e.getClass().getSimpleName()
            if what == "UnresolvedFunction" and (name := ".".join(seq(e.nameParts())).lower()).rpartition(".")[2] in FORBIDDEN:
                raise SheetError(f"{name} is not allowed")
            if what in SUBQUERIES:
                todo.append((e.plan(), known))
            elif "Subquery" in what and what != "InSubquery":  # its own query is among its children
                raise SheetError(f"only queries are allowed, not {what}")
            exprs += seq(e.children())


def query(df: DataFrame, sql: str, limit: int = 1000) -> DataFrame:
    """The first rows of a query; statements that are not queries, or name another table than data, are refused before they run.  A view `data` of the session's own stays as it was."""
    return answer(df, sql, limit)[0]


def answer(df: DataFrame, sql: str, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The first rows of a query, and those with one more: if there are more of these, rows were cut off."""
    spark = df.sparkSession
    refuse(spark, sql)
    before = spark.table("data") if spark.catalog.tableExists("data") and any(t.name == "data" and t.isTemporary for t in spark.catalog.listTables()) else None
    df.createOrReplaceTempView("data")
    try:
        made = spark.sql(sql)
    finally:
        if before is None:
            spark.catalog.dropTempView("data")
        else:
            before.createOrReplaceTempView("data")
    most = min(limit, MOST_ROWS)
    return made.limit(most), made.limit(most + 1)
