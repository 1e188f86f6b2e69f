"""Read-only SQL over the fact table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection, Iterator

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession, functions as F

# Words that end a query, as whole words.
FORBIDDEN = ("drop", "update", "delete", "insert", "alter", "create", "replace")
# Where expressions of built-in functions live, and those of them that reach outside the
# query: code of any class, functions of the session's users, names of stored files.
BUILT_IN = "org.apache.spark.sql.catalyst."
OUTSIDE = frozenset(
    ("CallMethodViaReflection", "TryReflect", "ScalaUDF", "ScalaAggregator", "ScalaUDAF", "PythonUDF", "PythonUDAF",
     "InputFileName", "InputFileBlockStart", "InputFileBlockLength")
)
# Nodes without a child that read no stored data.
LEAVES = frozenset(("OneRowRelation", "LocalRelation", "Range", "CTERelationRef"))

# What the letters of a strftime format stand for, as Spark patterns.
STRFTIME_PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS",
    "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
}


def _strftime_function() -> str:
    """A function that renders a format piece by piece and leaves other text alone."""
    cases = " ".join(f"WHEN '%{c}' THEN date_format(ts, '{p}')" for c, p in STRFTIME_PATTERNS.items())
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION strftime(ts TIMESTAMP, fmt STRING) RETURNS STRING
RETURN array_join(transform(regexp_extract_all(fmt, '%.?|[^%]+', 0), piece -> CASE piece {cases}
  WHEN '%u' THEN string(weekday(ts) + 1) WHEN '%w' THEN string(dayofweek(ts) - 1) WHEN '%%' THEN '%'
  ELSE CASE WHEN startswith(piece, '%') THEN raise_error('strftime does not know ' || piece) ELSE piece END END), '')
"""


STRFTIME = _strftime_function()

TOP_PAYMENT_TYPES = """
SELECT payment_type, orders, double(total) AS revenue
FROM (SELECT payment_type, count(1) AS orders, sum(CAST(gross_revenue AS DECIMAL(18,2))) AS total
      FROM facts GROUP BY payment_type)
ORDER BY total DESC, payment_type LIMIT 10
"""
WORST_STATES = """
SELECT customer_state, punctual / orders AS on_time_rate, orders
FROM (SELECT customer_state, count_if(on_time) AS punctual, count(1) AS orders FROM facts GROUP BY customer_state)
WHERE orders > 100
ORDER BY on_time_rate, customer_state LIMIT 10
"""
MONTHLY_SALES = """
SELECT ym, count(1) AS orders, double(sum(money)) AS revenue
FROM (SELECT strftime(order_purchase_timestamp, '%Y-%m') AS ym, CAST(gross_revenue AS DECIMAL(18,2)) AS money
      FROM facts)
GROUP BY ym ORDER BY ym
"""
AUTO_ANALYSIS = {
    "top_payment_types": TOP_PAYMENT_TYPES,
    "worst_states": WORST_STATES,
    "monthly_sales": MONTHLY_SALES,
}


class RefusedQuery(ValueError):
    """The text is not a single read-only SELECT over the registered views."""


# Quoted text (raw, single, double), comments, and quoted names, whichever comes first.
_QUOTED = re.compile(
    r"""\br'[^']*'|\br"[^"]*"|'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*"|--[^\n]*|/\*.*?\*/|`(?P<name>[^`]*)`""",
    re.S,
)


def _bare(statement: str) -> str:
    """The statement in lower case without quoted text and comments."""
    return _QUOTED.sub(lambda m: f" {m['name'] or ''} ", statement.lower())


def check(sql: str) -> str:
    """Return the statement to run, or raise ``RefusedQuery``.

    Words are compared whole and outside quoted text, so a column named
    ``created_at`` or the text ``'drop'`` is fine.
    """
    statement = sql.strip().rstrip(";").strip()
    bare = _bare(statement)
    words = re.findall(r"[a-z_][a-z_0-9]*", bare)
    if not words or words[0] != "select":
        raise RefusedQuery("only SELECT statements are run")
    if ";" in bare:
        raise RefusedQuery("one statement at a time")
    refused = sorted({*FORBIDDEN} & set(words))
    if refused:
        raise RefusedQuery(f"not allowed in a read-only query: {', '.join(refused)}")
    return statement


def _items(sequence) -> Iterator:
    """The elements of a Scala sequence."""
    return (sequence.apply(k) for k in range(sequence.size()))


def _expressions(plan) -> Iterator:
    """All expressions of one node of a plan, those inside others, too."""
    open_ = list(_items(plan.expressions()))
    while open_:
        expression = open_.pop()
        yield expression
        open_ += _items(expression.children())


def _refuse_beyond(plan, views: Collection[str]) -> None:
    """Raise unless the analysed plan reads nothing but the views and calls nothing outside.

    Names are resolved by then, so aliases, quoted names, common table expressions,
    subqueries anywhere and names made at run time cannot hide a table.
    """
    named = {name.lower() for name in views}
    open_ = [plan]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind == "View":
            identifier = node.desc().identifier()
            if identifier.database().isEmpty() and identifier.table().lower() in named:
                continue  # what a registered view reads is its owner's choice
            raise RefusedQuery(f"only the registered views can be read, not {identifier.table()}")
        children = [*_items(node.children()), *_items(node.subqueries())]
        if node.children().isEmpty() and kind not in LEAVES:
            raise RefusedQuery(f"only the registered views can be read, not a {kind}")
        for expression in _expressions(node):
            group, _, name = expression.getClass().getName().rpartition(".")
            if name.rstrip("$") in OUTSIDE or not group.startswith(BUILT_IN):
                raise RefusedQuery(f"not allowed in a read-only query: {expression.prettyName()}")
        open_ += children


def query(sql: str, **views: DataFrame) -> DataFrame:
    """Run one SELECT over the given views, e.g. ``query(text, facts=facts)``.

    The statement is analysed in a session of its own that sees these views
    only: no other temporary views, and no files by path.
    """
    statement = check(sql)
    spark = next(iter(views.values())).sparkSession
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.sql(STRFTIME)
    shared = {name: f"{name}_{uuid.uuid4().hex}" for name in views}
    try:
        for name, df in views.items():
            # Dropping a view un-caches its plan, so the view must not have the
            # same plan as the caller's, possibly cached, table.
            df.filter(F.lit(True)).createGlobalTempView(shared[name])
            session.sql(f"CREATE TEMPORARY VIEW {name} AS SELECT * FROM global_temp.{shared[name]}")
        parsed = session._jsparkSession.sessionState().sqlParser().parsePlan(statement)
        if is_instance_of(spark.sparkContext._gateway, parsed, "org.apache.spark.sql.catalyst.plans.logical.Command"):
            raise RefusedQuery("only SELECT statements are run")
        found = session.sql(statement)  # analysed only, as it is no command
        _refuse_beyond(found._jdf.queryExecution().analyzed(), views)
        return found
    finally:
        for name in shared.values():
            spark.catalog.dropGlobalTempView(name)
