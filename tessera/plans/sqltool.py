"""Read-only SQL: one query statement, guarded by Spark's own parser, and the dispatch of tools by name."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

from py4j.java_gateway import is_instance_of
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import databases
from tessera.sources.databases import TIMEOUT_S, Database

REJECTED = "only SELECT queries are allowed"
#: Nodes of a parsed query. Any other node is refused: commands, writes, and what a later parser may bring.
NODES = frozenset(
    "Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Limit Offset Tail Distinct Deduplicate Join LateralJoin AsOfJoin Union Except Intersect "
    "SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith UnresolvedInlineTable LocalRelation OneRowRelation Range Generate "
    "UnresolvedTableValuedFunction UnresolvedTVFAliases WithWindowDefinition Window Pivot Unpivot Sample UnresolvedHint ResolvedHint UnionLoop UnresolvedOrdinal".split()
)
#: Functions that run code or read files by name, and the table functions that are allowed.
FUNCTIONS_REFUSED = frozenset(("reflect", "java_method", "try_reflect"))
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
_PLAN, _SUBQUERY = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", "org.apache.spark.sql.catalyst.expressions.PlanExpression"
LOG_SCHEMA = "at timestamp, tool string, statement string, seconds double, n_rows long, error string"


def _items(sequence) -> Iterator:
    return (sequence.apply(i) for i in range(sequence.size()))


def _short(node) -> str:
    return node.getClass().getName().rsplit(".", 1)[-1].rstrip("$")


def is_query(spark: SparkSession, text: str, remote: bool = False) -> bool:
    """Whether text is one statement that only reads: all its nodes are in NODES, also below WITH and in subqueries.

    Tables are named as such, not by a path or a format; a database before the name must exist, unless remote, where
    another system knows it.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception:  # noqa: BLE001  a text that does not parse is not a query
        return False
    plans = [plan]
    while plans:
        node = plans.pop()
        name = _short(node)
        if name not in NODES:
            return False
        if name == "UnresolvedRelation" and not _known(spark, list(_items(node.multipartIdentifier())), remote):
            return False
        if name == "UnresolvedTableValuedFunction" and list(_items(node.name()))[-1].lower() not in TABLE_FUNCTIONS:
            return False
        inner = [x for x in _items(node.innerChildren()) if is_instance_of(spark.sparkContext._gateway, x, _PLAN)]
        plans += [*_items(node.children()), *inner]
        expressions = list(_items(node.expressions()))
        while expressions:
            e = expressions.pop()
            if _short(e) == "UnresolvedFunction" and list(_items(e.nameParts()))[-1].lower() in FUNCTIONS_REFUSED:
                return False
            if is_instance_of(spark.sparkContext._gateway, e, _SUBQUERY):
                plans.append(e.plan())
            expressions += list(_items(e.children()))
    return True


def _known(spark: SparkSession, parts: list[str], remote: bool) -> bool:
    if any(c in part for part in parts for c in "/\\:"):
        return False
    return len(parts) == 1 or remote or (len(parts) == 2 and spark.catalog.databaseExists(parts[0]))


def query(spark: SparkSession, text: str, limit: int | None = None, database: Database | None = None) -> DataFrame:
    """The result of a read-only query, of the session's tables or of a database; ValueError for anything else."""
    if not is_query(spark, text, remote=database is not None):
        raise ValueError(REJECTED)
    result = databases.table(spark, database, text) if database else spark.sql(text)
    return result.limit(limit) if limit is not None else result


def payload(spark: SparkSession, text: str, limit: int | None = None, database: Database | None = None, timeout: float = TIMEOUT_S, log: QueryLog | None = None, tool: str = "") -> dict:
    """{rows, select[, error]} for a caller that wants rows: all of them, or with a limit that many and then truncated.

    A query that runs for more than timeout seconds is cancelled, which is an error.
    """
    started, tag = time.time(), f"sqltool-{uuid.uuid4().hex}"
    out: dict = {"rows": [], "select": text}

    def collected() -> list:
        spark.addTag(tag)
        return query(spark, text, None if limit is None else limit + 1, database).collect()

    # in a thread of its own: the caller is answered in time even if tasks are slow to notice that they are cancelled
    waiting = ThreadPoolExecutor(1)
    try:
        found = waiting.submit(inheritable_thread_target(spark)(collected)).result(timeout)
        out["rows"] = [r.asDict(recursive=True) for r in found[:limit]]
        if limit is not None and len(found) > limit:
            out["truncated"] = True
    except FutureTimeout:
        spark.interruptTag(tag)
        out["error"] = f"no result within {timeout:g} s"
    except Exception as e:  # noqa: BLE001  the caller gets the reason, not a crash
        out["error"] = str(e)
    finally:
        waiting.shutdown(wait=False)
    if log is not None:
        log.add(tool, text, time.time() - started, len(out["rows"]), out.get("error"))
    return out


class QueryLog:
    """The calls of a session, kept until they are written to a table; the slowest of all that were written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._rows = spark, path, []

    def add(self, tool: str, statement: str, seconds: float, n_rows: int, error: str | None) -> None:
        self._rows.append((time.time(), tool, statement, seconds, n_rows, error))

    def write(self) -> None:
        """Append what was added since the last write."""
        rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, LOG_SCHEMA.replace("at timestamp", "at double")).withColumn("at", F.timestamp_seconds("at")).write.mode("append").parquet(self.path)

    def slowest(self, n: int = 10) -> DataFrame:
        return slowest(self.spark.read.schema(LOG_SCHEMA).parquet(self.path), n)


def slowest(log: DataFrame, n: int = 10) -> DataFrame:
    """statement, calls, total_s, longest_s, n_rows of the n statements that took longest in all; ties by statement."""
    per = log.groupBy("statement").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total_s"), F.max("seconds").alias("longest_s"), F.sum("n_rows").alias("n_rows"))
    return per.orderBy(F.desc("total_s"), "statement").limit(n)


class Tools:
    """Tools by name: each returns a DataFrame or a payload."""

    def __init__(self) -> None:
        self._tools: dict[str, tuple[str, Callable]] = {}

    def add(self, name: str, function: Callable, description: str = "") -> None:
        self._tools[name] = (description, function)

    def add_databases(self, spark: SparkSession, registered: dict[str, Database], log: QueryLog | None = None) -> None:
        """A SELECT tool for each registered database, which runs there."""
        for name, database in registered.items():
            self.add(name, lambda select, name=name, database=database: payload(spark, select, database=database, log=log, tool=name), database.description or "")

    def add_session(self, spark: SparkSession, name: str, description: str = "", log: QueryLog | None = None) -> None:
        """A SELECT tool over the session's own tables."""
        self.add(name, lambda select: payload(spark, select, log=log, tool=name), description)

    def describe(self) -> dict[str, str]:
        return {name: description for name, (description, _) in self._tools.items()}

    def call(self, name: str, **arguments):
        if name not in self._tools:
            return {"error": f"unknown tool {name}"}
        return self._tools[name][1](**arguments)
