"""Registry of databases from the environment, and their tables as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from itertools import count, takewhile

from pyspark.sql import DataFrame, SparkSession

TIMEOUT_S = 30
_SETTING = re.compile(r"DB_(\d+)_(URL|USERNAME|PASSWORD|DESCRIPTION|TOOL_NAME)")
#: Scheme (without jdbc: before it), credentials, host and port, database; parameters and fragments are not kept.
_URL = re.compile(r"\s*(?:jdbc:)?(?:([A-Za-z][\w+.-]*)://)?(?:[^/?#]*@)?([^/?#\s]*)/*([^?#]*)")


@dataclass(frozen=True)
class Database:
    url: str
    username: str
    password: str
    description: str | None = None


def from_environment(env: Mapping[str, str]) -> dict[str, Database]:
    """Databases DB_1_*, DB_2_*, ... by tool name. The first missing URL ends the list; incomplete ones are skipped."""
    numbered: dict[int, dict[str, str]] = {}
    for name, value in env.items():
        if value and (setting := _SETTING.fullmatch(name)):
            numbered.setdefault(int(setting[1]), {})[setting[2]] = value
    listed = (numbered[k] for k in takewhile(lambda k: "URL" in numbered.get(k, {}), count(1)))
    return {d["TOOL_NAME"]: Database(d["URL"], d["USERNAME"], d["PASSWORD"], d.get("DESCRIPTION")) for d in listed if {"USERNAME", "PASSWORD", "TOOL_NAME"} <= d.keys()}


def jdbc_url(url: str | None, name: str = "") -> str:
    """jdbc:scheme://host:port/database without credentials and parameters; the scheme is postgresql if there is none."""
    scheme, host, database = _URL.match(url or "").groups()
    return f"jdbc:{(scheme or 'postgresql').lower()}://{host.lower()}/{database.strip() or name}"


def table(spark: SparkSession, database: Database, name_or_query: str, **split: str | int) -> DataFrame:
    """A table or query over JDBC. split: partitionColumn, lowerBound, upperBound, numPartitions for parallel reads.

    User and password are options, never part of the URL.
    """
    options = {"url": jdbc_url(database.url), "user": database.username, "password": database.password, "queryTimeout": str(TIMEOUT_S), "fetchsize": "10000"}
    source = {"query": name_or_query} if " " in name_or_query.strip() else {"dbtable": name_or_query}
    return spark.read.format("jdbc").options(**options, **source, **{k: str(v) for k, v in split.items()}).load()
