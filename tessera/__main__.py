"""Command line: mask a tree, build the index, search it, query tables.

python -m tessera mask SOURCE TARGET [--ignore FILE] [--mode strict|compat]
python -m tessera build SOURCE STORE [--ignore FILE]
python -m tessera search STORE QUESTION [--prefix P] [--top N] [--symbols A,B] [--no-rerank]
python -m tessera sql FOLDER QUERY        (every FOLDER/*.parquet is a table)
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from tessera.logs import logger
from tessera.plans import index, search, sqltool
from tessera.session import session
from tessera.sources import files
from tessera.sources.store import Store


def _text(path: str | None) -> str:
    return Path(path).read_text(encoding="utf-8") if path else ""


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, *positional in (("mask", "source", "target"), ("build", "source", "store"), ("search", "store", "question"), ("sql", "folder", "query")):
        command = commands.add_parser(name)
        for p in positional:
            command.add_argument(p)
        if name in ("mask", "build"):
            command.add_argument("--ignore")
        if name == "mask":
            command.add_argument("--mode", default="strict", choices=("strict", "compat"))
        if name == "search":
            command.add_argument("--prefix", default="")
            command.add_argument("--top", type=int, default=10)
            command.add_argument("--symbols", default="")
            command.add_argument("--no-rerank", action="store_true")
    given = parser.parse_args(arguments)
    spark, log = session(), logger(given.command)
    if given.command == "mask":
        errors = index.mask_tree(spark, given.source, given.target, _text(given.ignore), given.mode).collect()
        for row in errors:
            log.error("%s: %s", row["path"], row["error"])
        return 0
    if given.command == "build":
        store = Store(spark, given.store)
        counts = index.build(spark, files.scan(spark, given.source), store, _text(given.ignore))
        for row in store.report().where("error is not null").toLocalIterator():
            log.error("%s: %s", row["path"], row["error"])
        log.info("%s", ", ".join(f"{k} {v}" for k, v in sorted(counts.items())) or "nothing")
        return 0
    if given.command == "search":
        symbols = [s for s in given.symbols.split(",") if s]
        found = search.search(Store(spark, given.store).chunks(), given.question, given.prefix, given.top, symbols, not given.no_rerank)
        for row in found.orderBy("rank").toJSON().collect():
            print(row)
        return 0
    for path in sorted(Path(given.folder).glob("*.parquet")):
        spark.read.parquet(str(path)).createOrReplaceTempView(path.stem)
    result = sqltool.payload(spark, given.query)
    print(json.dumps(result, default=str, ensure_ascii=False))
    return int("error" in result)


if __name__ == "__main__":
    raise SystemExit(main())
