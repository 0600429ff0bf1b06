"""Operations over newline-delimited JSON-RPC on two streams, and a command line for the same operations.

    python -m tracewell.plans.service FACTS_DIR [--serve | OPERATION [KEY=VALUE ...]]

FACTS_DIR holds Parquet tables named as in operations.Facts. Exit status: 0 it ran, 1 it could not, 2 a malformed request.
"""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from tracewell.plans.operations import OPERATIONS, Facts, RequestError, run


def answer(facts: Facts, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """The envelope of an operation as one JSON object, with all its rows and their key."""
    e = run(name, facts, **arguments)
    rows = [json.loads(r["json"]) for r in e.body().toLocalIterator()]
    return e.head() | {"result": rows, "determinism_key": e.key().first()["determinism_key"]}


def reply(facts: Facts, request: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {"jsonrpc": "2.0", "id": request.get("id")}
    try:
        method, params = request.get("method"), request.get("params") or {}
        if method == "initialize":
            return out | {"result": {"serverInfo": {"name": "tracewell"}, "capabilities": {"tools": {}}}}
        if method == "tools/list":
            return out | {"result": {"tools": [{"name": n, "description": (f.__doc__ or n).strip()} for n, f in OPERATIONS.items()]}}
        if method == "tools/call":
            return out | {"result": answer(facts, params.get("name", ""), params.get("arguments") or {})}
        return out | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}
    except RequestError as e:
        return out | {"error": {"code": -32602, "message": str(e)}}
    except Exception as e:  # a request that can't be answered doesn't end the service
        return out | {"error": {"code": -32000, "message": str(e).splitlines()[0]}}


def serve(facts: Facts, source: TextIO, sink: TextIO) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            said = reply(facts, request) if isinstance(request, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not an object"}}
        except ValueError as e:
            said = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        print(json.dumps(said), file=sink, flush=True)


class Folder(Facts):
    """Tables read from a folder when they are asked for."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path

    def get(self, name: str):
        if name not in self.tables:
            try:
                self.tables[name] = self.spark.read.parquet(f"{self.path}/{name}")
            except AnalysisException:
                return None
        return self.tables[name]

    def need(self, name: str):
        if self.get(name) is None:
            raise RequestError(f"the table {name} is needed")
        return self.tables[name]


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    facts = Folder(SparkSession.builder.appName("tracewell").getOrCreate(), args[0])
    if args[1:] == ["--serve"]:
        serve(facts, sys.stdin, sys.stdout)
        return 0
    try:
        given = dict(a.split("=", 1) for a in args[2:])
        print(run(args[1], facts, **{k: int(v) if v.lstrip("-").isdigit() else v for k, v in given.items()}).text(rows=None))
        return 0
    except (RequestError, ValueError, IndexError) as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
