"""Command line: python -m graphloom STORE COMMAND [ARGUMENTS]; answers are JSON lines."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .engine import CodeGraph


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *texts: str, **options):
        c = sub.add_parser(name)
        for t in texts:
            c.add_argument(t)
        for o, default in options.items():
            c.add_argument(f"--{o}", default=default, type=type(default))

    command("index", "root")
    command("reindex", "root")
    command("status")
    command("search", "query", top=10)
    command("trace", "symbol", direction="callees", depth=3, file="")
    command("trace-report", "symbol", direction="callees", depth=3, file="")
    command("who-calls", "symbol", depth=1)
    command("find-path", "start", "goal", hops=15)
    command("dependencies", "file", direction="imports", depth=2)
    command("dependencies-report", "file", direction="imports", depth=2)
    command("context", "what")
    command("list-symbols", "file")
    command("entry-points", kind="all")
    command("handlers")
    command("tree")
    command("cluster", "cluster_id")
    command("node-detail", "uid")
    command("web-graph")
    command("remove-file", "path")
    command("clear")
    command("evaluate", "truth", top=10)
    return p


def main(argv: list[str] | None = None) -> None:
    given = vars(_parser().parse_args(argv))
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    graph, command = CodeGraph(spark, given.pop("store")), given.pop("command").replace("-", "_")
    if command == "evaluate":
        given["truth"] = spark.read.option("multiLine", True).json(given["truth"])
    answer = getattr(graph, command)(**given)
    if not isinstance(answer, DataFrame):
        print(json.dumps(answer))
        return
    for row in answer.toJSON().toLocalIterator():
        print(row)


if __name__ == "__main__":
    main()
