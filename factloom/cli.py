"""Command line: ``python -m factloom.cli build FOLDER --out DIR [options]`` and ``dump`` and ``stat`` over package facts.

Exit codes: 0, 1 for a failure, 2 for wrong usage, 3 if something was required at a boundary and nothing was found.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from .options import Options, UsageError, exit_code, version


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factloom")
    top.add_argument("--version", action="version", version=version())
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("folder")
    for f in fields(Options):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            build.add_argument(name, default=f.default, action=argparse.BooleanOptionalAction)
        else:
            build.add_argument(name, default=f.default, type=type(f.default))
    for name in ("dump", "sites", "contracts", "stat"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("--flow", default="")
    return top


def run(argv: list[str], spark=None) -> None:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    options = Options(**{f.name: args[f.name] for f in fields(Options)}) if command == "build" else None
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("factloom").getOrCreate()
    if command == "build":
        from .operators.routes import zero_boundary
        from .plans import extract

        if not options.out:
            raise UsageError("--out names the folder to write to")
        tables = extract.extract(spark, args["folder"], options)
        extract.write(tables, options.out)
        remote = tables["callsite"].where("kind = 'INVOKES_REMOTE'").count()
        found = {r["kind"].lower(): r["n"] for r in tables["contract"].groupBy("kind").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
        counts = {"remote_sites": remote, "grpc_methods": found.get("grpc", 0), "http_routes": found.get("http", 0), "http_calls": tables["http_call"].count()}
        if message := zero_boundary(counts, options.require_contracts):
            print(message, file=sys.stderr)
        print(f"functions={tables['function'].count()} sites={tables['callsite'].count()} remote={remote}")
        return
    from .sources import facts

    packages = facts.read_packages(spark, args["path"])
    if command == "stat":
        for table in facts.statistics(packages):
            for row in table.toLocalIterator():
                print("\t".join(f"{k}={v}" for k, v in row.asDict().items()))
        return
    lines = {"dump": lambda: facts.function_lines(packages, args["flow"]).orderBy("fqn", "id").select("line"), "sites": lambda: facts.site_lines(packages).orderBy("fqn", "id").select("line")}
    if command in lines:
        for row in lines[command]().toLocalIterator():
            print(row["line"])
    else:
        for row in facts.contract_lines(packages).orderBy("package_path", "kind", "name").toLocalIterator():
            print(row["kind"], row["name"], row["handler"], sep="\t")


def main() -> None:
    try:
        run(sys.argv[1:])
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        sys.exit(exit_code(e))


if __name__ == "__main__":
    main()
