"""Command line: python -m hornbeam COMMAND PROGRAM [options].

Prints one JSON object with a status (ok, rejected, parse_error, read_error, transform_error, eval_error); ``explain``
and ``emit`` print text. Exit code 0 if ok, 1 if not, 2 for a wrong call.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from hornbeam.language import ProgramError, parse, round_trips, show, tokens
from hornbeam.plans.checks import diagnose, graph
from hornbeam.plans.rewrite import MODES, explain, inspect, rewrite
from hornbeam.plans.sql import emit_sql

COMMANDS = ("lex", "parse", "roundtrip", "check", "explain", "inspect", "emit", "sql", "run", "run-naive", "compare")


def _session(master: str | None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("hornbeam").config("spark.ui.showConsoleProgress", "false")
    return (builder.master(master) if master else builder).getOrCreate()


def _run(text: str, a: argparse.Namespace) -> dict:
    from hornbeam.engine import Engine, compare

    spark = _session(a.master)
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "compare":
        return {"outputs": compare(spark, text, a.facts)}
    engine = Engine(spark, a.mode, "naive" if a.command == "run-naive" else "seminaive", a.max_rounds, a.deadline)
    done = engine.facts(a.facts).run(text)
    done.write(a.out, a.profile)
    return {"outputs": {n: df.count() for n, df in done.outputs().items()}, "tuples": done.counts() if a.profile else None}




def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="hornbeam", description=__doc__.splitlines()[0])
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("program")
    p.add_argument("--mode", choices=MODES, default="guarded-compact")
    p.add_argument("--facts", default=".", help="folder of the .facts files")
    p.add_argument("--out", default=".", help="folder for the .csv files")
    p.add_argument("--profile", action="store_true", help="also write profile.json")
    p.add_argument("--max-rounds", type=int)
    p.add_argument("--deadline", type=float, help="seconds")
    p.add_argument("--master")
    a = p.parse_args(argv)

    def end(status: str, **more) -> int:
        print(json.dumps({"status": status} | {k: v for k, v in more.items() if v is not None}, ensure_ascii=False))
        return int(status != "ok")

    try:
        with open(a.program, encoding="utf-8") as f:
            text = f.read()
    except (OSError, UnicodeDecodeError) as e:
        return end("read_error", message=str(e))
    if a.command == "lex":
        found = tokens(text)
        return end("parse_error" if any(t.kind == "error" for t in found) else "ok", tokens=[asdict(t) for t in found])
    try:
        program = parse(text)
    except ProgramError as e:
        return end("parse_error", diagnostics=[asdict(d) for d in e.diagnostics])
    if a.command == "parse":
        return end("ok", program=show(program))
    if a.command == "roundtrip":
        return end("ok" if round_trips(text) else "rejected")
    if found := diagnose(program):
        return end("rejected", diagnostics=[asdict(d) for d in found])
    try:
        if a.command == "check":
            g = graph(program)
            return end("ok", components=g.components, strata=g.strata)
        if a.command == "inspect":
            return end("ok", **inspect(text, a.mode))
        if a.command == "sql":
            return end("ok", sql=emit_sql(program))
        if a.command in ("explain", "emit"):
            print(explain(text, a.mode) if a.command == "explain" else show(rewrite(program, a.mode).program), end="")
            return 0
        if a.command != "compare":
            rewrite(program, a.mode)
    except (ProgramError, ValueError) as e:
        return end("transform_error", message=str(e))
    try:
        return end("ok", **_run(text, a))
    except Exception as e:  # whatever stops a run is told, not traced
        return end("eval_error", message=str(e)[:2000])


if __name__ == "__main__":
    sys.exit(main())
