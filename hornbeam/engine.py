"""The way in: programs over bound frames or fact files, to frames."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hornbeam.language import Program, parse
from hornbeam.operators.fixpoint import Evaluation, Evaluator
from hornbeam.operators.rule import HIDDEN
from hornbeam.operators.storage import Stop
from hornbeam.plans.rewrite import Rewrite, rewrite
from hornbeam.sources import facts


@dataclass
class Result:
    program: Program
    rewritten: Rewrite
    evaluation: Evaluation

    def __getitem__(self, name: str) -> DataFrame:
        """A relation with its declared columns."""
        df = self.evaluation.relations[name]
        return df if df.columns == [HIDDEN] else df.toDF(*(c for c, _ in self.program.decl(name).columns))

    def outputs(self) -> dict[str, DataFrame]:
        return {n: self[n] for n in self.program.outputs}

    def counts(self) -> dict[str, int]:
        """Derived tuples of each relation that was computed; loaded ones don't count."""
        out = {}
        for name, df in self.evaluation.relations.items():
            if name in self.rewritten.program.derived():
                had = self.evaluation.loaded.get(name)
                out[name] = df.count() - (had.distinct().count() if had is not None else 0)
        return out

    def tuples(self, checkpoints: bool = True) -> int:
        """Derived tuples in all; without ``checkpoints``, those of the rewrite's checkpoint relations don't count."""
        role = self.rewritten.decision.final.role if self.rewritten.decision else {}
        return sum(n for name, n in self.counts().items() if checkpoints or role.get(name) != "checkpoint")

    def plan(self, name: str) -> str:
        """Spark's formatted plan of an output; what is behind checkpoints is done and no part of it."""
        df = self[name]
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def profile(self) -> dict:
        relations = {n: {"num-tuples": k, "iteration": {str(i): {"num-tuples": c} for i, c in enumerate(self.evaluation.rounds.get(n, []))}} for n, k in self.counts().items()}
        return {"root": {"program": {"relation": relations}}}

    def write(self, folder: str, profile: bool = False) -> None:
        for name in self.program.outputs:
            facts.write(self.evaluation.relations[name], folder, name)
        if profile:
            with open(os.path.join(folder, "profile.json"), "w") as f:
                json.dump(self.profile(), f, indent=1)


class Engine:
    """Runs rule programs. mode: the rewrite; strategy: seminaive or naive; max_rounds and deadline (seconds) stop
    recursions that don't end, the deadline within a round too; everything: compute relations that no output needs, too."""

    def __init__(self, spark: SparkSession, mode: str = "guarded-compact", strategy: str = "seminaive", max_rounds: int | None = None, deadline: float | None = None, everything: bool = False):
        self.spark, self.mode, self.strategy = spark, mode, strategy
        self.limits = {"max_rounds": max_rounds, "deadline": deadline, "everything": everything}
        self.frames: dict[str, DataFrame] = {}
        self.folder: str | None = None
        self.stop: Stop | None = None

    def cancel(self) -> None:
        """Ends the run that another thread is in; ``run`` raises ``Cancelled`` there."""
        if self.stop:
            self.stop.now()

    def bind(self, name: str, df: DataFrame) -> Engine:
        self.frames[name] = df
        return self

    def facts(self, folder: str) -> Engine:
        self.folder = folder
        return self

    def run(self, text: str | Program) -> Result:
        self.stop = Stop(self.spark, f"hornbeam-{uuid.uuid4().hex}")
        program = parse(text) if isinstance(text, str) else text
        done = rewrite(program, self.mode)
        loaded = {}
        for name in program.inputs:
            decl = program.decl(name)
            if name in self.frames:
                loaded[name] = facts.bind(self.frames[name], decl)
            elif self.folder is not None:
                loaded[name] = facts.load(self.spark, self.folder, decl)
        return Result(program, done, Evaluator(self.spark, done.program, loaded, self.strategy, stop=self.stop, **self.limits).run())


def compare(spark: SparkSession, text: str, folder: str | None = None, frames: dict[str, DataFrame] | None = None) -> dict[str, bool]:
    """Whether each output has the same tuples by either strategy, with and without the rewrite."""
    got: dict[str, list[set]] = {}
    for mode in ("passthrough", "guarded-compact"):
        for strategy in ("seminaive", "naive"):
            engine = Engine(spark, mode, strategy)
            engine.folder, engine.frames = folder, dict(frames or {})
            for name, df in engine.run(text).outputs().items():
                got.setdefault(name, []).append({tuple(r) for r in df.collect()})
    return {name: all(s == sets[0] for s in sets) for name, sets in got.items()}
