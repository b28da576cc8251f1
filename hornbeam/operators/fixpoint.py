"""Programs as DataFrames: components of relations in order, recursive ones by a fixpoint loop on the driver.

The loop is semi-naive. Each occurrence of a recursive relation in a rule has its own tuples to see; a relation is
evaluated as soon as one of its rules has any, with those at that occurrence and all tuples so far at the others, and
what is new goes to every occurrence. A chain of relations thus moves on within a round. New tuples are checkpointed
reliably, so plans stay short and lost executors cost a read, not the recursion.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.functions.arithmetic import wrapping
from hornbeam.language import Decl, Not, Pos, Program
from hornbeam.plans.checks import Graph, graph

from .rule import HIDDEN, RulePlan, columns
from .storage import Stop, settle

#: Frames that a relation's tuples are spread over before they are written as one.
PARTS = 12
#: Bytes of new tuples that are sent to the other side of their join at most; more are dealt by key.
SENT_BYTES = 8 << 20
#: Tuples of a part of a relation, about, when its parts are written as one.
PER_PARTITION = 100_000


class Diverging(RuntimeError):
    """A recursion over its limit of rounds, or a run over its limit of seconds."""


class Cancelled(RuntimeError):
    """A run that was ended from outside."""


@dataclass
class Evaluation:
    """relations: by name, columns c0, c1, ...; rounds: new tuples of each evaluation of a recursive relation."""

    relations: dict[str, DataFrame]
    loaded: dict[str, DataFrame]
    rounds: dict[str, list[int]] = field(default_factory=dict)


def empty(spark: SparkSession, decl: Decl) -> DataFrame:
    kinds = {"number": "long", "symbol": "string"}
    return spark.createDataFrame([], ", ".join(f"{c} {kinds[t]}" for c, (_, t) in zip(columns(len(decl.columns)), decl.columns)) or f"{HIDDEN} int")


def measured(df: DataFrame, decl: Decl) -> tuple[int, int]:
    """How many tuples, and how many bytes, a settled frame of the relation has."""
    symbols = [F.octet_length(c) + 8 for c, (_, t) in zip(columns(len(decl.columns)), decl.columns) if t == "symbol"]
    wide = reduce(lambda a, b: a + b, symbols, F.lit(8 * (1 + len(decl.columns) - len(symbols))))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(wide.cast("long")), F.lit(0))).first()
    return n, size


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Evaluator:
    def __init__(self, spark: SparkSession, program: Program, loaded: Mapping[str, DataFrame], strategy: str = "seminaive", max_rounds: int | None = None, deadline: float | None = None, everything: bool = False, stop: Stop | None = None):
        """loaded: frames of input relations; everything: also relations that no output needs; deadline: seconds,
        after which the running job is ended too; stop: what ends the run from outside."""
        self.spark, self.program, self.strategy = spark, program, strategy
        self.max_rounds, self.seconds, self.until = max_rounds, deadline, None
        self.stop = stop or Stop(spark, f"hornbeam-{uuid.uuid4().hex}")
        self.loaded = {n: loaded[n] if n in loaded else empty(spark, program.decl(n)) for n in program.inputs}
        self.rules: dict[str, list[RulePlan]] = {}
        for c in program.clauses:
            self.rules.setdefault(c.head.name, []).append(RulePlan(c))
        self.graph: Graph = graph(program)
        wanted = set(self.graph.nodes) if everything else self.graph.below(program.outputs)
        self.components = [c for c in self.graph.components if c[0] in wanted]
        self.out = Evaluation({}, self.loaded)
        self.uses = Counter(lit.atom.name for c in program.clauses if c.head.name in wanted for lit in c.body if isinstance(lit, Pos | Not))

    def relation(self, name: str) -> DataFrame:
        if name in self.out.relations:
            return self.out.relations[name]
        if name in self.loaded:
            return self.loaded[name]
        return empty(self.spark, self.program.decl(name))

    def run(self) -> Evaluation:
        self.until = time.monotonic() + self.seconds if self.seconds is not None else None
        try:
            with self.stop.watching(self.seconds):
                return self._run()
        except (Diverging, Cancelled):
            raise
        except Exception as e:
            if self.stop.ended.is_set():  # a job that was ended fails
                raise self._ended("the running job was ended") from e
            raise

    def _ended(self, where: str) -> Exception:
        late = self.until is not None and time.monotonic() >= self.until
        return Diverging(f"not done in time: {where}") if late else Cancelled(where)

    def _run(self) -> Evaluation:
        with wrapping(self.spark):
            for component in self.components:
                self._check(0, component)
                if not self.graph.recursive(component):
                    self._once(component[0])
                elif self.strategy == "naive":
                    self._naive(component)
                else:
                    self._loop(component)
            for name in self.program.outputs:
                if name not in self.out.relations:
                    self.out.relations[name] = self.relation(name).distinct()
        return self.out

    def _seed(self, name: str, component: set[str]) -> list[DataFrame]:
        """What the relation has without its component: loaded tuples and rules that don't read it."""
        first = [self.loaded[name]] if name in self.loaded else []
        return first + [r.frame(self.spark, lambda _, n: self.relation(n)) for r in self.rules[name] if not {a for a, _ in r.atoms} & component]

    def _once(self, name: str) -> None:
        df = _union(self._seed(name, set())).distinct()
        again = self.uses[name] > 1 or any(self.graph.recursive(c) and any(name in self.graph.edges[n] for n in c) for c in self.components)
        self.out.relations[name] = settle(df) if again else df

    def _check(self, rounds: int, names: list[str]) -> None:
        if self.max_rounds is not None and rounds > self.max_rounds:
            raise Diverging(f"{', '.join(names)}: not done after {self.max_rounds} rounds")
        if self.stop.ended.is_set() or self.until is not None and time.monotonic() >= self.until:
            raise self._ended(f"{', '.join(names)}, after {rounds} rounds")

    def _loop(self, component: list[str]) -> None:
        members = set(component)
        occurrences = {n: [(r, k) for r in self.rules[n] for k, (a, _) in enumerate(r.atoms) if a in members] for n in component}
        fixed = {a for n in component for r in self.rules[n] for a, _ in r.atoms} - members
        static = {n: settle(self.relation(n)) if n in self.loaded and n not in self.out.relations else self.relation(n) for n in fixed}
        parts: dict[str, list[DataFrame]] = {}
        sizes: dict[str, int] = dict.fromkeys(component, 0)
        unseen: dict[tuple[int, int], list[tuple[DataFrame, int]]] = {}

        def add(name: str, new: DataFrame) -> None:
            n, size = measured(new, self.program.decl(name))
            self.out.rounds.setdefault(name, []).append(n)
            if not n:
                return
            sizes[name] += n
            parts[name].append(new)
            if len(parts[name]) > PARTS:
                parts[name] = [settle(_union(parts[name]).coalesce(sizes[name] // PER_PARTITION + 1))]
            for of in occurrences.values():
                for r, k in of:
                    if r.atoms[k][0] == name:
                        unseen.setdefault((id(r), k), []).append((new, size))

        def full(name: str) -> DataFrame:
            return _union(parts[name]) if parts[name] else empty(self.spark, self.program.decl(name))

        for name in component:
            parts[name] = []
            seed = self._seed(name, members)
            if seed:
                add(name, settle(_union(seed).distinct()))
        rounds = 0
        while any(unseen.values()):
            rounds += 1
            self._check(rounds, component)
            for name in component:
                frames = []
                for r, at in occurrences[name]:
                    if news := unseen.pop((id(r), at), None):
                        delta = _union([df for df, _ in news])
                        if len(r.atoms) > 1 and sum(size for _, size in news) <= SENT_BYTES:
                            delta = F.broadcast(delta)
                        frames.append(r.frame(self.spark, lambda k, n, at=at, delta=delta: delta if k == at else full(n) if n in members else static[n], at))
                if frames:
                    found = _union(frames).distinct()
                    if parts[name]:
                        known = full(name)
                        found = found.join(known, [found[c] == known[c] for c in found.columns], "left_anti")
                    add(name, settle(found))
        for name in component:
            self.out.relations[name] = full(name)

    def _naive(self, component: list[str]) -> None:
        """All rules over all tuples until nothing is new; to hold the other strategy against."""
        members = set(component)
        now = {n: settle(_union(s).distinct()) if (s := self._seed(n, members)) else empty(self.spark, self.program.decl(n)) for n in component}
        sizes = {n: df.count() for n, df in now.items()}
        rounds = 0
        while True:
            rounds += 1
            self._check(rounds, component)
            new = {n: settle(_union([now[n], *(r.frame(self.spark, lambda _, m: now[m] if m in members else self.relation(m)) for r in self.rules[n])]).distinct()) for n in component}
            counts = {n: df.count() for n, df in new.items()}
            for n in component:
                self.out.rounds.setdefault(n, []).append(counts[n] - sizes[n])
            now, done, sizes = new, counts == sizes, counts
            if done:
                break
        self.out.relations |= now
