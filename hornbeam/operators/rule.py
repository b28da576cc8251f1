"""One rule as a DataFrame plan.

A frame holds a column for each variable that is still needed. Positive atoms join it on shared variables (and on
expressions, as equi-keys), or semi-join it if they bring nothing needed; negated atoms anti-join it. Constants and
repeated variables are filters on the relation, which reach its scan. A rule begins with the tuples that are new, goes on
with what is connected to them, and multiplies relations out only if nothing connects them. A relation has columns c0, c1, ...; one without
columns has one row or none of a hidden column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.functions.arithmetic import COMPARE, column, fallible
from hornbeam.language import Atom, Clause, Cmp, Not, Pos, Var, Wildcard, variables
from hornbeam.plans.body import binds, connected, order

HIDDEN = "_u"


def unit(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias(HIDDEN))


def columns(arity: int) -> list[str]:
    return [f"c{k}" for k in range(arity)] or [HIDDEN]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class RulePlan:
    """A rule with its literals in order; positions counts positive and negated atoms as they run."""

    def __init__(self, clause: Clause):
        self.clause = clause
        self.body = order(clause.body)
        self.atoms: list[tuple[str, bool]] = [(lit.atom.name, isinstance(lit, Pos)) for lit in self.body if isinstance(lit, Pos | Not)]

    def frame(self, spark: SparkSession, relation: Callable[[int, str], DataFrame], start: int | None = None) -> DataFrame:
        """Head tuples, with duplicates. relation: the frame for the atom at that place; start: the place to begin with."""
        places = [k for k, lit in enumerate(self.body) if isinstance(lit, Pos | Not)]
        run = connected(self.body, None if start is None else places[start])
        body = [self.body[k] for k in run]
        live = [set(variables(self.clause.head))]
        for lit in reversed(body):
            live.append(live[-1] | set(variables(lit)))
        live.reverse()
        df: DataFrame | None = None
        slot: dict[str, str] = {}
        for k, lit in enumerate(body):
            of = {v: F.col(c) for v, c in slot.items()}
            if isinstance(lit, Cmp):
                df = unit(spark) if df is None else df
                target = binds(lit, set(slot))
                if target is None:
                    df = df.filter(COMPARE[lit.op](column(lit.left, of), column(lit.right, of)))
                else:
                    value = lit.right if lit.left == Var(target) and target not in variables(lit.right) else lit.left
                    slot[target] = f"v{len(slot)}_{k}"
                    df = df.withColumn(slot[target], column(value, of))
                    if fallible(value):
                        df = df.filter(F.col(slot[target]).isNotNull())
                continue
            rel = relation(places.index(run[k]), lit.atom.name)
            if isinstance(lit, Not):
                df = self._without(unit(spark) if df is None else df, lit.atom, rel, of, k)
            else:
                df, slot = self._with(df, lit.atom, rel, slot, k, live[k + 1])
        head = self.clause.head
        of = {v: F.col(c) for v, c in slot.items()}
        df = unit(spark) if df is None else df
        if not head.terms:
            return df.select(F.lit(1).alias(HIDDEN))
        out = df.select(*(column(t, of).alias(f"c{k}") for k, t in enumerate(head.terms)))
        nullable = [F.col(f"c{k}").isNotNull() for k, t in enumerate(head.terms) if fallible(t)]
        return out.filter(_all(nullable)) if nullable else out

    @staticmethod
    def _with(df: DataFrame | None, atom: Atom, rel: DataFrame, slot: dict[str, str], k: int, needed: set[str]) -> tuple[DataFrame, dict[str, str]]:
        if not atom.terms:
            return (rel.select(F.col(HIDDEN).alias(f"u{k}")) if df is None else df.join(rel, F.lit(True), "left_semi")), slot
        name = [f"a{k}_{i}" for i in range(len(atom.terms))]
        used = [i for i, t in enumerate(atom.terms) if not isinstance(t, Wildcard)]
        own: dict[str, str] = {}
        for i, t in enumerate(atom.terms):
            if isinstance(t, Var):
                own.setdefault(t.name, name[i])
        # a relation is told from itself by its columns' new names
        rel = rel.select(*(F.col(f"c{i}").alias(name[i]) for i in used)) if used else rel.select(F.lit(1).alias(f"u{k}"))
        inside = {v: F.col(c) for v, c in own.items()}
        both = inside | {v: F.col(c) for v, c in slot.items()}
        filters, keys = [], []
        for i in used:
            t, col = atom.terms[i], F.col(name[i])
            if isinstance(t, Var):
                if own[t.name] != name[i]:
                    filters.append(col == inside[t.name])
                elif t.name in slot:
                    keys.append(col == F.col(slot[t.name]))
            elif set(variables(t)) <= set(own):
                filters.append(col == column(t, inside))
            else:
                keys.append(col == column(t, both))
        if filters:
            rel = rel.filter(_all(filters))
        fresh = {v: c for v, c in own.items() if v not in slot}
        if df is None:
            out = rel
        elif not set(fresh) & needed:
            out = df.join(rel, _all(keys) if keys else F.lit(True), "left_semi")
            fresh = {}
        else:
            out = df.join(rel, _all(keys)) if keys else df.crossJoin(rel)
        slot = {v: c for v, c in (slot | fresh).items() if v in needed}
        return out.select(*slot.values()) if slot else out.select(F.lit(1).alias(f"u{k}")), slot

    @staticmethod
    def _without(df: DataFrame, atom: Atom, rel: DataFrame, of: dict[str, Column], k: int) -> DataFrame:
        if not atom.terms:
            return df.join(rel, F.lit(True), "left_anti")
        keys = [column(t, of) for t in atom.terms]
        failing = [c.isNotNull() for c, t in zip(keys, atom.terms) if fallible(t)]
        if failing:  # an anti-join would keep them
            df = df.filter(_all(failing))
        rel = rel.select(*(F.col(f"c{i}").alias(f"a{k}_{i}") for i in range(len(keys))))
        return df.join(rel, _all([c == F.col(f"a{k}_{i}") for i, c in enumerate(keys)]), "left_anti")
