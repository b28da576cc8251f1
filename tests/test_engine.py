import random

import duckdb
import pytest

from hornbeam.engine import Engine, compare
from hornbeam.operators.fixpoint import Diverging
from hornbeam.plans.rewrite import MODES
from hornbeam.sources.facts import FactsError

EDGE = ".decl edge(a:number, b:number) .input edge .decl reach(a:number, b:number) .decl out(b:number) .output out "
RIGHT = "reach(x,y) :- edge(x,y). reach(x,y) :- edge(x,z), reach(z,y). "


def rows(df):
    return {tuple(r) for r in df.collect()}


def run(spark, text, mode="guarded-compact", folder=None, **frames):
    engine = Engine(spark, mode)
    for name, values in frames.items():
        width = len(values[0]) if values else 2
        engine.bind(name, spark.createDataFrame(values, ", ".join(f"x{k} long" for k in range(width))))
    if folder:
        engine.facts(str(folder))
    return {n: rows(df) for n, df in engine.run(text).outputs().items()}


ROADS = [(4, 6), (6, 9), (9, 4), (9, 11), (2, 2)]
_ROAD = ".decl road(a:number, b:number) .input road .decl trip(a:number, b:number) trip(a,b) :- road(a,b). trip(a,c) :- trip(a,b), road(b,c). "
#: Programs over ROADS with their outputs.
PROGRAMS = {
    "one start, and all trips too": (_ROAD + ".output trip .decl to(b:number) .output to to(b) :- trip(6,b).", {"to": {(4,), (6,), (9,), (11,)}, "trip": {(a, b) for a in (4, 6, 9) for b in (4, 6, 9, 11)} | {(2, 2)}}),
    "two starts": (_ROAD + ".decl a(b:number) .output a .decl z(b:number) .output z a(b) :- trip(2,b). z(b) :- trip(11,b).", {"a": {(2,)}, "z": set()}),
    "who can't return, beside a question": (_ROAD + ".decl lost(a:number,b:number) .output lost lost(a,b) :- trip(a,b), !trip(b,a). .decl to(b:number) .output to to(b) :- trip(2,b).", {"lost": {(4, 11), (6, 11), (9, 11)}, "to": {(2,)}}),
    "a question about a computed column": (_ROAD + ".decl far(d:number,b:number) .decl to(b:number) .output to far(b-a,b) :- road(a,b). to(b) :- far(2,b).", {"to": {(6,), (11,)}}),
    "halving": (".decl half(n:number) half(100). half(n/2) :- half(n), n > 3. .decl small(n:number) .output small small(n) :- half(n), n < 20.", {"small": {(12,), (6,), (3,)}}),
    "places on a way": (_ROAD + ".decl mid(a:number) .output mid mid(b) :- road(_,b), road(b,_), !road(b,b).", {"mid": {(6,), (9,), (4,)}}),
}


@pytest.mark.parametrize("name", PROGRAMS)
def test_every_rewrite_gives_the_same(spark, name):
    text, expected = PROGRAMS[name]
    for mode in ("passthrough", "guarded-compact") if name != "two starts" else MODES:
        assert run(spark, text, mode, **({"road": ROADS} if "road" in text else {})) == expected, mode


def test_loaded_tuples_of_a_derived_relation(spark):
    text = _ROAD.replace("trip(a,b) :- road(a,b).", ".input trip") + ".decl to(b:number) .output to to(b) :- trip(1,b)."
    for mode in MODES:
        assert run(spark, text, mode, road=ROADS, trip=[(1, 6), (8, 2)]) == {"to": {(4,), (6,), (9,), (11,)}}


def wrapped(n):
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def test_wrapping_and_failing_arithmetic(spark):
    values = [0, 1, -1, 10, -10, (1 << 62) + 1, (1 << 63) - 1, -(1 << 63)]
    facts = " ".join(f"n({v})." for v in values)
    text = f""".decl n(x:number) {facts} .decl sums(a:number,b:number,c:number,d:number) .output sums .decl parts(a:number,q:number,m:number) .output parts .decl none(a:number) .output none
    sums(x, x+x, x*3, -x) :- n(x). parts(x, q, m) :- n(x), n(y), y != 0, q = x / y, m = x % y. none(x) :- n(x), !n(x % (x - x))."""
    got = run(spark, text)
    assert got["sums"] == {(v, wrapped(2 * v), wrapped(3 * v), wrapped(-v)) for v in values}
    cut = lambda a, b: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    assert got["parts"] == {(a, wrapped(cut(a, b)), a - b * cut(a, b)) for a in values for b in values if b}
    assert got["none"] == set() and spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_symbols_are_ordered_by_bytes_and_names_by_case(spark):
    text = '.decl S(a:symbol) .decl s(a:symbol) S("B"). S("a"). s("é"). s("z"). .decl out(a:symbol,b:symbol) .output out out(X,x) :- S(X), S(x), X < x. out(X,x) :- s(X), s(x), X > x.'
    assert run(spark, text) == {"out": {("B", "a"), ("é", "z")}}


def test_zero_arity(spark):
    text = ".decl f() .decl g() .output g f(). g() :- f(), !h(). .decl h() h() :- f(), 1 > 2."
    assert len(run(spark, text)["g"]) == 1


def closure(edges):
    out = set(edges)
    while new := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= new
    return out


def test_random_graphs_against_a_closure(spark):
    text = EDGE + ".decl node(a:number) .input node .decl un(a:number,b:number) reach(x,y) :- edge(x,y). reach(x,y) :- reach(x,z), reach(z,y). un(x,y) :- node(x), node(y), !reach(x,y). out(y) :- un(1,y)."
    for seed in range(2):
        r = random.Random(seed)
        edges = [(a, b) for a in range(1, 10) for b in range(1, 10) if r.random() < 0.12] or [(1, 1)]
        expected = {(n,) for n in range(1, 10) if (1, n) not in closure(edges)}
        assert run(spark, text, edge=edges, node=[(n,) for n in range(1, 10)]) == {"out": expected}


def test_strategies_agree(spark):
    frames = {"edge": spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")}
    assert compare(spark, EDGE + RIGHT + "out(y) :- reach(2,y).", frames=frames) == {"out": True}


def test_counts_leave_loaded_tuples_out(spark):
    engine = Engine(spark, "passthrough").bind("edge", spark.createDataFrame([(1, 2), (2, 3), (1, 2)], "a long, b long"))
    done = engine.run(EDGE + RIGHT + "out(y) :- reach(1,y).")
    assert done.counts() == {"reach": 3, "out": 2}
    assert done.profile()["root"]["program"]["relation"]["reach"]["num-tuples"] == 3


def test_limits(spark):
    with pytest.raises(Diverging):
        Engine(spark, max_rounds=3).run(".decl n(x:number) .output n n(0). n(x+1) :- n(x).")


def test_facts_and_answers(spark, tmp_path):
    (tmp_path / "r.facts").write_bytes("1\ta b\r\n-2\té \n+3\t".encode())
    (tmp_path / "t.facts").write_text("\n")
    text = ".decl r(a:number,b:symbol) .input r .decl t() .input t .decl none(a:number) .input none .decl out(a:number,b:symbol) .output out out(x,y) :- r(x,y), t(), !none(x)."
    done = Engine(spark).facts(str(tmp_path)).run(text)
    done.write(str(tmp_path / "answers"), profile=True)
    assert set((tmp_path / "answers/out.csv").read_bytes().decode().split("\n")) == {"1\ta b", "-2\té ", "3\t", ""}
    assert (tmp_path / "answers/profile.json").exists()


@pytest.mark.parametrize("bad", ["", "7", "7\t8\t", "\t8", "7\t0x8", "7\t8.0", "7\t 8", "-9223372036854775809\t8", "--7\t8"])
def test_bad_facts(spark, tmp_path, bad):
    (tmp_path / "p.facts").write_text(f"-3\t+4\n{bad}\n5\t6\n")
    with pytest.raises(FactsError):
        Engine(spark).facts(str(tmp_path)).run(".decl p(a:number,b:number) .input p .output p")


def test_symbol_facts_take_any_text_but_nul(spark, tmp_path):
    (tmp_path / "p.facts").write_bytes("a\u2028b\t\n".encode())
    text = ".decl p(a:symbol,b:symbol) .input p .output p"
    assert rows(Engine(spark).facts(str(tmp_path)).run(text)["p"]) == {("a\u2028b", "")}
    (tmp_path / "p.facts").write_bytes(b"a\x00b\tc\n")
    with pytest.raises(FactsError):
        Engine(spark).facts(str(tmp_path)).run(text)


def test_recursion_joins_without_a_cartesian_product(spark):
    from hornbeam import catalogue
    from hornbeam.language import parse as read
    from hornbeam.operators.rule import RulePlan

    rule = next(c for c in read(catalogue.QUERIES["same_generation"][1]).clauses if len(c.body) == 4)
    plan = RulePlan(rule)
    frame = spark.range(5).selectExpr("id as c0", "id as c1")
    at = [n for n, _ in plan.atoms].index("sg")
    text = plan.frame(spark, lambda k, n: frame, at)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_entry(spark):
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    edges = duckdb.sql("SELECT DISTINCT o_custkey, o_custkey // 3 + o_orderkey % 5 FROM '/root/testdata/sf0.001/orders.parquet'").fetchall()
    assert rows(__spark_entry__.entry(spark)) == {(b,) for a, b in closure(edges) if a == 22}
