import json
import threading
import time

import duckdb
import pytest

from hornbeam.engine import Engine
from hornbeam.language import parse
from hornbeam.operators.fixpoint import Cancelled, Diverging
from hornbeam.plans.rewrite import explain, inspect
from hornbeam.plans.sql import NoSQL, emit_sql
from hornbeam.sources.answers import differences
from hornbeam.sources.facts import FactsError

from .fixtures import blocked, closure, core_and_rest, family, graph

WAY = ".decl way(a:number, b:number) .input way .decl go(a:number, b:number) go(a,b) :- way(a,b). go(a,c) :- go(a,b), way(b,c). .decl to(b:number) .output to to(b) :- go(1,b). "
SHUT = ".decl shut(a:number) .input shut "
#: Over way, shut and (symbols) tag.
PROGRAMS = [
    WAY,
    WAY + SHUT + ".decl safe(a:number, b:number) .output safe safe(a,b) :- go(a,b), !shut(a), !go(b,a), a+1 < 40.",
    SHUT + ".decl sums(x:number, y:number, z:number) .output sums sums(x,y,z) :- shut(x), y = 100 / (x - 3), z = -x % 4, x != 7.",
    SHUT + ".decl on() on() :- shut(x), x > 2. .decl n(x:number) .output n n(x) :- shut(x), on(). n(99). n(98) :- !on().",
    SHUT + '.decl tag(a:number, t:symbol) .input tag .decl t(t:symbol, a:number) .output t t(s,b) :- tag(a,s), s < "it\'s", shut(a+1), b = a*2. t("none",0) :- !tag(1,"x").',
    WAY + ".decl twin(a:number) .output twin twin(a) :- way(a,a). .decl any(x:number) .output any any(x) :- way(x,_). any(x) :- way(_,x). .decl never(x:number) .output never",
]
TABLES = {"way": ("a long, b long", graph(30, 45, 3)), "shut": ("a long", blocked(30, 0.3, 4)), "tag": ("a long, t string", [(3, "it's"), (4, "a"), (5, "é"), (6, "")])}


@pytest.mark.parametrize("text", PROGRAMS)
def test_sql_gives_the_same(spark, text):
    engine, db = Engine(spark), duckdb.connect()
    for name, (columns, values) in TABLES.items():
        engine.bind(name, spark.createDataFrame(values, columns))
        db.execute(f"CREATE TABLE {name} ({columns.replace('long', 'BIGINT').replace('string', 'VARCHAR')})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(values[0]))})", values)
    done, said = engine.run(text).outputs(), emit_sql(parse(text))
    assert set(done) == set(said)
    for name, df in done.items():
        assert sorted(db.execute(said[name]).fetchall()) == sorted(tuple(r) for r in df.collect()), name


def test_recursions_without_sql():
    with pytest.raises(NoSQL):
        emit_sql(parse(WAY.replace("go(a,b), way(b,c)", "go(a,b), go(b,c)")))
    with pytest.raises(NoSQL):
        emit_sql(parse(".decl a(x:number) .decl b(x:number) .output b a(1). a(x) :- b(x). b(x+1) :- a(x), x < 5."))


def test_tuples_of_rewrites(spark):
    edges = core_and_rest(6, 20, 5)
    total = {}
    for mode in ("passthrough", "guarded", "guarded-compact"):
        done = Engine(spark, mode).bind("way", spark.createDataFrame(edges, "a long, b long")).run(WAY)
        assert {r[0] for r in done["to"].collect()} == set(range(1, 7))
        total[mode] = done.tuples(), done.tuples(checkpoints=False)
    assert total["passthrough"] == (len(closure(edges)) + 6,) * 2
    assert total["guarded-compact"][0] <= total["guarded"][0] < total["passthrough"][0] and total["guarded"][1] < total["guarded"][0]
    assert "Scan" in done.plan("to") or "Physical Plan" in done.plan("to")


def test_cousins_of_a_family(spark):
    tree = family(3, 3)
    text = ".decl kid(c:number,p:number) .input kid .decl level(a:number,b:number) level(a,b) :- kid(a,p), kid(b,p). level(a,b) :- kid(a,p), level(p,q), kid(b,q). .decl out(b:number) .output out out(b) :- level(40,b)."
    depth = {0: 0}
    for c, p in tree:
        depth[c] = depth[p] + 1
    last = max(depth)
    got = Engine(spark).bind("kid", spark.createDataFrame(tree, "c long, p long")).run(text.replace("40", str(last)))["out"]
    assert {r[0] for r in got.collect()} == {c for c, d in depth.items() if d == 3}


LOST = WAY + ".decl lost(a:number, b:number) lost(a,b) :- way(a,_), way(_,b), !go(a,b). .decl out(b:number) .output out out(b) :- lost(2,b). .decl other(a:number) .output other other(a) :- way(a,a)."


def test_decisions_by_relation():
    said = explain(LOST).splitlines()
    assert {"DECISION SPECIALISED", "DECISION go SPECIALISED", "DECISION lost SPECIALISED", "DECISION other ORIGINAL"} <= set(said)
    rules = inspect(LOST)["decision"]["rules"]
    assert rules["pops"] == len({(s["relation"], s["pattern"]) for s in rules["sips"]}) and {"magic", "view"} <= {r["role"] for r in rules["roles"]}
    json.dumps(rules)


def test_lines_of_bad_facts(spark, tmp_path):
    rows = [f"{k}\t{k + 1}" for k in range(5000)]
    rows[3210] = "3210"
    rows[4000] = "x\ty"
    (tmp_path / "way.facts").write_text("\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1g", "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            with pytest.raises(FactsError, match=r"way\.facts:3211: .*'3210'"):
                Engine(spark).facts(str(tmp_path)).run(WAY)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


SLOW = ".decl n(x:number) .input n .decl far(x:number) .output far far(x) :- n(x), n(y), x*y+x-y = -1. .decl more(x:number) .output more more(x) :- far(x). more(x+1) :- more(x), x < 5."


def test_a_job_is_ended(spark):
    many = spark.range(0, 400_000, 1, 4000).selectExpr("id as x")  # many small tasks: an ended job leaves its last ones running
    for ends, error in ((2, Diverging), (None, Cancelled)):
        engine = Engine(spark, deadline=ends).bind("n", many)
        if ends is None:
            timer = threading.Timer(2, engine.cancel)
            timer.start()
        begin = time.monotonic()
        with pytest.raises(error):
            engine.run(SLOW)
        assert time.monotonic() - begin < 30
    assert Engine(spark).bind("n", spark.createDataFrame([(1,)], "x long")).run(SLOW)["more"].count() == 0


def test_answers(tmp_path):
    for folder, files in (("a", {"x.csv": b"1\t2\n3\t4", "y.csv": b"", "z.csv": b"q\n"}), ("b", {"x.csv": b"3\t4\n1\t2\n", "y.csv": b"\n", "w.csv": b""})):
        (tmp_path / folder).mkdir()
        for name, data in files.items():
            (tmp_path / folder / name).write_bytes(data)
    assert differences(str(tmp_path / "a"), str(tmp_path / "b")) == ["z.csv: missing", "w.csv: not expected", "y.csv: 0 rows missing, 1 not expected"]
    assert differences(str(tmp_path / "a"), str(tmp_path / "a")) == []
