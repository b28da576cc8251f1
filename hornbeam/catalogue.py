"""Registered rule queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hornbeam.engine import Engine
from hornbeam.language import parse

#: Relations: columns, then the table and its columns for Spark and for DuckDB.
RELATIONS = {
    "cust": ("k:number, nation:number, seg:symbol", "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS seg FROM customer"),
    "nation": ("k:number, name:symbol, r:number", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation"),
    "region": ("k:number, name:symbol", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region"),
    "ord": ("o:number, c:number, status:symbol, prio:symbol", "SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS status, o_orderpriority AS prio FROM orders"),
    "item": ("o:number, p:number, s:number, ln:number", "SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem"),
    "part": ("k:number, brand:symbol, size:number", "SELECT p_partkey AS k, p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part"),
    "event": ("id:number, user:number, type:symbol", "SELECT event_id AS id, user_id AS user, event_type AS type FROM events"),
    "doc": ("id:number, lang:symbol, source:symbol, chars:number", "SELECT doc_id AS id, lang, source, n_chars AS chars FROM documents"),
    "label": ("id:number, quality:number, toxic:number", "SELECT doc_id AS id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels"),
    "turn": ("conv:number, t:number, role:symbol", "SELECT conv_id AS conv, turn AS t, role FROM conversations"),
    "edge": ("a:number, b:number", "SELECT o_custkey AS a, CAST(floor(o_custkey / 3) AS BIGINT) + o_orderkey % 5 AS b FROM orders"),
    "parent": ("c:number, p:number", "SELECT c_custkey AS c, CAST(floor(c_custkey / 4) AS BIGINT) - 1 AS p FROM customer"),
    "low": ("k:number", "SELECT s_suppkey AS k FROM supplier"),
    "boss": ("c:number, p:number", "SELECT s_suppkey AS c, CAST(floor(s_suppkey / 4) AS BIGINT) - 1 AS p FROM supplier"),
    "seed": ("a:number, b:number", "SELECT 8000000 + s_suppkey AS a, s_suppkey AS b FROM supplier"),
}
_TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()
START = 1096


def program(outputs: str, rules: str, decls: str = "") -> str:
    """A program around the rules: declares the relations above that it reads, and its outputs ("name(column:type, ...)")."""
    used = [n for n in RELATIONS if re.search(rf"\b{n}\(", rules) and not re.search(rf"\.decl {n}\(", decls)]
    names = re.findall(r"(\w+)\(", outputs)
    lines = [f".decl {n}({RELATIONS[n][0]})\n.input {n}" for n in used] + [f".decl {o}" for o in re.findall(r"\w+\([^)]*\)", outputs)] + [f".output {n}" for n in names]
    return "\n".join([*lines, decls, rules]) + "\n"


_REACH = ".decl reach(a:number, b:number)"
_LEFT = "reach(x,y) :- edge(x,y). reach(x,y) :- reach(x,z), edge(z,y). "
_RIGHT = "reach(x,y) :- edge(x,y). reach(x,y) :- edge(x,z), reach(z,y). "
_SQL_REACH = "reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)"
_UNREACH = _LEFT + f"node(x) :- edge(x,_). node(y) :- edge(_,y). un(x,y) :- node(x), node(y), !reach(x,y). out(y) :- un({START},y)."
_SG = "sg(x,x) :- low(x). sg(x,y) :- boss(x,xp), boss(y,yp), sg(xp,yp), x != y. "
_SQL_SG = "sg(a, b) AS (SELECT k, k FROM low UNION SELECT x.c, y.c FROM sg JOIN boss x ON x.p = sg.a JOIN boss y ON y.p = sg.b WHERE x.c <> y.c)"
_WRAP = "CAST((({0} + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808 AS BIGINT)"


def _wrap(x: str) -> str:
    return _WRAP.format(x)


#: name: (mode, program, SQL over the relations above, output)
QUERIES: dict[str, tuple[str, str, str, str]] = {}


def _add(name: str, outputs: str, rules: str, sql: str, decls: str = "", mode: str = "passthrough", output: str = "out") -> None:
    QUERIES[name] = (mode, program(outputs, rules, decls), sql, output)


_add("scan_project", "out(k:number, n:number)", "out(k,n) :- cust(k,n,_).", "SELECT DISTINCT k, nation AS n FROM cust")
_add("const_select", "out(k:number)", 'out(k) :- cust(k,_,"BUILDING").', "SELECT DISTINCT k FROM cust WHERE seg = 'BUILDING'")
_add("repeated_var", "out(o:number, x:number)", "out(o,x) :- item(o,x,x,_). out(x,x) :- edge(x,x).", "SELECT o, p AS x FROM item WHERE p = s UNION SELECT a, a FROM edge WHERE a = b")
_add("wildcard_exist", "out(c:number)", "out(c) :- ord(_,c,_,_).", "SELECT DISTINCT c FROM ord")
_add("arith_column_test", "out(o:number)", "out(o) :- item(o,_,_,ln), item(o,_,_,ln+1).", "SELECT DISTINCT x.o FROM item x JOIN item y ON x.o = y.o AND y.ln = x.ln + 1")
_add("arith_head", "out(a:number, b:number)", "out(k+1, k*2-3) :- part(k,_,_).", "SELECT DISTINCT k + 1 AS a, k * 2 - 3 AS b FROM part")
_add("div_mod", "out(k:number, q:number, m:number)", "out(k,q,m) :- part(k,_,s), q=(k-100)/(s-10), m=(k-100)%(s-10).", "SELECT DISTINCT k, (k - 100) // (size - 10) AS q, (k - 100) % (size - 10) AS m FROM part WHERE size <> 10")
_add("unary_minus", "out(k:number)", "out(-k) :- part(k,_,_).", "SELECT DISTINCT -k AS k FROM part")
_add("int64_wrap", "out(k:number, v:number)", "out(k, k*9223372036854775807+5) :- part(k,_,_).", f"SELECT DISTINCT k, {_wrap('(CAST(k AS HUGEINT) * 9223372036854775807 + 5)')} AS v FROM part")
for _n, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "!=")):
    _add(f"compare_{_n}", "out(k:number)", f"out(k) :- part(k,_,s), s {_op} 10.", f"SELECT DISTINCT k FROM part WHERE size {_op} 10")
_add("symbol_order", "out(a:symbol, b:symbol)", "out(a,b) :- nation(_,a,_), nation(_,b,_), a < b.", "SELECT DISTINCT x.name AS a, y.name AS b FROM nation x JOIN nation y ON x.name < y.name")
_add("assign_chain", "out(k:number, y:number)", "out(k,y) :- y = z*2, part(k,_,_), z = k+1.", "SELECT DISTINCT k, (k + 1) * 2 AS y FROM part")
_add("constraint_only", "out(x:number)", "out(x) :- y = 40 - 7 * 5 + 12 / 5, x = y - 3.", "SELECT CAST(4 AS BIGINT) AS x")
_add("facts_values", "out(a:number, b:symbol)", 'out(1,"a"). out(1+2,"b"). out(-3,"c\\"d").', """SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'a'), (3, 'b'), (-3, 'c"d')) t(a, b)""")
_add("zero_arity_gate", "out(k:number)", "has() :- part(_,_,50). out(k) :- region(k,_), has().", "SELECT k FROM region WHERE EXISTS (SELECT 1 FROM part WHERE size = 50)", ".decl has()")
_add("zero_arity_negated", "out(k:number)", "has() :- part(_,_,51). out(k) :- region(k,_), !has().", "SELECT k FROM region WHERE NOT EXISTS (SELECT 1 FROM part WHERE size = 51)", ".decl has()")
_add("join_two", "out(n:number, o:number)", 'out(n,o) :- cust(c,n,_), ord(o,c,"F",_).', "SELECT DISTINCT nation AS n, o FROM cust JOIN ord ON ord.c = cust.k WHERE status = 'F'")
_add("join_three", "out(seg:symbol, p:number)", "out(g,p) :- cust(c,7,g), ord(o,c,_,_), item(o,p,_,_).", "SELECT DISTINCT seg, p FROM cust JOIN ord ON ord.c = cust.k JOIN item ON item.o = ord.o WHERE nation = 7")
_add("join_star", "out(r:symbol, n:symbol, k:number)", "out(r,n,k) :- region(i,r), nation(j,n,i), cust(k,j,_).", "SELECT DISTINCT region.name AS r, nation.name AS n, cust.k AS k FROM region JOIN nation ON nation.r = region.k JOIN cust ON cust.nation = nation.k")
_add("cross_product", "out(a:symbol, b:symbol)", "out(a,b) :- region(_,a), region(_,b).", "SELECT DISTINCT x.name AS a, y.name AS b FROM region x, region y")
_add("theta_join", "out(o:number, a:number, b:number)", "out(o,a,b) :- item(o,p,_,a), item(o,q,_,b), a < b, p > q.", "SELECT DISTINCT x.o, x.ln AS a, y.ln AS b FROM item x JOIN item y ON x.o = y.o AND x.ln < y.ln AND x.p > y.p")
_add("expr_equijoin", "out(s:number, n:number)", "home(r,n) :- nation(n,_,r). tens(s/10,s) :- part(_,_,s). out(s,n) :- home(s%5,n), tens(n/5,s).", "SELECT DISTINCT size AS s, nation.k AS n FROM nation JOIN part ON nation.r = size % 5 AND size // 10 = nation.k // 5", ".decl home(r:number, n:number) .decl tens(t:number, s:number)")
_add("semi_join", "out(k:number)", "out(k) :- cust(k,_,_), ord(_,k,\"P\",_).", "SELECT DISTINCT k FROM cust WHERE EXISTS (SELECT 1 FROM ord WHERE ord.c = cust.k AND status = 'P')")
_add("anti_join", "out(k:number)", 'urgent(c) :- ord(_,c,_,"1-URGENT"). out(k) :- cust(k,_,_), !urgent(k).', "SELECT DISTINCT k FROM cust WHERE NOT EXISTS (SELECT 1 FROM ord WHERE ord.c = cust.k AND prio = '1-URGENT')", ".decl urgent(c:number)")
_add("anti_join_derived", "out(d:number)", "labelled(d) :- label(d,_,_). out(d) :- doc(d,_,_,_), !labelled(d).", "SELECT DISTINCT id AS d FROM doc WHERE NOT EXISTS (SELECT 1 FROM label WHERE label.id = doc.id)", ".decl labelled(d:number)")
_add("anti_join_input", "out(a:number, b:number)", "out(b,a) :- edge(a,b), !edge(b,a).", "SELECT DISTINCT b AS a, a AS b FROM edge x WHERE NOT EXISTS (SELECT 1 FROM edge y WHERE y.a = x.b AND y.b = x.a)")
_add("anti_join_arith", "out(k:number)", "out(k) :- part(k,_,s), !edge(k, 100/(s-10)).", "SELECT DISTINCT k FROM part WHERE size <> 10 AND NOT EXISTS (SELECT 1 FROM edge WHERE a = k AND b = 100 // nullif(size - 10, 0))")
_add("union_rules", "out(k:number)", "out(k) :- cust(k,3,_). out(k) :- part(k,_,7).", "SELECT k FROM cust WHERE nation = 3 UNION SELECT k FROM part WHERE size = 7")
_add("intersect", "out(k:number)", "out(k) :- edge(k,_), edge(_,k).", "SELECT a AS k FROM edge INTERSECT SELECT b FROM edge")
_add("difference", "out(k:number)", "b(y) :- edge(_,y). out(k) :- edge(k,_), !b(k).", "SELECT a AS k FROM edge EXCEPT SELECT b FROM edge", ".decl b(k:number)")
_add("events_sessions", "out(u:number, t:symbol)", 'out(u,t) :- event(i,u,t), event(i+1,u,_), t != "view".', "SELECT DISTINCT x.user AS u, x.type AS t FROM event x JOIN event y ON y.id = x.id + 1 AND y.user = x.user WHERE x.type <> 'view'")
_add("turn_pairs", "out(c:number, t:number)", "out(c,t) :- turn(c,t,r), turn(c,t+2,r).", "SELECT DISTINCT x.conv AS c, x.t FROM turn x JOIN turn y ON y.conv = x.conv AND y.t = x.t + 2 AND y.role = x.role")
_add("tc_linear_left", "out(a:number, b:number)", _LEFT + "out(x,y) :- reach(x,y).", f"WITH RECURSIVE {_SQL_REACH} SELECT a, b FROM reach", _REACH)
_add("tc_linear_right", "out(a:number, b:number)", _RIGHT + "out(x,y) :- reach(x,y).", f"WITH RECURSIVE {_SQL_REACH} SELECT a, b FROM reach", _REACH)
_add("tc_nonlinear", "out(a:number, b:number)", "reach(x,y) :- edge(x,y). reach(x,y) :- reach(x,z), reach(z,y). out(x,y) :- reach(x,y).", f"WITH RECURSIVE {_SQL_REACH} SELECT a, b FROM reach", _REACH)
_MODES = ("passthrough", "magicset", "guarded", "guarded-compact")
for _mode in _MODES[1:]:
    _add(f"tc_bound_{_mode.replace('-', '_')}", "out(b:number)", _LEFT + f"out(y) :- reach({START},y).", f"WITH RECURSIVE {_SQL_REACH} SELECT b FROM reach WHERE a = {START}", _REACH, _mode)
_add("tc_bound_right", "out(b:number)", _RIGHT + f"out(y) :- reach({START},y).", f"WITH RECURSIVE {_SQL_REACH} SELECT b FROM reach WHERE a = {START}", _REACH, "guarded-compact")


def _add_modes(name: str, modes: tuple[str, ...], *rest: str) -> None:
    """The last mode under the name itself, the others with theirs."""
    for mode in modes:
        _add(name if mode == modes[-1] else f"{name}_{mode.replace('-', '_')}", *rest, mode)


_add_modes(
    "reach_complement_bound", _MODES[1:], "out(b:number)", _UNREACH,
    f"WITH RECURSIVE {_SQL_REACH}, node AS (SELECT a FROM edge UNION SELECT b FROM edge) SELECT n.a AS b FROM node n WHERE EXISTS (SELECT 1 FROM node WHERE a = {START}) AND NOT EXISTS (SELECT 1 FROM reach WHERE reach.a = {START} AND reach.b = n.a)",
    _REACH + " .decl node(x:number) .decl un(a:number, b:number)",
)
_ANC = "anc(x,y) :- parent(x,y). anc(x,y) :- parent(x,z), anc(z,y). "
_add("ancestors", "out(a:number, b:number)", _ANC + "out(x,y) :- anc(x,y).", "WITH RECURSIVE anc(a, b) AS (SELECT c, p FROM parent UNION SELECT a, p FROM anc JOIN parent ON parent.c = anc.b) SELECT a, b FROM anc", ".decl anc(a:number, b:number)")
_add(
    "ancestor_nonancestor_bound", "out(y:number)", _ANC + f"non(x,y) :- cust(x,_,_), cust(y,_,_), !anc(x,y). out(y) :- non({START},y).",
    f"WITH RECURSIVE anc(a, b) AS (SELECT c, p FROM parent UNION SELECT a, p FROM anc JOIN parent ON parent.c = anc.b) SELECT DISTINCT k AS y FROM cust WHERE EXISTS (SELECT 1 FROM cust WHERE k = {START}) AND NOT EXISTS (SELECT 1 FROM anc WHERE a = {START} AND b = k)",
    ".decl anc(a:number, b:number) .decl non(a:number, b:number)", "guarded-compact",
)
_add("same_generation", "out(a:number, b:number)", _SG + "out(x,y) :- sg(x,y).", f"WITH RECURSIVE {_SQL_SG} SELECT a, b FROM sg", ".decl sg(a:number, b:number)")
_add_modes(
    "same_generation_negation_bound", _MODES, "out(y:number)", _SG + "non(x,y) :- low(x), low(y), !sg(x,y). out(y) :- non(7,y).",
    f"WITH RECURSIVE {_SQL_SG} SELECT k AS y FROM low WHERE EXISTS (SELECT 1 FROM low WHERE k = 7) AND NOT EXISTS (SELECT 1 FROM sg WHERE a = 7 AND b = k)", ".decl sg(a:number, b:number) .decl non(a:number, b:number)",
)
_add(
    "mutual_recursion", "out(a:number, b:number)", "odd(x,y) :- edge(x,y). odd(x,y) :- even(x,z), edge(z,y). even(x,y) :- odd(x,z), edge(z,y). out(x,y) :- even(x,y).",
    "WITH RECURSIVE w(a, b, odd) AS (SELECT a, b, true FROM edge UNION SELECT w.a, e.b, NOT odd FROM w JOIN edge e ON e.a = w.b) SELECT a, b FROM w WHERE NOT odd",
    ".decl odd(a:number, b:number) .decl even(a:number, b:number)",
)
_add("arith_recursion", "out(x:number)", "n(0). n(x+1) :- n(x), x < 12. out(x) :- n(x).", "SELECT CAST(i AS BIGINT) AS x FROM range(0, 13) t(i)", ".decl n(x:number)")
_add(
    "loaded_and_derived", "out(a:number, b:number)", "seed(x,y) :- seed(x,z), edge(z,y). out(x,y) :- seed(x,y).",
    "WITH RECURSIVE r(a, b) AS (SELECT a, b FROM seed UNION SELECT r.a, e.b FROM r JOIN edge e ON e.a = r.b) SELECT a, b FROM r",
)
_add(
    "loaded_bridge", "out(b:number)", "seed(x,y) :- seed(x,z), edge(z,y). out(y) :- seed(8000007,y).",
    "WITH RECURSIVE r(a, b) AS (SELECT a, b FROM seed WHERE a = 8000007 UNION SELECT r.a, e.b FROM r JOIN edge e ON e.a = r.b) SELECT b FROM r", mode="guarded-compact",
)
#: Who is heavy is asked before their line of superiors is, but decided by it: asking would put the negation into a recursion.
_add_modes(
    "fallback_mixed", ("passthrough", "guarded", "guarded-compact"), "out(z:number)",
    f"line(x,y) :- parent(x,y). line(x,y) :- parent(x,z), line(z,y). far(y) :- cust(y,3,_). heavy(x) :- line(x,y), far(y). ally(x,z) :- edge(x,y), !heavy(y), line(y,z). step(x,y) :- edge(x,y). step(x,y) :- step(x,z), edge(z,y). out(z) :- ally({START},z). out(y) :- step({START},y).",
    f"""WITH RECURSIVE line(a, b) AS (SELECT c, p FROM parent UNION SELECT line.a, p FROM line JOIN parent ON parent.c = line.b), heavy AS (SELECT a FROM line JOIN cust ON cust.k = line.b WHERE cust.nation = 3),
{_SQL_REACH} SELECT line.b AS z FROM edge JOIN line ON line.a = edge.b WHERE edge.a = {START} AND NOT EXISTS (SELECT 1 FROM heavy WHERE heavy.a = edge.b) UNION SELECT b FROM reach WHERE a = {START}""",
    ".decl line(a:number, b:number) .decl far(x:number) .decl heavy(x:number) .decl ally(a:number, b:number) .decl step(a:number, b:number)",
)
_TWO = _LEFT + f"one(y) :- reach({START},y). two(y) :- reach(700,y). out(1,y) :- one(y). out(2,y) :- two(y)."
_TWO_DECLS = _REACH + " .decl one(b:number) .decl two(b:number) .output one .output two"
_add("two_queries", "out(s:number, b:number)", _TWO, f"WITH RECURSIVE {_SQL_REACH} SELECT CAST(CASE a WHEN {START} THEN 1 ELSE 2 END AS BIGINT) AS s, b FROM reach WHERE a IN ({START}, 700)", _TWO_DECLS, "guarded-compact")
for _name, _at in (("one", START), ("two", 700)):
    _add(f"two_queries_{_name}", "out(s:number, b:number)", _TWO, f"WITH RECURSIVE {_SQL_REACH} SELECT b FROM reach WHERE a = {_at}", _TWO_DECLS, "guarded-compact", _name)
_KEPT = _LEFT + f"asked(y) :- reach({START},y). out(x) :- reach(x,x)."
_KEPT_DECLS = _REACH + " .decl asked(b:number) .output asked .output reach"
_add("output_preserved", "out(n:number)", _KEPT, f"WITH RECURSIVE {_SQL_REACH} SELECT DISTINCT a AS n FROM reach WHERE a = b", _KEPT_DECLS, "guarded-compact")
_add("output_preserved_asked", "out(n:number)", _KEPT, f"WITH RECURSIVE {_SQL_REACH} SELECT b FROM reach WHERE a = {START}", _KEPT_DECLS, "guarded-compact", "asked")
_add("output_preserved_reach", "out(n:number)", _KEPT, f"WITH RECURSIVE {_SQL_REACH} SELECT a, b FROM reach", _KEPT_DECLS, "guarded-compact", "reach")
#: Relations whose names are those that the rewrite would give.
_add(
    "taken_names", "out(b:number)", _LEFT + f"reach_bf(y) :- reach({START},y), y < 9. magic_reach_bf(x) :- reach_bf(x). out(y) :- reach({START},y). out(x) :- magic_reach_bf(x).",
    f"WITH RECURSIVE {_SQL_REACH} SELECT b FROM reach WHERE a = {START}", _REACH + " .decl reach_bf(b:number) .decl magic_reach_bf(b:number)", "guarded-compact",
)
_add(
    "projection_barrier", "out(z:number)", f"p(x,z) :- edge(x,_), low(z). out(z) :- p({START},z).", f"SELECT k AS z FROM low WHERE EXISTS (SELECT 1 FROM edge WHERE a = {START})", ".decl p(x:number, z:number)", "guarded-compact",
)
_add("arith_head_demand", "out(y:number)", f"p(x+1,y) :- edge(x,y). out(y) :- p({START + 1},y).", f"SELECT DISTINCT b AS y FROM edge WHERE a = {START}", ".decl p(x:number, y:number)", "guarded-compact")


def bound(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """Frames of the relations: projections of the tables, which their scans take over."""
    out = {}
    for name in names:
        select = RELATIONS[name][1]
        table = re.search(r" FROM (\w+)", select)[1]
        items, where = re.match(r"SELECT (.*) FROM \w+(?: WHERE (.*))?$", select).groups()
        df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
        df = df.filter(where) if where else df
        out[name] = df.selectExpr(*re.split(r", (?![^()]*\))", items))
    return out


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    mode, text, _, output = QUERIES[name]
    engine = Engine(spark, mode)
    for relation, df in bound(spark, sf_dir, [r for r in parse(text).inputs]).items():
        engine.bind(relation, df)
    return engine.run(text)[output]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, name=name: run(name, spark, sf_dir) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, text, sql, _) in QUERIES.items():
        views = ", ".join(f"{r} AS ({RELATIONS[r][1]})" for r in RELATIONS if re.search(rf"\b{r}\b", sql))
        rest = re.sub(r"^WITH (RECURSIVE )?", ", ", sql) if sql.startswith("WITH ") else f" {sql}"
        out[name] = f"WITH RECURSIVE {views}{rest}" if views else sql
    return out


def flagship(spark: SparkSession, sf_dir: str, start: int = 22) -> DataFrame:
    """All that is reachable from a node, by the guarded demand rewrite."""
    text = program("out(b:number)", _LEFT + f"out(y) :- reach({start},y).", _REACH)
    return Engine(spark).bind("edge", bound(spark, sf_dir, ["edge"])["edge"]).run(text)["out"]
