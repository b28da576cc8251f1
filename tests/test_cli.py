import json

from hornbeam.__main__ import main

TEXT = ".decl e(a:number,b:number) .input e .decl r(a:number,b:number) .decl out(b:number) .output out r(x,y) :- e(x,y). r(x,y) :- r(x,z), e(z,y). out(y) :- r(1,y)."


def call(capsys, tmp_path, text, command, *more):
    (tmp_path / "p.dl").write_text(text)
    code = main([command, str(tmp_path / "p.dl"), *more])
    return code, capsys.readouterr().out


def test_statuses(capsys, tmp_path):
    for text, command, status in (
        (TEXT, "lex", "ok"), ("é", "lex", "parse_error"), (TEXT, "parse", "ok"), ("p(", "parse", "parse_error"), (TEXT, "roundtrip", "ok"), (TEXT, "check", "ok"),
        (".decl p(a:number) p(x) :- p(x), !p(x).", "check", "rejected"), (TEXT, "inspect", "ok"),
    ):
        code, out = call(capsys, tmp_path, text, command)
        assert json.loads(out)["status"] == status and code == (status != "ok")
    assert main(["check", str(tmp_path / "missing")]) == 1


def test_texts(capsys, tmp_path):
    code, out = call(capsys, tmp_path, TEXT, "emit")
    assert code == 0 and "magic_r_bf(1)." in out
    code, out = call(capsys, tmp_path, TEXT, "explain", "--mode", "guarded")
    assert code == 0 and "WORKLIST 0 r bf" in out


def test_run(spark, capsys, tmp_path):
    (tmp_path / "e.facts").write_text("1\t2\n2\t3\n7\t8\n")
    code, out = call(capsys, tmp_path, TEXT, "run", "--facts", str(tmp_path), "--out", str(tmp_path), "--profile")
    assert code == 0 and json.loads(out)["outputs"] == {"out": 2}
    assert sorted((tmp_path / "out.csv").read_text().split()) == ["2", "3"]
    (tmp_path / "e.facts").write_text("1\n")
    assert call(capsys, tmp_path, TEXT, "run", "--facts", str(tmp_path))[0] == 1
