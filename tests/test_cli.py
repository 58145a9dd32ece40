import json

from strandlog import cli


def test_usage(capsys):
    assert cli.main(["--version"]) == 0 and "strandlog" in capsys.readouterr().out
    assert cli.main(["help-me"]) == 2


def test_commands(spark, tmp_path, capsys):
    schema = tmp_path / "s.schema"
    schema.write_text("schema! { notes { id id; body text; lookup body } }")
    root = "file://" + str(tmp_path / "db")
    run = lambda *a: cli.main(list(a))
    assert run("check", str(schema)) == 0
    for i, body in (("a", "red fox"), ("b", "red dog")):
        assert run("put", root, str(schema), "notes", json.dumps({"id": i, "body": body})) == 0
    capsys.readouterr()
    assert run("get", root, str(schema), "notes", "a") == 0 and json.loads(capsys.readouterr().out)["body"] == "red fox"
    assert run("search", root, str(schema), "notes", "body", "red", "dog") == 0 and json.loads(capsys.readouterr().out)["id"] == "b"
    assert run("index", root, str(schema), "notes", "body") == 0 and run("search", root, str(schema), "notes", "body", "fox") == 0 and json.loads(capsys.readouterr().out)["id"] == "a"
    torn = tmp_path / "seg"
    torn.mkdir()
    (torn / "zzz.6").write_text("id\tbody\nR\t4\ta\tx\nR\t5\tb")
    assert run("repair", root, str(schema), "notes", str(torn)) == 0 and json.loads(capsys.readouterr().out) == {"files": 1, "operations": 1, "next_tx": 5}
    assert run("vacuum", root, str(schema), "notes") == 0
    assert run("delete", root, str(schema), "notes", "a") == 0
    assert run("compact", root, str(schema), "notes") == 0
    assert run("get-by", root, str(schema), "notes", "body", "red dog") == 0
    assert run("inspect", root, str(schema), "notes") == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["rows"] == 1
    assert run("put", root, str(schema), "notes", json.dumps({"id": "x"})) == 1
