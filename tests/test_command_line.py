import json

import weftline
from weftline.__main__ import main


def test_verbs(spark, tmp_path, capsys):
    old, new = tmp_path / "a.json", tmp_path / "b.json"
    old.write_text(json.dumps({"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "integer"}}}))
    new.write_text(json.dumps({"type": "object", "properties": {"a": {"type": "string"}}}))
    assert main(["check", str(old), str(old)]) == 0 and "compatible" in capsys.readouterr().out
    assert main(["check", str(old), str(new), "--json"]) == 1 and json.loads(capsys.readouterr().out)["compatible"] is False
    assert main(["validate", str(old)]) == 0 and main(["schema", str(old)]) == 0
    assert "root.a" in capsys.readouterr().out
    assert main(["eval", "x * 2 + 1", "--env", '{"x": 20}']) == 0 and capsys.readouterr().out.strip() == "41"
    spark.range(3).selectExpr("id as k", "'v' as label").write.parquet(f"{tmp_path}/d")
    lens = tmp_path / "l.json"
    lens.write_text(json.dumps({"id": "l", "steps": [{"rename_field": {"old": "k", "new": "key"}}, {"remove_field": "label"}]}))
    assert main(["convert", f"{tmp_path}/d", f"{tmp_path}/o", "--lens", str(lens)]) == 0
    assert spark.read.parquet(f"{tmp_path}/o").columns == ["key"]
    to = spark.range(1).selectExpr("id as k", "'v' as label", "1 as n")
    to.write.parquet(f"{tmp_path}/t")
    assert main(["convert", f"{tmp_path}/d", f"{tmp_path}/p", "--to", f"{tmp_path}/t", "--format", "json"]) == 0
    assert spark.read.json(f"{tmp_path}/p").count() == 3


def test_public_names():
    assert all(hasattr(weftline, n) for n in weftline.__all__)
