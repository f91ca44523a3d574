import json
import os
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException

from sparkveil import cli
from sparkveil.sources import files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_strict_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("متن".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_texts(spark, str(tmp_path), "null").collect()}
    assert got == {"a.txt": "متن", "b.txt": None}
    with pytest.raises(PySparkException):
        files.read_texts(spark, str(tmp_path)).collect()
    assert files.sha256_of(spark, str(tmp_path / "a.txt")).count() == 1


def test_plain_files(tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("x", "utf-8")
    for path, error in [(tmp_path / "no", FileNotFoundError), (tmp_path, IsADirectoryError)]:
        with pytest.raises(error):
            files.read_text(str(path))
    with pytest.raises(ValueError):
        files.write_text("y", str(p), str(p))
    with pytest.raises(ValueError):
        files.write_artifact({"a": [{"value": 1}]}, str(tmp_path / "r.json"))
    files.write_artifact({"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 2, "b": 1} and files.dumps({"é": 1}) == '{\n  "é": 1\n}\n'


def test_conll(spark, tmp_path):
    (tmp_path / "x.conll").write_text("علی|B-PER\na|b|O\n\n\nتهران  B-LOC\nbad\n", "utf-8")
    rows = [(r.sent_id, r.pos, r.token, r.tag) for r in files.read_conll(spark, str(tmp_path / "x.conll")).orderBy("sent_id", "pos").collect()]
    assert rows == [(0, 0, "علی", "B-PER"), (0, 1, "a|b", "O"), (1, 0, "تهران", "B-LOC")]
    with pytest.raises(PySparkException, match="line 6"):
        files.read_conll(spark, str(tmp_path / "x.conll"), strict=True).collect()


def test_private_columns(spark):
    df = spark.createDataFrame([], "id int, d array<struct<type:string,value:string>>, m map<string,struct<text:string>>")
    assert files.private_columns(df) == ["d.value", "m.text"]


def test_detector_names():
    assert cli.parse_detectors(None) is None and cli.parse_detectors("none,") == [] and [d.type for d in cli.parse_detectors("card, sheba")] == ["BANK_CARD", "IR_IBAN"]
    with pytest.raises(ValueError):
        cli.parse_detectors("legal")


def test_command_line(tmp_path):
    run = lambda *a, stdin="": subprocess.run([sys.executable, "-m", "sparkveil", *a], input=stdin.encode(), capture_output=True, cwd=ROOT, timeout=200)
    out = run("redact", "-d", "national_id", stdin="کد 0000000132")
    assert out.returncode == 0 and out.stdout.decode() == "کد [IR_NATIONAL_ID_1]"
    bad = run("detect", str(tmp_path / "no"))
    assert bad.returncode == 1 and bad.stderr.decode().splitlines()[-1].startswith("error:")
    assert run("nothing").returncode == 2
