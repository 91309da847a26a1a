import json

import pytest

from tracegauge import __main__ as command


def call(spark, capsys, *argv):
    code = command.main(argv, spark)
    said = capsys.readouterr()
    return code, said.out, said.err


def test_one_record(spark, capsys):
    code, out, _ = call(spark, capsys, "-i", "CPF 529.982.247-25", "-o", "noted", "-c", "user:hello: you", "-e", "pii_detection", "-e", "refusal")
    got = {r["evaluator"]: r for r in map(json.loads, out.splitlines())}
    assert code == 0 and got["pii_detection"]["label"] == "fail" and got["pii_detection"]["explanation"] == "cpf=1 (input)" and got["refusal"]["label"] == "pass" and "529" not in out
    code, out, _ = call(spark, capsys, "-i", "x", "-o", "y", "--pretty")
    assert code == 0 and out.startswith("{\n") and json.loads(out)["judge_calls"][0]["model"] == "hash"


def test_records_of_files(spark, capsys, tmp_path):
    lines = [json.dumps({"input": f"q{i}", "output": "a@b.co" if i % 3 == 0 else "fine", "id": f"r{i}"}) for i in range(7)]
    (tmp_path / "in.jsonl").write_text("\n".join(lines) + "\n")
    code, out, _ = call(spark, capsys, "--jsonl", str(tmp_path / "in.jsonl"), "-e", "pii_detection")
    assert code == 0 and [(r["id"], r["label"]) for r in map(json.loads, out.splitlines())] == [(f"r{i}", "pass" if i % 3 else "fail") for i in range(7)]
    to = str(tmp_path / "out")
    code, out, _ = call(spark, capsys, "--jsonl", str(tmp_path / "in.jsonl"), "-e", "pii_detection", "--to", to)
    assert code == 0 and not out and sorted(json.loads(r.value)["id"] for r in spark.read.text(to).collect()) == [f"r{i}" for i in range(7)]
    assert call(spark, capsys, "--jsonl", str(tmp_path / "in.jsonl"), "-e", "pii_detection", "--to", to)[0] == 2


def test_errors_are_told_by_the_exit_code(spark, capsys, monkeypatch):
    class Broken:
        def complete(self, conversation):
            raise ConnectionError

    evaluate = command.evaluate
    monkeypatch.setattr(command, "evaluate", lambda rows, s: evaluate(rows, s, client=Broken))
    code, out, _ = call(spark, capsys, "-i", "x", "-o", "y")
    assert code == 1 and json.loads(out)["error_type"] == "ConnectionError"


@pytest.mark.parametrize("argv", [("-i", "x"), (), ("--jsonl", "/nowhere/at/all"), ("-i", "x", "-o", "y", "-e", "nothing"), ("--jsonl", "a", "-i", "x"), ("--odd",), ("-i", "x", "-o", "y", "-c", "tool:z")])
def test_wrong_calls(spark, capsys, argv):
    assert call(spark, capsys, *argv)[0] == 2


def test_a_wrong_record_stops_all(spark, capsys, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"input": "a", "output": "b"}\n{"input": "a"}\n')
    code, out, err = call(spark, capsys, "--jsonl", str(tmp_path / "in.jsonl"), "-e", "pii_detection")
    assert code == 2 and not out and err == "error: record 1: missing output\n"
