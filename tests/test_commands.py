import json

from veilframe import api
from veilframe.__main__ import main


def test_verbs(tmp_path, spark, capsys, monkeypatch):
    store, source, out, back = (tmp_path / n for n in ("store", "in", "out", "back"))
    for folder in (source, out, back):
        folder.mkdir()
    (source / "a.txt").write_text("scrivi a a.b@x.it per Zorpix")
    (source / "b.pdf").write_text("x")
    run = lambda *args: main([args[0], "--store", str(store), *map(str, args[1:])], spark)
    monkeypatch.delenv("VEILFRAME_PASSWORD", raising=False)
    assert run("init") == 1
    monkeypatch.setenv("VEILFRAME_PASSWORD", "segreto")
    assert run("init") == 0 and run("init") == 1
    assert run("glossary", "add", "Zorpix", "--kind", "AZIENDA") == 0 and run("glossary", "remove", "altro") == 1
    capsys.readouterr()
    assert run("glossary", "list") == 0 and "Zorpix\tAZIENDA" in capsys.readouterr().out
    assert run("verify", source) == 2
    capsys.readouterr()
    assert run("anonymize", source, "--out", out, "--json") == 0
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert report["summary"] == {"masked": 1, "dry-run": 0, "skipped": 1, "error": 0, "blocked": 0} and "x.it" not in json.dumps(report)
    assert (out / "a.anon.txt").read_text() == "scrivi a [EMAIL_1] per [AZIENDA_1]"
    assert run("restore", out, "--out", back) == 0 and (back / "a.anon.restored.txt").read_text() == (source / "a.txt").read_text()
    (out / "a.anon.txt").write_text("[EMAIL_9]")
    assert run("restore", out, "--out", back) == 3


def test_lists_and_one_text(spark):
    none = spark.createDataFrame([], "value string")
    listed = api.allow(api.allow(none, " Città "), "citta")
    assert [r.value for r in listed.collect()] == ["Città"] and api.is_allowed(listed, "CITTÀ") and api.disallow(listed, "citta").count() == 0
    masked, mapping = api.anonymize_text(spark, "a.b@x.it")
    assert masked == "[EMAIL_1]" and api.restore_text(spark, "qui [EMAIL_1]", mapping) == "qui a.b@x.it"
