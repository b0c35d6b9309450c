from turnstone import cli

D = "/root/testdata/sf0.001"


def test_commands(spark, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["queries"]) == 0 and "p6_found" in capsys.readouterr().out
    assert cli.main(["query", "nothing", "--data", D]) == 2 and cli.main(["query", "word_stats", "--data", D]) == 0
    assert cli.main(["preview", "--data", D, "--rows", "3"]) == 0 and cli.main(["stats", "--data", D]) == 0
    assert cli.main(["process", "--data", D, "--out", out, "--language", "en"]) == 0
    for command in ("validate", "health", "repair", "report", "retry"):
        assert cli.main([command, "--out", out]) == 0, command
    assert "<!doctype html>" in spark.read.text(f"{out}/report", wholetext=True).first().value
    assert cli.main(["version", "--out", out, "--tag", "v1"]) == 0
    capsys.readouterr()
    assert cli.main(["version", "--out", out]) == 0 and "v1" in capsys.readouterr().out
    assert spark.read.json(f"{out}/stats").first().processed > 0
