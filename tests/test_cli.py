from huegraph.cli import main


def test_prints_and_writes(spark, tmp_path, capsys):
    (tmp_path / "pair.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n8 8 1\n8 1\n")
    main(["--mat", str(tmp_path / "pair.mtx"), "--k", "3", "--distance", "1"], spark)
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "k=3 colors=8 total=2 max=1" and out[1] == "k=3 colors=16 total=0 max=0" and len(out) == 8
    main(["--mat", "2x2x2", "--out", str(tmp_path / "report")], spark)
    assert spark.read.parquet(str(tmp_path / "report")).count() == 128
