from keyloom import cli


def test_commands(spark, tmp_path, capsys):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    p = tmp_path
    run("generate", p / "g.parquet", "--scale", 6)
    edges = spark.read.parquet(str(p / "g.parquet"))
    assert edges.count() == 64
    run("tostring", p / "g.parquet", p / "t")
    run("parse", p / "t", p / "p.parquet")
    assert sorted(spark.read.parquet(str(p / "p.parquet")).collect()) == sorted(edges.collect())
    run("sort", p / "p.parquet", p / "s.parquet")
    run("checksort", p / "s.parquet")
    assert capsys.readouterr().out.strip().splitlines()[-1] == "in order"
    spark.createDataFrame([(3, 1), (2, 1)], "src long, dst long").coalesce(1).write.parquet(str(p / "u.parquet"))
    run("checksort", p / "u.parquet")
    assert "2 follows 3" in capsys.readouterr().out
    run("merge", p / "s.parquet", p / "t", p / "m.parquet")
    assert spark.read.parquet(str(p / "m.parquet")).count() == 128
    run("encode", p / "p.parquet", p / "csr")
    assert spark.read.parquet(str(p / "csr/index")).count() >= 1
    run("bfs", p / "p.parquet", p / "b.parquet", "--source", 0)
    run("bfs", p / "p.parquet", p / "path.parquet", "--source", 0, "--target", 0)
    assert [tuple(r) for r in spark.read.parquet(str(p / "path.parquet")).collect()] == [(0, 0)]
    run("pagerank", p / "p.parquet", p / "r.parquet", "--steps", 2)
    assert spark.read.parquet(str(p / "r.parquet")).count() == edges.agg({"src": "max"}).collect()[0][0] + 1
