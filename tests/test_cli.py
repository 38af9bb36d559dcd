import numpy as np

from tessera import cli


def call(spark, *args):
    return cli.run(spark, cli.parser().parse_args(list(args)))


def test_commands(spark, tmp_path):
    at = lambda n: f"{tmp_path}/{n}.parquet"
    save = lambda n, rows, schema: spark.createDataFrame(rows, schema).write.parquet(at(n))
    save("rows", [("p", c, f"s{k}", f"s{k}_0", True, float(k + (c == "b"))) for k in range(8) for c in "ab"], "parent string, class string, scene string, scan string, valid boolean, value double")
    assert call(spark, "fit", at("rows"), "--out", at("priors")) == 0
    assert sorted(r.level for r in spark.read.parquet(at("priors")).collect()) == ["class", "class", "global", "parent"]
    save("gt", [("s", k, "chair", 1 + k // 3) for k in range(6)], "scene string, point long, class string, instance long")
    save("pred", [("s", 9 + k // 3, "chair", 0.9, k) for k in range(6)], "scene string, prediction long, class string, score double, point long")
    assert call(spark, "evaluate", at("gt"), at("pred"), "--least", "1", "--out", at("ap")) == 0
    assert {r.ap for r in spark.read.parquet(at("ap")).collect()} == {1.0}
    np.savez(tmp_path / "z.npz", coords=np.zeros((2, 3)), semantic=np.zeros(2), instance=np.zeros(2))
    assert call(spark, "prepare-gt", f"{tmp_path}/z.npz", "--out", at("scene")) == 0 and spark.read.parquet(at("scene")).count() == 2
    save("pts", [(k, float(k), 0.0, 0.0) for k in range(4)], "id long, x double, y double, z double")
    save("few", [(0, 0.0, 0.0, 0.01)], "id long, x double, y double, z double")
    assert call(spark, "audit-alignment", at("pts"), at("pts"), "--out", at("full")) == 0
    assert call(spark, "audit-alignment", at("pts"), at("few"), "--out", at("part")) == 1
    save("objects", [("o", True, True), ("o", True, False), ("o", None, True)], "object string, predicted boolean, actual boolean")
    assert call(spark, "audit-objects", at("objects"), "--out", at("audit")) == 0
    r = spark.read.parquet(at("audit")).first()
    assert (r.tp, r.fp, r.fn, r.precision) == (1, 1, 0, 0.5)
