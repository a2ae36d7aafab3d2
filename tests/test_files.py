"""Registries, shards, rendered tables and bundles on small files."""

import gzip
import io
import zipfile

import pytest

from persistra.sources import files

REGISTRY = """
datasets:
  ward: {file: ward.dat.gz, format: {delimiter: whitespace, columns: {t: 0, u: 1, v: 2}, comment: "#%", skiprows: 1}}
  shop: {file: shop.csv, format: {delimiter: ",", columns: {u: 0, v: 1, t: 2}, skiprows: 2, bipartite: true}}
  gone: {file: gone.csv, format: {columns: {u: 0, v: 1, t: 2}}}
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "registry.yaml").write_text(REGISTRY)
    with gzip.open(tmp_path / "ward.dat.gz", "wt") as f:
        f.write("9 x y\n# note\n1 a b\n2.5 b c extra\n\n")
    (tmp_path / "shop.csv").write_text("1,2,3\n4,5,6\n7,8,9\n" + "".join(f"1,2,{i}\n" for i in range(50)))
    return str(tmp_path)


def test_registry_reads_lists_by_their_format(spark, folder):
    pytest.importorskip("yaml")
    entries = files.read_registry(spark, f"{folder}/registry.yaml")
    assert sorted(map(tuple, files.read_registered(spark, entries, "ward", folder).collect())) == [("a", "b", 1.0), ("b", "c", 2.5)]
    shop = files.read_registered(spark, entries, "shop", folder)
    assert shop.count() == 51 and ("u:7", "i:8", 9.0) in map(tuple, shop.collect()) and shop.filter("t = 6 and u = 'u:4'").count() == 0
    found = dict(files.presence(spark, entries, ["ward", "shop", "gone"], folder, 2))
    assert found["gone"] is None and found["shop"] > 200
    with pytest.raises(FileNotFoundError, match="gone"):
        files.presence(spark, entries, ["ward", "gone"], folder, 2)


def test_registry_without_columns_is_an_error(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("datasets:\n  a: {file: x, format: {columns: {u: 0, v: 1}}}\n")
    with pytest.raises(ValueError, match="entry a"):
        files.read_registry(spark, f"{tmp_path}/r.yaml")


def test_heads_of_many_files_and_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r.value for r in files.skip_head(spark, str(tmp_path), 2).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"{k}-{i}" for k in range(3) for i in range(2, 400)}


def test_shards_merge_in_order_and_refuse_repeats(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"c{i}", i / 2) for i in range(k, 30, 3)], "case_id string, x double").write.parquet(f"{tmp_path}/s{k}")
    paths = [f"{tmp_path}/s{k}" for k in range(3)]
    got = [r.case_id for r in files.merge_shards(spark, paths, f"{tmp_path}/all").coalesce(1).collect()]
    assert got == sorted(got) and len(got) == 30
    with pytest.raises(ValueError, match="repeated"):
        files.merge_shards(spark, [paths[0], paths[0]], f"{tmp_path}/no")


def test_tables_as_text(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a|b", 1, 0.5), (None, 2, None)], "s string, n long, x double").orderBy("n")
    assert files.markdown(df, 2) == "| s | n | x |\n| --- | --- | --- |\n| a\\|b | 1 | 0.50 |\n|  | 2 |  |\n"
    files.write_delimited(df, f"{tmp_path}/t", "\t", gzip=True)
    assert sorted(r.n for r in spark.read.csv(f"{tmp_path}/t", sep="\t", header=True, schema=df.schema).collect()) == [1, 2]
    monkeypatch.setattr(files, "MOST_ROWS", 1)
    with pytest.raises(ValueError, match="at most"):
        files.markdown(df)


def test_bundle_holds_what_is_there(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.md").write_bytes(bytes(range(256)))
    assert files.bundle(spark, f"{tmp_path}/out.zip", str(tmp_path), ["a.csv"], ["b.md", "c.md"]) == ["a.csv", "b.md"]
    with zipfile.ZipFile(io.BytesIO((tmp_path / "out.zip").read_bytes())) as z:
        assert z.namelist() == ["a.csv", "b.md"] and z.read("b.md") == bytes(range(256))
    with pytest.raises(FileNotFoundError, match="c.md"):
        files.bundle(spark, f"{tmp_path}/out.zip", str(tmp_path), ["c.md"])
