import os
import time

import pytest

from clustercat.sources import tables

CATALOG = {"ra": "ra", "parallax": "plx", "g": "phot_g_mean_mag"}


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separator_is_found(spark, tmp_path, sep):
    path = tmp_path / "t.csv"
    path.write_text(sep.join("abc") + "\n" + sep.join(["1", "2.5", "x"]) + "\n")
    df = tables.scan_any(spark, str(path))
    assert df.dtypes == [("a", "int"), ("b", "double"), ("c", "string")]


def test_nan_and_inf(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("x\n1.5\nNaN\ninf\n")
    values = [r.x for r in tables.scan_any(spark, str(path)).collect()]
    assert values == [1.5, None, float("inf")]


def test_declared_schema_rejects_bad_cells(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("x\n1.5\nabc\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.scan_any(spark, str(path), "x double").collect()


def test_missing_file_and_unknown_suffix(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.scan_any(spark, str(tmp_path / "no.csv"))
    (tmp_path / "t.xls").write_text("x")
    with pytest.raises(ValueError):
        tables.scan_any(spark, str(tmp_path / "t.xls"))


def test_catalog_is_pruned_without_renaming(spark, tmp_path):
    df = spark.createDataFrame([(7, 1.0, 2.0, 3.0, "z")], "source_id long, ra double, plx double, dec double, junk string")
    path = tables.save_table(df, str(tmp_path / "c.parquet"))
    assert tables.load_catalog(spark, path, CATALOG).columns == ["ra", "plx", "dec"]
    assert tables.load_catalog(spark, path, CATALOG, key="source_id").columns == ["ra", "plx", "dec", "source_id"]
    assert tables.load_catalog(spark, path).columns == df.columns
    assert tables.load_catalog(spark, path, CATALOG, read_only_mapped=False).columns == df.columns


def test_two_spellings_of_one_name(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("ra,RA,plx\n1,2,3\n")
    spark.conf.set("spark.sql.caseSensitive", True)
    try:
        df = tables.load_catalog(spark, str(path), CATALOG)
        assert df.columns == ["ra", "plx", "RA"] and df.first().asDict() == {"ra": 1, "plx": 3, "RA": 2}
    finally:
        spark.conf.set("spark.sql.caseSensitive", False)


def test_reference_is_renamed(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("RA_ICRS,Bp-Rp,Gmag,other\n1.0,0.5,10.0,k\n")
    mapping = {"ra": "RA_ICRS", "color": "Bp-Rp", "gmag": "Gmag", "ruwe": "absent", "nonsense": "other"}
    assert tables.load_reference(spark, str(path), mapping).columns == ["ra", "color", "gmag", "other"]


@pytest.mark.parametrize("name, written", [("a", "a.csv"), ("a.csv", "a.csv"), ("a.txt", "a.txt"), ("a.pq", "a.pq")])
def test_save_chooses_by_suffix(spark, tmp_path, name, written):
    path = tables.save_table(spark.range(3), str(tmp_path / "new" / name))
    assert path == str(tmp_path / "new" / written)
    kind = "parquet" if name.endswith("pq") else "csv"
    assert getattr(spark.read.option("header", True), kind)(path).count() == 3


def test_latest_output(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.latest_output(spark, str(tmp_path))
    for name in ("z_cluster.parquet", "a.csv", "ignored.txt"):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (time.time(), time.time() - 100 + len(name)))
    os.utime(tmp_path / "a.csv")
    assert tables.latest_output(spark, str(tmp_path)).endswith("a.csv")
    assert tables.latest_output(spark, str(tmp_path), "z_cluster.parquet").endswith("z_cluster.parquet")
    with pytest.raises(FileNotFoundError):
        tables.latest_output(spark, str(tmp_path), "none.csv")


def test_first_existing_reference(spark, tmp_path):
    base = tmp_path / "processed"
    (tmp_path / "interim").mkdir()
    base.mkdir()
    assert tables.first_existing_reference(spark, str(base)) is None
    (tmp_path / "interim" / "valid_clean.csv").write_text("x")
    assert tables.first_existing_reference(spark, str(base)).endswith("valid_clean.csv")
    (base / "valid.csv").write_text("x")
    assert tables.first_existing_reference(spark, str(base)).endswith("valid.csv")


def test_separators_in_quotes_do_not_count(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"a,b,c,d";e\n1;2\n')
    assert tables.scan_any(spark, str(tmp_path / "t.csv")).columns == ["a,b,c,d", "e"]
