import pytest

from larkspur.plans.project import Folder, Project
from larkspur.sources import files


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, None)], "a int, b double")
    at = f"file://{tmp_path}/t.parquet"
    files.write_once(df, at)
    files.write_once(df, at)
    with pytest.warns(UserWarning):
        assert files.write_once(df.limit(1), at).count() == 2
    with pytest.raises(FileNotFoundError):
        files.read_parquet(spark, f"file://{tmp_path}/none")


def test_records_and_text(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert files.write_records(spark, [], "a int, b array<string>", f"{base}/r").count() == 0
    files.put_yaml(spark, f"{base}/m.yaml", {"new": "old"})
    assert files.get_yaml(spark, f"{base}/m.yaml") == {"new": "old"}
    files.write_sheets({"one": spark.range(3).toDF("x")}, f"{base}/book")
    assert files.read_csv(spark, f"{base}/book/one", "x long").count() == 3


def test_versions(spark, tmp_path):
    root = Folder(spark, f"file://{tmp_path}/root")
    assert root.child("version").path.endswith("version1")
    assert root.child("version", create_new=True, meta={"a": 1}).path.endswith("version2")
    assert root.child("version").path.endswith("version2") and root.child("version", 1).path.endswith("version1")
    with pytest.raises(FileNotFoundError):
        root.child("version", 7)
    with pytest.raises(ValueError):
        root.child("version", 2, meta={"a": 2})
    with pytest.raises(ValueError):
        root.child("version", 1, create_new=True)


def test_project(spark, tmp_path):
    path = f"file://{tmp_path}/study"
    df = spark.createDataFrame([(i, "F" if i % 2 else "M", float(i % 17), 1 if i % 3 else 0, float(i * i % 23)) for i in range(60)], "patient_id long, sex string, os_months double, os_event int, amount double")
    project = Project(spark, path, "study")
    data = project.add_dataset("first", df)
    with pytest.raises(ValueError):
        project.add_dataset("first", df)
    with pytest.raises(RuntimeError):
        data.analysis()
    edits = spark.createDataFrame([("sex", None, "gender", None)], "col_name string, remove boolean, change_col_name string, change_datatype string")
    meta = spark.createDataFrame([("os_event", "Event", None, "os", None), ("os_months", "Time", None, "os", None)], "col_name string, inferred_datatype string, change_datatype string, survival_label string, remove boolean")
    data.apply(edits, surv_meta=meta)
    analysis = Project(spark, path).datasets["first"].analysis()
    assert "gender" in analysis.df.columns and analysis.columns("Numerical") == ["amount"]
    assert set(analysis.summary()) == {"numerical", "normality", "categorical"}
    assert analysis.endpoints((5.0,)).first()["surv_label"] == "os" and set(analysis.config_frames()) == {"binary", "multi", "cutpoint"}
    rows = project.catalogue().collect()
    assert [r.Index for r in rows] == [1, 2, 3, 4, 5]
