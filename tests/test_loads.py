import os

import pytest

from opsmill.sources.loads import LoadError, StageTable

SCHEMA = "id bigint, name string, at date"


def stage(tmp_path, **contents):
    folder = tmp_path / "stage"
    folder.mkdir(exist_ok=True)
    for name, lines in contents.items():
        (folder / f"{name}.csv").write_text("\n".join(["id,name,at", *lines]) + "\n")
    return str(folder)


def ids(table):
    return sorted(r["id"] for r in table.read().collect())


def test_each_file_once(spark, tmp_path):
    table = StageTable(spark, str(tmp_path / "table"), SCHEMA)
    folder = stage(tmp_path, one=["1,a,2024-01-01", "2,b,x"], two=["3,c,"])
    assert table.load(folder) == {"load": 0, "files": 2, "rows": 2, "rejected": 1}
    assert ids(table) == [1, 3]
    assert table.load(folder)["files"] == 0 and ids(table) == [1, 3]
    stage(tmp_path, **{"three +%20": ["4,d,2024-01-02"]})
    assert table.load(folder) == {"load": 1, "files": 1, "rows": 1, "rejected": 0}
    assert table.load(folder)["files"] == 0 and ids(table) == [1, 3, 4]
    # Touched, and written again with the same lines: known, not loaded.
    os.utime(f"{folder}/one.csv", (1, 1))
    assert table.load(folder)["files"] == 0 and ids(table) == [1, 3, 4]
    status = {(os.path.basename(r["path"]), r["load"]): r["status"] for r in table.ledger().collect()}
    assert status[("one.csv", 0)] == "loaded" and status[("one.csv", 2)] == "known"
    # Another schema object sees the same table.
    assert ids(StageTable(spark, str(tmp_path / "table"), SCHEMA)) == [1, 3, 4]


@pytest.mark.parametrize("changed, wanted", [("replace", [2, 5, 6]), ("add", [1, 2, 5, 6])])
def test_a_changed_file(spark, tmp_path, changed, wanted):
    table = StageTable(spark, str(tmp_path / "table"), SCHEMA, changed=changed)
    folder = stage(tmp_path, one=["1,a,"], two=["2,b,"])
    table.load(folder)
    stage(tmp_path, one=["5,a,", "6,a,"])
    assert table.load(folder)["rows"] == 2 and ids(table) == wanted
    os.remove(f"{folder}/one.csv")  # what is gone from the folder stays in the table
    assert table.load(folder)["files"] == 0 and ids(table) == wanted


def test_rows_that_do_not_fit(spark, tmp_path):
    folder = stage(tmp_path, good=["1,a,"], bad=["2,b,", "x,c,"])
    skipping = StageTable(spark, str(tmp_path / "skipping"), SCHEMA, on_error="skip_file")
    assert skipping.load(folder) == {"load": 0, "files": 1, "rows": 1, "rejected": 1} and ids(skipping) == [1]
    aborting = StageTable(spark, str(tmp_path / "aborting"), SCHEMA, on_error="abort")
    with pytest.raises(LoadError, match="bad.csv"):
        aborting.load(folder)
    assert aborting.ledger() is None and not os.path.exists(tmp_path / "aborting" / "_versions")
    stage(tmp_path, bad=["2,b,", "3,c,"])
    assert aborting.load(folder)["rows"] == 3 and ids(aborting) == [1, 2, 3]
    with pytest.raises(ValueError):
        StageTable(spark, "x", SCHEMA, on_error="ignore")


def test_a_load_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    table = StageTable(spark, str(tmp_path / "table"), SCHEMA)
    folder = stage(tmp_path, one=["1,a,"])
    table.load(folder)
    stage(tmp_path, two=["2,b,"])
    from opsmill import places

    def stopped(*_):
        raise OSError("stopped")

    with monkeypatch.context() as patched:
        # The rows are written, the version is not.
        patched.setattr(places, "publish", stopped)
        with pytest.raises(OSError):
            table.load(folder)
    assert ids(table) == [1] and table.ledger().count() == 1
    assert table.load(folder) == {"load": 1, "files": 1, "rows": 1, "rejected": 0} and ids(table) == [1, 2]


def test_many_loads_make_few_runs(spark, tmp_path):
    table = StageTable(spark, str(tmp_path / "table"), SCHEMA)
    for n in range(9):
        folder = stage(tmp_path, **{f"f{n}": [f"{n},a,"]})
        table.load(folder)
    version = table._table.version()
    assert ids(table) == list(range(9)) and len(version.runs) <= 4 and len(version.beside) <= 4
