"""Runs of a store: rows and manifest appear together, once."""

import os

import pytest

from pelagica.sources import commits

HEAD = "device_id,UTC_datetime,depth_m\n"
ROWS = "tag_id STRING, depth_m DOUBLE, foid BIGINT, file_name STRING, run STRING"


@pytest.fixture()
def folder(tmp_path):
    os.makedirs(tmp_path / "logs" / "sub")

    def send(name, depths):
        lines = "".join(f"1,2024-01-01 00:00:{i:02d},{d}\n" for i, d in enumerate(depths))
        (tmp_path / "logs" / name).write_text(HEAD + lines)

    send("1_a.csv", [1, 2])
    send("sub/2_a.csv", [3])
    (tmp_path / "logs" / "3_a.csv").write_text(HEAD)
    return str(tmp_path / "logs"), str(tmp_path / "store"), send


def new(spark, logs, store):
    return {r["file_name"] for r in commits.fresh_files(spark, logs, store, len(HEAD)).collect()}


def depths(spark, store):
    return sorted(r["depth_m"] for r in commits.stored_rows(spark, store, ROWS).collect())


def test_new_files_after_two_runs_and_a_crash(spark, folder, monkeypatch):
    logs, store, send = folder
    assert new(spark, logs, store) == {"1_a.csv", "sub/2_a.csv"}
    assert commits.ingest_new(spark, logs, store, "run-1", len(HEAD))
    assert depths(spark, store) == [1, 2, 3] and new(spark, logs, store) == set()

    send("4_a.csv", [4])
    assert new(spark, logs, store) == {"4_a.csv"}
    with monkeypatch.context() as patch:  # lost between the rows and the manifest's commit
        patch.setattr(commits, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            commits.ingest_new(spark, logs, store, "run-2", len(HEAD))
    assert depths(spark, store) == [1, 2, 3] and new(spark, logs, store) == {"4_a.csv"}
    assert commits.ingest_new(spark, logs, store, "run-2", len(HEAD))
    assert depths(spark, store) == [1, 2, 3, 4] and new(spark, logs, store) == set()

    send("5_a.csv", [5])
    assert not commits.ingest_new(spark, logs, store, "run-2", len(HEAD))  # a repeated run
    assert depths(spark, store) == [1, 2, 3, 4] and new(spark, logs, store) == {"5_a.csv"}
    assert commits.ingest_new(spark, logs, store, "run-3", len(HEAD))
    assert commits.ingest_new(spark, logs, store, "run-4", len(HEAD))  # nothing new
    assert depths(spark, store) == [1, 2, 3, 4, 5] and sorted(commits.committed_runs(spark, store)) == [f"run-{i}" for i in (1, 2, 3, 4)]
    assert commits.sweep(spark, store) == 2 and commits.sweep(spark, store) == 0
    assert depths(spark, store) == [1, 2, 3, 4, 5]
    by_run = {r["file_name"]: r["run"] for r in commits.manifest(spark, store).collect()}
    assert by_run == {"1_a.csv": "run-1", "sub/2_a.csv": "run-1", "4_a.csv": "run-2", "5_a.csv": "run-3"}


def test_of_two_attempts_one_commits(spark, tmp_path, monkeypatch):
    store, df = str(tmp_path / "s"), spark.createDataFrame([("a", 1)], "k string, n long")
    assert commits.append_run(df, store, "r")
    assert not commits.append_run(df, store, "r")
    monkeypatch.setattr(commits, "committed_runs", lambda *_: {})  # as the other attempt saw it before the first was done
    assert not commits.append_run(df, store, "r")
    monkeypatch.undo()
    assert commits.append_run(df, store, "s")
    assert commits.stored_rows(spark, store, df.schema).count() == 2
    assert commits.sweep(spark, store) == 0  # the loser took its folders away
    with pytest.raises(ValueError):
        commits.append_run(df, store, "../r")
