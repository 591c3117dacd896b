import json

import pytest

from lanewright.sources import search
from lanewright.sources.text_files import write_texts


def task(sn, task_id, x):
    return {"sn": sn, "task_id": task_id, "rt_message": [{"longitude": x, "latitude": 0}, {"longitude": x, "latitude": 1}]}


@pytest.fixture
def many(tmp_path, monkeypatch):
    monkeypatch.setattr(search, "FIRST_FILES", 2)
    put = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    (tmp_path / "a").mkdir()
    (tmp_path / "a [x]{1}").mkdir()
    put("a/z.json", [task("1", "t", 1), task("1", "t", 2)])
    put("a [x]{1}/1.json", [task(" 1", "t ", 3), task("2", "t", 4), task("2", "T", 4.5)])
    put("a.json", [{"sn": "3", "task_id": None, "rt_message": [{"longitude": None, "latitude": 1}]}])
    put("b.json", "{")
    put("c.json", [task("3", None, 5), task("4", "t", 6)])
    for i in range(20):
        put(f"d{i:02}.json", [task("5", str(i), i)])
    put("e.json", "[broken")
    return tmp_path


def found(spark, folder, *pairs):
    tasks, rejects = search.find_tasks(spark, str(folder), spark.createDataFrame(list(pairs), search.ASKED))
    return {(r.sn, r.task_id): (r.file.rpartition("/")[2], r.bad, [p.lon for p in r.points][:1]) for r in tasks.collect()}, sorted(r.file.rpartition("/")[2] for r in rejects.collect())


def test_first_matches_in_path_order(spark, many):
    names = [n.rpartition("/")[2] for n in search.listed(spark, str(many))]
    assert names[:5] == ["z.json", "1.json", "a.json", "b.json", "c.json"] and len(names) == 26
    assert found(spark, many, (" 1 ", "t"), ("2", "t"), ("2", "t"), (None, "t")) == ({("1", "t"): ("z.json", False, [1.0]), ("2", "t"): ("1.json", False, [4.0])}, [])
    assert found(spark, many, ("3", "None"), ("2", "T")) == ({("3", "None"): ("a.json", True, []), ("2", "T"): ("1.json", False, [4.5])}, ["b.json"])
    assert found(spark, many, ("5", "19"), ("9", "t")) == ({("5", "19"): ("d19.json", False, [19.0])}, ["b.json", "e.json"])


def test_later_files_are_not_read(spark, many, monkeypatch):
    read = []
    whole = search.read_named
    monkeypatch.setattr(search, "read_named", lambda session, names: read.append(len(names)) or whole(session, names))
    found(spark, many, ("1", "t"), ("2", "t"))
    assert read == [2]
    found(spark, many, ("5", "3"))
    assert read == [2, 2, 8]
    assert [len(g) for g in search.groups(["x"] * 50)] == [2, 8, 32, 8]


def test_what_cannot_be_searched(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        found(spark, tmp_path / "absent", ("1", "t"))
    with pytest.raises(FileNotFoundError):
        found(spark, tmp_path, ("1", "t"))


def test_texts_get_their_names(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out/b.txt").write_text("old")
    rows = [("b.txt", "new"), ("é矿 %=.json", "﻿[1]"), ("empty", "")]
    assert write_texts(spark.createDataFrame(rows, "name string, text string").repartition(2), str(tmp_path / "out")) == sorted(n for n, _ in rows)
    assert {p.name: p.read_text(encoding="utf-8").rstrip("\n") for p in (tmp_path / "out").iterdir()} == dict(rows)
    for wrong in ([("a", "x"), ("a", "y")], [("a/b", "x")], [(None, "x")], [("a", None)]):
        with pytest.raises(ValueError):
            write_texts(spark.createDataFrame(wrong, "name string, text string"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 3
