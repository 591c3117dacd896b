import json

import pytest

from lanewright.plans import engine
from lanewright.plans.engine import Engine, NoTrack, TaskNotFound, batch_maps, pages
from lanewright.sources import json_files as J


def message(lon, lat, at="", speed=None):
    return {"longitude": lon, "latitude": lat, "received_at": at, "speed": speed}


def lane(uid, points, kind=101, after=None, **more):
    curve = {"segment": [{"line_segment": {"point": [{"x": x, "y": y} for x, y in part]}} for part in points]}
    return {J.TYPE_ID: kind, J.TYPE_NAME: "lane", J.NAME: f"n{uid}", J.PAYLOAD: {"uid": uid, "central_curve": curve, "successor_uid": after, **more}}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "gps" / "deep").mkdir(parents=True)
    put = lambda name, value, **how: (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False), **({"encoding": "utf-8"} | how))
    put("gps/D1x矿.json", [{"sn": 7, "task_id": " t1 ", "rt_message": [message(0.0005, 0, "b", 4), message("0.0005", 0, "c"), message(0.0035, 0.0, "d", 9)]}, 3], encoding="utf-8-sig")
    put("gps/deep/z.json", {"sn": "7", "task_id": "t1", "rt_message": []})
    put("gps/deep/one.json", {"sn": "8", "task_id": "t", "rt_message": [message(1, 1)]})
    put("gps/E2.json", {"task_id": None, "rt_message": [message(0.001, 0.0, "b"), message(0.002, 0.0, "a"), message(None, 1)]})
    (tmp_path / "gps/bad.json").write_text("{")
    resources = [
        lane("1", [[(0, 0), (0.001, 0)], [(0.001, 0), (0.002, 0)]], after="2"), lane("2", [[(0.002, 0), (0.004, 0)]]), lane("3", [[(0, 0)]], kind="101"), lane("4", []),
        {J.TYPE_ID: 5, J.TYPE_NAME: "pit", J.NAME: None, J.PAYLOAD: json.dumps({"polygon": {"point": [{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 1, "y": 1}]}})},
    ]
    put("map.json", [*resources, "stray"])
    put("clean.json", resources)
    return tmp_path


def test_route(spark, folder):
    engine = Engine(spark, f"{folder}/gps", f"{folder}/map.json")
    assert engine.health()["lane_count"] == 2 == engine.reload()
    got = engine.route(" 7", "t1 ", show_lanes=True)
    s = got["summary"]
    assert s["planned_lane_uids"] == ["1", "2"] and s["history_point_count"] == 2 and s["source_file"] == "D1x矿.json" and s["jump_distance_m"] == 0
    assert s["distance_difference_m"] == pytest.approx(s["history_distance_m"] - s["planned_distance_m"]) and len(s) == 16
    assert "<svg" in got["map_html"] and "network" in got["map_html"]
    with pytest.raises(NoTrack):
        engine.route("8", "t")
    with pytest.raises(TaskNotFound, match="bad.json"):
        engine.route("7", "T1")
    with pytest.raises(ValueError):
        engine.route(" ", "t")
    assert engine.summaries().count() == 1
    with pytest.raises(ValueError, match="json"):
        Engine(spark, f"{folder}/gps", f"{folder}/map.json", strict=True).reload()


def test_batch(spark, folder, tmp_path):
    status = {s["file"].rpartition("/")[2]: s for s in batch_maps(spark, f"{folder}/gps", f"{folder}/clean.json", f"{tmp_path}/out")}
    assert status["bad.json"]["status"] == "not JSON" and status["D1x矿.json"]["status"] == "not JSON"  # a byte-order mark
    page = open(status["E2.json"]["target"], encoding="utf-8").read()
    assert "Task 1: None | " in page and "areas" in page and "lanes" in page and "checkbox" in page
    assert [s["file"].rpartition("/")[2] for s in batch_maps(spark, f"{folder}/gps", f"{folder}/clean.json", f"{tmp_path}/out")] == sorted(status) == ["D1x矿.json", "E2.json", "bad.json"]


def test_first_match_decides(spark, folder):
    (folder / "gps/A0.json").write_text(json.dumps([{"sn": 1, "task_id": "x", "rt_message": [message(None, 1), message(0, 0)]}]))
    (folder / "gps/A1.json").write_text(json.dumps([{"sn": 1, "task_id": "x", "rt_message": [message(0.0005, 0), message(0.0035, 0)]}]))
    with pytest.raises(NoTrack, match="A0.json"):
        Engine(spark, f"{folder}/gps", f"{folder}/map.json").route("1", "x")
    with pytest.raises(ValueError, match="A0.json|E2.json|bad.json"):
        Engine(spark, f"{folder}/gps", f"{folder}/map.json", strict=True).tasks()


def test_what_is_not_there(spark, folder):
    (folder / "none").mkdir()
    (folder / "scalar.json").write_text("5")
    (folder / "empty.json").write_text("[]")
    for tasks, resource, error in (("absent", "map.json", FileNotFoundError), ("none", "map.json", FileNotFoundError), ("gps", "absent.json", FileNotFoundError), ("gps", "empty.json", ValueError), ("gps", "scalar.json", ValueError)):
        with pytest.raises(error):
            Engine(spark, f"{folder}/{tasks}", f"{folder}/{resource}").health()
    with pytest.raises(FileNotFoundError):
        batch_maps(spark, f"{folder}/none", f"{folder}/map.json", f"{folder}/out")


def test_batch_files_without_maps(spark, folder):
    (folder / "gps/F1.json").write_text(json.dumps([{"task_id": "a", "rt_message": [message("x1", 0), message(0, 0), message(1, 1)]}]))
    (folder / "gps/F2.json").write_text(json.dumps([{"task_id": "a", "rt_message": [message(0, 0)]}]))
    status = {s["file"].rpartition("/")[2]: s["status"] for s in batch_maps(spark, f"{folder}/gps", f"{folder}/clean.json", f"{folder}/out")}
    assert status["F1.json"] == "a number that can't be read" and status["F2.json"] == "no track of two points or more" and status["E2.json"] == "written"


def test_batch_files_spoiled(spark, folder):
    put = lambda name, value: (folder / "gps" / name).write_text(json.dumps(value))
    put("G1.json", [{"rt_message": [message(0, 0), message(1, 1)]}, 3])
    put("G2.json", [{"rt_message": [message(0, 0), message(1, 1), "no message"]}])
    put("G3.json", [{"rt_message": [message(0, 0, 5), message(1, 1, "a")]}])
    put("G4.json", [{"rt_message": [message(0, 0, None), message(1, 1, "a")]}])
    put("H1.json", [{"rt_message": [message(0, 0, 10), message(1, 1, 9), message(2, 2, 9.5)]}])
    rows = {r["file"].rpartition("/")[2]: r for r in J.batch_tasks(J.records(J.files(spark, f"{folder}/gps", recursive=False), strict=True)[0]).orderBy("pos").collect()}
    assert all(rows[f"G{i}.json"]["bad"] for i in (1, 2, 3, 4)) and not rows["H1.json"]["bad"] and [p["lon"] for p in rows["H1.json"]["points"]] == [1.0, 2.0, 0.0]


def test_batch_resources_spoiled(spark, folder):
    put = lambda value: (folder / "bad_map.json").write_text(json.dumps(value))
    for wrong in ("stray", lane("5", [[(0, 0), ("east", 1)]]), {J.PAYLOAD: {"polygon": {"point": [{"x": 0, "y": []}]}}}):
        put([lane("4", [[(0, 0), (1, 1)]]), wrong])
        with pytest.raises(ValueError, match="bad_map.json: an item|bad_map.json: a coord"):
            batch_maps(spark, f"{folder}/gps", f"{folder}/bad_map.json", f"{folder}/out")
    put([lane("4", [[(0, 0), ("1", 1)], [(None, "x"), ("3", 4)]])])  # a vertex without both coordinates isn't read at all
    assert pages(spark, f"{folder}/gps", f"{folder}/bad_map.json")[0].count() == 1


def test_the_last_file_of_a_device_has_the_page(spark, folder):
    for name, x in (("K1.json", 1), ("K1矿b.json", 2), ("K1矿a.json", 3)):
        (folder / "gps" / name).write_text(json.dumps([{"task_id": f"task{x}", "rt_message": [message(x, 0), message(x, 1)]}]))
    status = batch_maps(spark, f"{folder}/gps", f"{folder}/clean.json", f"{folder}/out")
    own = [s for s in status if s["file"].rpartition("/")[2].startswith("K1")]
    assert len({s["target"] for s in own}) == 1 and all(s["status"] == "written" for s in own)
    assert "task2" in open(own[0]["target"], encoding="utf-8").read()
    assert sorted(p.name for p in (folder / "out").iterdir()) == sorted({s["target"].rpartition("/")[2] for s in status if "target" in s})  # nothing else is left


def test_batch_features(spark, folder):
    far = lane("9", [[(k / 1000, 0) for k in range(700)], [(0.699, 0), (0.7, 0)]])
    (folder / "twice.json").write_text(json.dumps([far, far]))
    areas, lines = J.features(J.records(J.files(spark, f"{folder}/twice.json", recursive=False), strict=True)[0])
    assert areas.count() == 0 and [(len(r["points"]), r["raw_count"], r["tooltip"]) for r in lines.collect()] == [(701, 701, "n9 | lane | 类型ID=101")] * 2
    made, _ = pages(spark, f"{folder}/gps", f"{folder}/twice.json")
    html = made.first()["html"]
    assert html.count("n9 | lane") == 2 and html.count(",") < 3 * 300


def test_batch_order_and_defaults(spark, folder):
    rows = J.batch_tasks(J.records(J.files(spark, f"{folder}/gps", recursive=False), strict=True)[0]).collect()
    row = next(r for r in rows if r["device"] == "E2")
    assert [p["lon"] for p in row["points"]] == [0.002, 0.001] and row["task_id"] is None and row["start_time"] == ""


def test_files_in_path_order(spark, folder):
    found, bad = J.records(J.files(spark, f"{folder}/gps"))
    assert found.count() == 4 and [r["reason"] for r in bad.collect()] == ["not JSON"]
    tasks = J.tasks(found)
    assert tasks.count() == 4 and tasks.filter("bad").count() == 1


def test_lanes_twice_keep_the_first_place(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([lane("a", [[(0, 0), (1, 0)]]), lane("b", [[(0, 0)]]), lane("a", [[(5, 5), (6, 5)]], predecessor_uid=[" b ", "None", None, 3])]))
    rows = {r["uid"]: r for r in J.lanes(J.records(J.files(spark, str(tmp_path)))[0])[0].collect()}
    assert rows["a"]["start_point"]["lon"] == 5.0 and rows["a"]["lane_ord"] < rows["b"]["lane_ord"] and rows["a"]["predecessor_uid"] == ["b", "3"] and rows["b"]["length_m"] == 0.0


def test_resources_are_parsed_once_for_a_map(spark, tmp_path, monkeypatch):
    """Areas, lines and what can't be read come from one stored pass over the resource files; each file was parsed three times."""
    (tmp_path / "tasks").mkdir()
    points = [{"x": 110 + i / 1e3, "y": 40 + i * i / 1e3} for i in range(4)]
    message = [{"longitude": p["x"], "latitude": p["y"], "received_at": str(i)} for i, p in enumerate(points)]
    (tmp_path / "tasks" / "a.json").write_text(json.dumps([{"sn": "1", "task_id": "t", "rt_message": message}]))
    curve = {"segment": [{"line_segment": {"point": points}}]}
    items = [{J.NAME: "n", J.TYPE_NAME: "k", J.TYPE_ID: 101, J.PAYLOAD: json.dumps({"central_curve": curve, "polygon": {"point": points}})}, {J.PAYLOAD: "{broken"}]
    (tmp_path / "map.json").write_text(json.dumps(items))
    stored, of = [], engine.written
    monkeypatch.setattr(engine, "written", lambda df, name: stored.append(name) or of(df, name))
    rows, *_ = engine.drawn(spark, str(tmp_path / "tasks"), str(tmp_path / "map.json"))
    assert [n for n in stored if n in ("areas", "lines", "shapes")] == ["shapes"]
    assert sorted((r["layer"], r["kind"], len(r["coords"]), r["tooltip"]) for r in rows.filter("layer in ('lanes', 'areas')").collect()) == [("areas", "area", 4, "n | k | 类型ID=101"), ("lanes", "line", 4, "n | k | 类型ID=101")]
    assert "binaryFile" not in rows._jdf.queryExecution().optimizedPlan().toString()
