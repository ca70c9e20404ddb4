import json

import pytest
from pyspark.sql import types as T

from tesserae.operators import fusion
from tesserae.sources import captures, sinks


def write(path, text="x"):  # Spark leaves files of no bytes out of its listings
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_manifests_rooms_and_videos(spark, tmp_path):
    write(tmp_path / "a/capture.json", json.dumps({"capture_id": " a ", "tier": "photo", "device": {"model": "m"}, "declared_rooms": ["kitchen", "attic"]}))
    for n in ("2.jpg", "1.JPG", "notes.txt"):
        write(tmp_path / "a/rooms/kitchen" / n)
    for i in range(9):
        write(tmp_path / "a/rooms/hall" / f"{i}.png")
    write(tmp_path / "a/other/x.jpg")  # beside rooms/: not a room
    write(tmp_path / "b/capture.json", json.dumps({"capture_id": "b", "tier": "photo"}))
    write(tmp_path / "b/loose.jpeg")
    write(tmp_path / "c/capture.json", json.dumps({"capture_id": "c", "tier": "video", "video_path": "z.mp4"}))
    write(tmp_path / "c/a.mov")
    write(tmp_path / "c/z.mp4")
    rows = captures.manifests(spark, str(tmp_path)).cache()
    assert {r["capture_id"]: (r["tier"], r["device_model"]) for r in rows.collect()} == {"a": ("photo", "m"), "b": ("photo", "unknown"), "c": ("video", "unknown")}
    photos = captures.room_photos(spark, rows, str(tmp_path)).cache()
    found = {}
    for r in photos.orderBy("folder", "room", "place").collect():
        found.setdefault((r["folder"][-1], r["room"]), []).append(r["path"].rpartition("/")[2])
    assert found[("a", "kitchen")] == ["1.JPG", "2.jpg"] and found[("b", "room_1")] == ["loose.jpeg"] and set(found) == {("a", "kitchen"), ("a", "hall"), ("b", "room_1")}
    warned = {(r["room"], r["warning"]) for r in captures.photo_warnings(rows, photos).collect()}
    assert ("attic", "declared but not found") in warned and ("hall", "found but not declared") in warned and ("hall", "9 photos, expected 2 to 8") in warned
    assert [r["path"].rpartition("/")[2] for r in captures.videos(spark, rows, str(tmp_path)).collect()] == ["z.mp4"]


@pytest.mark.parametrize("text,said", [('{"capture_id": "x", "tier": "photo", "odd": 1}', "odd"), ('{"capture_id": "x", "tier": "photo", "device": {"cpu": 1}}', "device.cpu"), ("{broken", "invalid JSON"), ('{"capture_id": " ", "tier": "photo"}', "capture_id"), ('{"capture_id": "x", "tier": "sonar"}', "tier")])
def test_bad_manifests_are_errors(spark, tmp_path, text, said):
    write(tmp_path / "capture.json", text)
    with pytest.raises(Exception, match=said):
        captures.manifests(spark, str(tmp_path)).collect()


def test_scanner_folder(spark, tmp_path):
    write(tmp_path / "odometry.csv", "timestamp, frame, x, y, z, qx, qy, qz, qw\n0.0, 0, 1, 2, 3, 0, 0, 0, 1\n0.1, 1, 1, 2, 4, 0, 0, 0, 1\n")
    write(tmp_path / "camera_matrix.csv", "1000, 0, 960\n0, 1010, 720\n0, 0, 1\n")
    for i in range(2):
        write(tmp_path / f"depth/{i}.png")
    write(tmp_path / "confidence/0.png")
    assert [tuple(r) for r in captures.poses(spark, str(tmp_path)).select("frame", "z", "qw").collect()] == [(0, 3.0, 1.0), (1, 4.0, 1.0)]
    assert tuple(captures.intrinsics(spark, str(tmp_path), 192, 1920).first().asDict()[k] for k in ("fx", "fy", "cx", "cy")) == (100.0, 101.0, 96.0, 72.0)
    with pytest.raises(Exception, match="differ"):
        captures.frame_files(spark, str(tmp_path)).collect()
    write(tmp_path / "confidence/1.png")
    assert captures.frame_files(spark, str(tmp_path)).count() == 2


def test_ground_truth(spark, tmp_path):
    write(tmp_path / "gt.csv", "room,element,element_id,dimension,value_m,notes\n kitchen ,WALL,w1, Length ,3.2,n\n,wall,,x,1,\nhall,room,r,area,7,\n")
    rows = captures.ground_truth(spark, str(tmp_path / "gt.csv")).orderBy("line").collect()
    assert [(r["room"], r["element"], r["element_id"], r["dimension"], r["value_m"]) for r in rows] == [("kitchen", "wall", "w1", "length", 3.2), ("hall", "room", "r", "area", 7.0)]
    write(tmp_path / "bad.csv", "room,element,element_id,dimension,value_m\na,wall,w,length,abc\n")
    with pytest.raises(Exception, match="not a number"):
        captures.ground_truth(spark, str(tmp_path / "bad.csv")).collect()
    write(tmp_path / "less.csv", "room,element\na,b\n")
    with pytest.raises(ValueError, match="lacks"):
        captures.ground_truth(spark, str(tmp_path / "less.csv"))


def test_catalogue_calibration_and_rules(spark, tmp_path):
    write(tmp_path / "c.csv", "damage_class,surface_kind,code,unit,basis,cut_back_m,waste_factor\nstain,wall,P1,m2, Area ,,0.1\n")
    assert tuple(captures.catalogue(spark, str(tmp_path / "c.csv")).first()) == ("stain", "wall", "P1", "m2", "area", 0.0, 0.1, 0.0)
    write(tmp_path / "cal.json", json.dumps({"factors": {"lidar": {"wall": {"scale": 2.0, "n_samples": 4, "achieved_coverage": 0.9, "trusted": True}}}}))
    assert [tuple(r) for r in captures.calibration_factors(spark, str(tmp_path / "cal.json")).collect()] == [("lidar", "wall", 2.0, 4, 0.9, True)]
    assert captures.calibration_factors(spark, str(tmp_path / "none.json")).count() == 0
    write(tmp_path / "broken.json", "{")
    assert captures.calibration_factors(spark, str(tmp_path / "broken.json")).count() == 0
    write(tmp_path / "r.json", json.dumps({"rules": [{"id": "x", "text": "t", "when": {"field": "a", "op": "eq", "value": 1}}]}))
    assert captures.rules(str(tmp_path / "r.json"), ["a"])[0]["id"] == "x"


def test_plan_round_trip_and_reports(spark, tmp_path):
    rooms = spark.createDataFrame([("p1", "r2", 2.0), ("p1", "r1", 1.0)], "plan string, room string, area double")
    plan = sinks.nested(spark.createDataFrame([("p1", "lidar"), ("p2", "photo")], "plan string, tier string"), rooms, ["plan"], "rooms", ["room"])
    sinks.write_json(plan, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    by = {x["plan"]: x for x in lines}
    assert [r["room"] for r in by["p1"]["rooms"]] == ["r1", "r2"] and by["p2"]["rooms"] == []
    write(tmp_path / "plans/p1/plan.json", json.dumps(by["p1"]))
    schema = T.StructType([T.StructField("plan", T.StringType()), T.StructField("tier", T.StringType()), T.StructField("rooms", plan.schema["rooms"].dataType)])
    back = captures.plans(spark, str(tmp_path / "plans"), schema).collect()
    assert back[0]["plan"] == "p1" and back[0]["folder"].endswith("p1") and len(back[0]["rooms"]) == 2
    record = sinks.run_record(rooms, rooms["room"], {"b": 1, "a": 2}).first()
    assert record["inputs"] == 2 and record["settings"] == {"a": "2", "b": "1"}
    assert record["digest"] == sinks.run_record(rooms.orderBy("room"), rooms["room"], {}).first()["digest"]
    assert sinks.text_table(rooms.orderBy("room"), ["room", "area"]).splitlines()[2] == "r1    1.0"


def test_fusion_of_a_plane(spark):
    pixels = spark.createDataFrame([("c", 0, u, v, 2.0, 2) for u in range(0, 100, 10) for v in range(0, 100, 10)] + [("c", 0, 5, 5, 5.0, 2), ("c", 0, 5, 5, 0.2, 2), ("c", 0, 5, 5, 1.0, 1), ("c", 9, 5, 5, 1.0, 2)], "k string, frame int, u int, v int, depth double, confidence int")
    poses = spark.createDataFrame([("c", 0, 1.0, 2.0, 3.0, 2.0, 0.0, 0.0, 0.0)], "k string, frame int, x double, y double, z double, qw double, qx double, qy double, qz double")
    camera = spark.createDataFrame([("c", 100.0, 100.0, 50.0, 50.0)], "k string, fx double, fy double, cx double, cy double")
    points = fusion.world_points(pixels, poses, camera, ["k"]).cache()
    assert points.count() == 100 and {round(r["z"], 9) for r in points.collect()} == {5.0}
    assert sum(r["n"] for r in fusion.fused(points, ["k"], 0.5).collect()) == 100
    assert fusion.cloud_statistics(points, ["k"]).first()["n"] == 100
    frames = spark.createDataFrame([("c", i) for i in range(100)], "k string, i int")
    assert fusion.strided(frames, ["k"], "i", 10).count() == 25
