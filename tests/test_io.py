import json
import random

import pytest
from pyspark.sql import functions as F, types as T

from gazelake import schemas
from gazelake.operators import rewards as R
from gazelake.plans import testviews as V
from gazelake.sources import catalog, json_records, readers, writers
from gazelake.streaming import live
from conftest import SF

HEAD = "img_usr_tgt,image,width,height,username,target_id,target_x,target_y,target_width,target_height,x,y,t"


def test_fixation_csv_keeps_file_order(spark, tmp_path):
    path = tmp_path / "text.csv"
    path.write_text("\n".join([HEAD] + [f"{k},im,800,600,u,txt_A,1,2,3,4,{x}.5,1,0.2" for k, x in (("a", 3), ("b", 9), ("a", 1), ("a", 2))]))
    rows = readers.read_fixations(spark, str(path)).orderBy("img_usr_tgt", "pos").collect()
    assert [(r["img_usr_tgt"], r["x"]) for r in rows] == [("a", 3.5), ("a", 1.5), ("a", 2.5), ("b", 9.5)]
    assert rows[0]["image"] == "vsgui10k-images/im.png"


def test_json_sources(spark, tmp_path):
    sample = {"id": "1", "image": ["a.png"], "conversations": [{"from": "human", "value": "q"}], "num_tokens": 7}
    (tmp_path / "a.json").write_text(json.dumps([sample, {**sample, "id": "2"}], indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({**sample, "id": str(i)}) for i in range(10)))
    (tmp_path / "map.json").write_text(json.dumps({"T0": "Sign in", "T1": "Cart"}))
    assert readers.read_annotations(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_annotations(spark, str(tmp_path / "b.jsonl")).count() == 10
    assert {(r["k"], r["v"]) for r in readers.read_lookup(spark, str(tmp_path / "map.json"), "k", "v").collect()} == {("T0", "Sign in"), ("T1", "Cart")}
    with pytest.raises(ValueError):
        readers.read_annotations(spark, str(tmp_path / "c.txt"))
    names = catalog.Catalog({"one": {"annotations": str(tmp_path / "a.json"), "data_path": "d1"},
                             "many": {"annotations": str(tmp_path / "b.jsonl"), "data_path": "d2"}})
    loaded = names.load(spark, "one,many%30", "id")
    assert {r["data_path"]: r["count"] for r in loaded.groupBy("data_path").count().collect()} == {"d1": 2, "d2": 3}
    with pytest.raises(ValueError):
        names.resolve("none")


def test_several_csv_files_count_as_one(spark, tmp_path):
    """Positions follow the names of the files and their lines, however the files are split."""
    lines = [f"{'ab'[k % 2]},im,800,600,u,txt_A,1,2,3,4,{k}.5,1,0.2" for k in range(400)]
    for name, part in (("b.csv", lines[150:]), ("a.csv", lines[:150])):
        (tmp_path / name).write_text("\n".join([HEAD, *part]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = readers.read_fixations(spark, str(tmp_path)).collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert {(r["img_usr_tgt"], r["pos"]): r["x"] for r in got} == {("ab"[k % 2], k // 2): k + 0.5 for k in range(400)}


def test_json_arrays_of_any_shape_and_split(spark, tmp_path):
    rng = random.Random(1)
    texts = ['plain', 'a "quoted" { brace', 'back\\slash\\', 'ünï }] {[', '\n\t', '', '}' * 50, '{"x": [1]}', 'long ' * 300]
    records = [{"id": k, "text": rng.choice(texts), "turns": [{"from": "a", "value": rng.choice(texts)} for _ in range(k % 4)]} for k in range(300)]
    nested = [records[:3], records[3:100], [], *records[100:200], [[records[200]], records[201:]]]
    for name, value in (("a.json", records), ("b.json", nested)):
        (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False, indent=1 if name == "a.json" else None))
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, records)))
    (tmp_path / "d.json").write_text("[]")
    schema = T.StructType.fromDDL("id int, text string, turns array<struct<`from`: string, value: string>>")
    want = [(r["id"], r["text"], [tuple(t.values()) for t in r["turns"]]) for r in records]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "6k", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = json_records.read_json_records(spark, str(tmp_path), schema, place=True).collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        for name in "abc":
            mine = sorted((r for r in rows if r["_file"].endswith(f"{name}.json")), key=lambda r: (r["_start"], r["_no"]))
            assert [(r["id"], r["text"], [tuple(t) for t in r["turns"]]) for r in mine] == want
        assert len(rows) == 3 * len(want)
    assert len({r["_start"] for r in rows}) > 64


@pytest.mark.parametrize("suffix", ["json", "jsonl"])
def test_sample_forms(spark, tmp_path, suffix):
    turn, named = {"from": "human", "value": "q"}, {"role": "user", "content": "c"}
    samples = [{"id": "0", "image": "a.png", "conversations": [turn]},
               {"id": "1", "images": ["b.png", "c.png"], "conversations": [named, turn]},
               {"id": "2", "image": ["[d].png"], "videos": "[e].mp4", "conversations": []},
               {"id": "3", "image": [], "images": ["f.png"], "conversations": [{**turn, "role": "user"}]},
               {"id": "4", "image": None, "conversations": None}]
    path = tmp_path / f"s.{suffix}"
    path.write_text(json.dumps(samples) if suffix == "json" else "\n".join(map(json.dumps, samples)))
    read = readers.read_annotations(spark, str(path))
    assert read.columns == schemas.SAMPLE.fieldNames()
    rows = {r["id"]: r for r in read.collect()}
    assert [rows[k]["image"] for k in "01234"] == [["a.png"], ["b.png", "c.png"], ["[d].png"], [], None]
    assert rows["2"]["video"] == ["[e].mp4"] and rows["0"]["video"] is None
    turns = {k: r["conversations"] and [tuple(m) for m in r["conversations"]] for k, r in rows.items()}
    assert turns == {"0": [("human", "q")], "1": [("user", "c"), ("human", "q")], "2": [], "3": [("human", "q")], "4": None}


def test_split_media_and_rasters(spark, tmp_path):
    rows = spark.sql("SELECT cast(null as binary) AS image, 'p' AS image_path, 'q' AS problem, 's' AS solution, array(1, 2) AS resolution, s AS split FROM VALUES ('train'), ('test') AS t(s)")
    rows.write.partitionBy("split").parquet(str(tmp_path / "rl"))
    assert readers.read_split(spark, str(tmp_path / "rl"), "train").count() == 1
    (tmp_path / "media" / "sub").mkdir(parents=True)
    (tmp_path / "media" / "a.png").write_bytes(b"x")
    (tmp_path / "media" / "sub" / "b.png").write_bytes(b"y")
    assert {r["path"] for r in readers.list_media(spark, str(tmp_path / "media")).collect()} == {"a.png", "sub/b.png"}
    pixels = spark.createDataFrame([("i", 0, 1, 8), ("i", 0, 0, 7)], "image string, y int, x int, category int")
    assert readers.raster_lines(pixels).collect()[0]["categories"] == [7, 8]


def test_writers(spark, tmp_path):
    df = spark.sql("SELECT 'i' AS image, 8D AS width, 6D AS height, 'u' AS username, array(1D, 2D) AS px, array(3D, 4D) AS py, array(0D, 0D) AS pt")
    writers.write_long_predictions(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["image", "width", "height", "username", "x", "y", "timestamp"]
    writers.write_records(df, str(tmp_path / "r.jsonl"))
    writers.write_records(df, str(tmp_path / "r.parquet"))
    assert spark.read.parquet(str(tmp_path / "r.parquet")).count() == 1 == spark.read.json(str(tmp_path / "r.jsonl")).count()
    with pytest.raises(ValueError):
        writers.write_records(df, str(tmp_path / "r.xls"))
    built = []

    def build():
        built.append(1)
        return df

    assert writers.stored(spark, str(tmp_path / "s"), build).count() == 1 == writers.stored(spark, str(tmp_path / "s"), build).count() and built == [1]
    writers.append_rewards(df.select("image"), str(tmp_path / "log"))
    writers.append_rewards(df.select("image"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    writers.write_clusters(df.select("image"), df.select("username"), str(tmp_path / "c"))
    assert [d.columns for d in writers.read_clusters(spark, str(tmp_path / "c"))] == [["image"], ["username"]]
    report = spark.sql("SELECT 'all' AS subset, 0.123456D AS a, 2L AS b")
    assert {(r["metric"], r["value"]) for r in writers.report_rows(report).collect()} == {("a", 0.1235), ("b", 2.0)}


@pytest.fixture()
def logged(spark, tmp_path):
    df = V.completions(spark, SF).select(*schemas.COMPLETION.fieldNames()).withColumn(
        "logged_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("gen_no") * 900))
    df.repartition(3).write.json(str(tmp_path / "in"))
    return df, str(tmp_path)


def test_streamed_rewards_equal_batch(spark, logged):
    df, folder = logged
    stream = live.scored(live.read_completions(spark, folder + "/in", 1)).select("prompt_id", "gen_no", "reward")
    live.append_log(stream, folder + "/out", folder + "/ck").awaitTermination()
    batch = R.rewards(df, ("accuracy_scanpath", "format")).select("prompt_id", "gen_no", "reward")
    assert spark.read.parquet(folder + "/out").exceptAll(batch).count() == 0
    assert spark.read.parquet(folder + "/out").count() == batch.count()


def test_streamed_window_means(spark, logged):
    df, folder = logged
    stream = live.windowed_means(live.scored(live.read_completions(spark, folder + "/in")))
    live.append_log(stream, folder + "/win", folder + "/ck2").awaitTermination()
    got = spark.read.parquet(folder + "/win").collect()
    # the last window is still open at the watermark
    assert sum(r["answers"] for r in got) == df.filter("gen_no < 3").count()


def test_averages_between_log_points(spark, tmp_path):
    """Equal to the batch whether files come one by one or together; replayed files and a batch tried again add nothing."""
    rows = [(f"run{k % 3}", k // 3, f"m{k % 2}", float(k % 7), 1_700_000_000 + k) for k in range(600)]
    df = spark.createDataFrame(rows, "run string, step long, metric string, value double, at long").withColumn("logged_at", F.timestamp_seconds("at"))
    for part in range(4):
        df.filter(f"at >= {1_700_000_000 + 150 * part} and at < {1_700_000_000 + 150 * part + 150}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    closed = df.groupBy("run", F.floor(F.col("step") / 20).alias("log_no"), "metric").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    last = df.groupBy("run", F.floor(F.col("step") / 20).alias("log_no")).agg(F.max("at").alias("last"))
    want = closed.join(last, ["run", "log_no"]).filter(f"last <= {rows[-1][4] - 30}").drop("last").collect()
    names = ("run", "log_no", "metric", "value", "n")
    for files in (1, 100):
        out, check = str(tmp_path / f"out{files}"), str(tmp_path / f"check{files}")
        for _ in range(2):
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
            with live.keyed_state(spark):
                live.append_once(live.averages(stream, 20, "30 seconds"), out, check).awaitTermination()
            got = spark.read.parquet(out).select(*names).collect()
            assert sorted(map(tuple, got)) == sorted(tuple(r[c] for c in names) for r in want)


def test_a_batch_tried_again_replaces_itself(spark, tmp_path):
    write = live.batch_writer(str(tmp_path))
    for rows in (5, 3):
        write(spark.range(rows), 0)
        write(spark.range(7), 1)
    assert spark.read.parquet(str(tmp_path)).count() == 10
