"""Queries that go through files and streams: what is written comes back the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .. import schemas
from ..operators import sequences
from ..session import scratch_path
from ..sources import json_records, readers
from ..streaming import live
from . import sqlviews as S, testviews as V
from .registry import query, r6, sql_r6

_TURN = "conv_id bigint, turn bigint, role string, text string, shape string"


@query("json_arrays", """
SELECT shape, conv_id, turn, role, length(text) AS n_chars, md5(text) AS digest
FROM conversations CROSS JOIN (SELECT unnest(['flat', 'nested']) AS shape) s""")
def json_arrays(spark, sf):
    """Turns written as arrays of records and as arrays of arrays, a list for each conversation."""
    turns = V.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    record = F.struct(*[F.col(c) for c in turns.columns], F.lit("flat").alias("shape"))
    flat = turns.select(F.to_json(record).alias("value"))
    record = F.struct(*[F.col(c) for c in turns.columns], F.lit("nested").alias("shape"))
    nested = turns.groupBy("conv_id").agg(F.to_json(F.collect_list(record)).alias("value")).select("value")
    path = scratch_path(spark)
    flat.unionByName(nested).write.text(path, lineSep=",\n")
    rows = json_records.read_json_records(spark, path, T.StructType.fromDDL(_TURN))
    return rows.select("shape", "conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("csv_positions", S.with_(S.FIXATIONS, f"""
SELECT img_usr_tgt, pos::int AS pos, {sql_r6('x')} AS x, {sql_r6('y')} AS y, {sql_r6('t')} AS t FROM fixations"""))
def csv_positions(spark, sf):
    """Fixations written to several files without their position, which the order of names and lines gives back."""
    rows = V.fixations(spark, sf)
    known = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.FIXATION.fields]
    path = scratch_path(spark)
    # files follow each other in the order of trial and position
    rows.repartitionByRange("img_usr_tgt", "pos").sortWithinPartitions("img_usr_tgt", "pos").select(known).write.csv(path, header=True)
    return readers.read_fixations(spark, path).select("img_usr_tgt", "pos", *[r6(c).alias(c) for c in ("x", "y", "t")])


_KEYED = S.FIXATIONS + S.TRIALS + """, keyed AS (
  SELECT *, ['AiR-D', 'OSIE', 'COCO-TP', 'COCO-TA', 'VISGUI'][image_no % 5 + 1] AS dataset,
         CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'train' END AS split, concat(image, '.jpg') AS file FROM trials)"""


@query("dataset_keys", S.with_(_KEYED, """
SELECT img_usr_tgt, dataset, CASE dataset WHEN 'AiR-D' THEN concat_ws('-', split, trial, image) WHEN 'OSIE' THEN concat_ws('-', split, image)
  WHEN 'VISGUI' THEN concat_ws('-', file, target_id) ELSE concat_ws('-', split, ui_type, target_id, image) END AS key FROM keyed"""))
def dataset_keys(spark, sf):
    """One table of trials of five datasets, each with the key its clusters go by."""
    rows = V.trials(spark, sf).withColumns({
        "dataset": F.element_at(F.array(*[F.lit(d) for d in sequences.KEY_PARTS]), (F.regexp_extract("image", "[0-9]+", 0).cast("int") % 5 + 1)),
        "split": F.when(F.regexp_extract("username", "[0-9]+", 0).cast("int") % 2 == 0, "test").otherwise("train"),
        "file": F.concat("image", F.lit(".jpg"))})
    names = {"question_id": "trial", "image_id": "file", "name": "file", "image_name": "file", "condition": "ui_type", "task": "target_id"}
    return rows.select("img_usr_tgt", "dataset", sequences.dataset_key(columns=names).alias("key"))


# --- streams -----------------------------------------------------------------

#: Times of the table count as UTC, whatever the session's zone.
_UTC = "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"


def _events(spark, sf) -> DataFrame:
    """The events as they arrive, in files."""
    table = V.table(spark, sf, "events")
    folder, name = table.inputFiles()[0].rsplit("/", 1)
    reader = spark.readStream.schema(table.schema)
    # a table may be a folder of files or a single one
    reader = reader if folder.endswith("/events.parquet") else reader.option("pathGlobFilter", name)
    return reader.parquet(folder).withColumn("logged_at", F.expr(_UTC))


def _streamed(stream: DataFrame, start=live.append_once) -> DataFrame:
    """What a stream has written once all files are read."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession)
    with live.keyed_state(spark):
        start(stream, path, scratch_path(spark)).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(stream.columns)


_CONTENT = """CASE event_type WHEN 'view' THEN concat('<think>', props, '</think><answer>', event_id, '</answer>')
  WHEN 'click' THEN concat('<think>', props, '</think>', event_id) ELSE props END"""


@query("stream_rewards", f"""
SELECT event_id, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END::double AS format, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END::double AS reward
FROM events""")
def stream_rewards(spark, sf):
    """Answers scored as they arrive; a stateless stream."""
    answers = _events(spark, sf).select("event_id", F.expr(_CONTENT).alias("content"), F.lit("").alias("solution"),
                                        F.lit(512.0).alias("width"), F.lit(384.0).alias("height"))
    return _streamed(live.scored(answers, ("format",)).select("event_id", "format", "reward"))


@query("stream_window_means", f"""
SELECT start, count(*) AS answers, {sql_r6('avg(value)')} AS reward, {sql_r6('avg(length(props))')} AS completion_length
FROM (SELECT *, date_trunc('day', ts) AS start FROM events) e
WHERE start + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) GROUP BY start""")
def stream_window_means(spark, sf):
    """Mean rewards and lengths of each day that the watermark has passed."""
    answers = _events(spark, sf).select("logged_at", F.col("value").alias("reward"), F.length("props").alias("length"))
    means = live.windowed_means(answers, "1 day", "0 seconds", ())
    start = F.expr("timestampadd(MICROSECOND, unix_micros(start), timestamp_ntz'1970-01-01 00:00:00')")
    return _streamed(means).select(start.alias("start"), "answers", r6("reward").alias("reward"), r6("completion_length").alias("completion_length"))


@query("stream_averages", f"""
SELECT user_id AS run, event_id // 1000 AS log_no, event_type AS metric, {sql_r6('avg(value)')} AS value, count(*) AS n FROM events GROUP BY ALL""")
def stream_averages(spark, sf):
    """Averages of each run between its log points, from keyed state."""
    logged = _events(spark, sf).select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("metric"),
                                       "value", "logged_at")
    return _streamed(live.averages(logged, 1000, "0 seconds")).select("run", "log_no", "metric", r6("value").alias("value"), "n")
