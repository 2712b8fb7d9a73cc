"""Structured Streaming over a folder of logged answers and metrics."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import schemas
from ..operators import rewards

LOGGED = T.StructType(schemas.COMPLETION.fields + [T.StructField("logged_at", T.TimestampType())])


def read_completions(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOGGED)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def scored(stream: DataFrame, names=("accuracy_scanpath", "format")) -> DataFrame:
    """The batch reward columns on a stream; stateless."""
    return rewards.rewards(stream, names)


def windowed_means(stream: DataFrame, width="10 minutes", delay="5 minutes", names=("accuracy_scanpath", "format")) -> DataFrame:
    """Mean rewards and, where the stream has ``length``, mean answer length per time window.

    Rows later than ``delay`` are dropped.
    """
    means = {"reward": "reward", **{f"rewards_{n}": n for n in names}}
    if "length" in stream.columns:
        means["completion_length"] = "length"
    return (stream.withWatermark("logged_at", delay).groupBy(F.window("logged_at", width))
            .agg(F.count("*").alias("answers"), *[F.avg(c).alias(name) for name, c in means.items()])
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "answers", *means))


# log points of a run that one state holds at most, and groups that runs are dealt to by their hash
BLOCK, GROUPS = 256, 512
_OPEN = ("runs array<string>, log_nos array<long>, ends array<long>, metrics array<array<string>>, totals array<array<double>>, "
         "counts array<array<long>>")


class _Averages(StatefulProcessor):
    """Sums of each metric for the open log points of a block, of a group of runs; a log point that is written is forgotten.

    The open log points of a group are one value, read and written once a batch, with one timer for the earliest end:
    what a key costs is paid once for many runs. Rows without a ``run`` are of the run in the key.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def _held(self) -> dict:
        held = self.open.get()
        return {(run, no): (end, {m: (t, n) for m, t, n in zip(*sums)}) for run, no, end, *sums in zip(*held)} if held else {}

    def _keep(self, held: dict, before: int | None) -> None:
        """Write what is open, with a timer if the earliest end is not ``before``."""
        if not held:
            self.open.clear()
            return
        first = min(end for end, _ in held.values())
        if first != before:
            # a timer that was set for another end finds nothing due
            self.handle.registerTimer(first)
        sums = [s for _, s in held.values()]
        self.open.update(([run for run, _ in held], [int(no) for _, no in held], [end for end, _ in held.values()], [list(s) for s in sums],
                          [[t for t, _ in s.values()] for s in sums], [[n for _, n in s.values()] for s in sums]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        before = min((end for end, _ in held.values()), default=None)
        for batch in rows:
            runs = batch["run"].tolist() if "run" in batch else [key[0]] * len(batch)
            for run, log_no, metric, at, value in zip(runs, batch["log_no"].tolist(), batch["metric"].tolist(), batch["at"].tolist(), batch["value"].tolist()):
                if log_no is None or log_no != log_no or metric is None or metric != metric:
                    continue
                # a null comes as None or NaN
                at, run = None if at is None or at != at else int(at), None if run != run else run
                end, sums = held.get((run, log_no), (None, {}))
                total, n = sums.get(metric, (0.0, 0))
                sums[metric] = (total, n) if value is None or value != value else (total + value, n + 1)
                held[run, log_no] = (end if at is None else at if end is None else max(end, at), sums)
        self._keep(held, before)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), self._held()
        due = sorted((no, run is not None, run) for (run, no), (end, _) in held.items() if end <= now)
        rows = [(run, no, m, t / n if n else None, n) for no, _, run in due for m, (t, n) in held[run, no][1].items()]
        if due:
            self._keep({at: v for at, v in held.items() if v[0] > now}, None)
        yield pd.DataFrame(rows, columns=["run", "log_no", "metric", "value", "n"])


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """The state store that state of own keys needs, for the queries started inside."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def averages(stream: DataFrame, every: int, delay="5 minutes", groups: int = GROUPS) -> DataFrame:
    """Averages of logged metrics between the log points of each run: ``(run, log_no, metric, value, n)``.

    ``stream`` has ``run, step, metric, value, logged_at``; a log point comes every ``every`` steps, and what it has averaged is
    forgotten. It is written once no row of its steps can come any more, that is when the watermark has passed the
    last of them; later rows are dropped. A state holds open log points, at most ``BLOCK`` next to each other of a run, of
    the runs of one of ``groups`` groups. Start it inside ``keyed_state``.
    """
    kind = stream.schema["run"].dataType
    # names of runs: numbers next to a null would become others in pandas
    name = F.hex("run") if isinstance(kind, T.BinaryType) else F.col("run").cast("string")
    rows = stream.withWatermark("logged_at", delay).select(
        F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group"), name.alias("run"), F.floor(F.col("step") / F.lit(every)).alias("log_no"), "metric", "value", "logged_at",
        F.unix_millis("logged_at").alias("at"))
    # no part of a key is null
    keyed = rows.withColumn("block", F.coalesce(F.floor(F.col("log_no") / F.lit(BLOCK)), F.lit(-1).cast("bigint")))
    found = keyed.groupBy("group", "block").transformWithStateInPandas(
        _Averages(), "run string, log_no long, metric string, value double, n long", "append", "EventTime")
    return found.withColumn("run", F.unhex("run") if isinstance(kind, T.BinaryType) else F.col("run").cast(kind))


def batch_writer(path: str):
    """Writes each batch into a folder of its own: one that is tried again replaces what it has left behind."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that has arrived and stop; no row is there twice, and files that were read are not read again."""
    return (stream.writeStream.outputMode("append").foreachBatch(batch_writer(path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that has arrived to the reward log and stop."""
    return (stream.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))
