"""Scanpath tables derived from the driver tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from ..operators import prepare
from ..session import spread

TARGETS = {f"T{i}": t for i, t in enumerate(
    ["Sign in", "Search", "Cart", "Settings", "Help", "Share", "Next"])}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    """Texts spread over the tasks: the file is one row group, so its scan is one task."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def fixations(spark, sf_dir) -> DataFrame:
    """One fixation per event; 12 events of a user make a trial."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    numbered = prepare.position_in_group(
        events, "user_id", ["ts", "event_id"], bucket=F.date_trunc("hour", "ts"), name="rn")
    trial, e, u = F.floor(F.col("rn") / 12), F.col("event_id"), F.col("user_id")
    placed = numbered.select(
        e, u, trial.alias("trial"), (F.col("rn") % 12).cast("int").alias("pos"),
        (F.floor(u / 100) * 24 + (trial % 6) * 4 + u % 4).alias("image_no"))
    n = F.col("image_no")
    return placed.select(
        F.concat(F.lit("im"), n, F.lit("_u"), u, F.lit("_tr"), "trial").alias("img_usr_tgt"),
        F.concat(F.lit("im"), n).alias("image"), F.concat(F.lit("u"), u).alias("username"),
        F.concat(F.lit("txt_T"), n % 7).alias("target_id"),
        (800 + (n % 4) * 160).cast("double").alias("width"),
        (600 + (n % 3) * 120).cast("double").alias("height"),
        F.when(n % 3 == 0, "web").when(n % 3 == 1, "desktop").otherwise("mobile").alias("ui_type"),
        "trial", "pos",
        (((e * 7919) % 5) * 150 + (e * 31) % 120).cast("double").alias("x"),
        (((e * 104729) % 4) * 140 + (e * 17) % 100).cast("double").alias("y"),
        ((100 + ((e * 13) % 9) * 50).cast("double") / 1000).alias("t"))


def pred_fixations(fx: DataFrame) -> DataFrame:
    """Four answers per trial: the path moved a little and shortened."""
    g, p = F.col("gen_no"), F.col("pos")
    moved = fx.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("gen_no"))
    return moved.filter((p + g) % 5 != 4).select(
        "img_usr_tgt", "image", "username", "target_id", "width", "height", "ui_type", "trial", "gen_no", "pos",
        F.greatest(F.lit(0.0), F.col("x") + ((p * 37 + g * 11) % 81).cast("double") * (1 + g) - 40 * (1 + g)).alias("px"),
        F.greatest(F.lit(0.0), F.col("y") + ((p * 53 + g * 7) % 61).cast("double") * (1 + g) - 30 * (1 + g)).alias("py"))


def trials(spark, sf_dir) -> DataFrame:
    return prepare.build_trials(
        fixations(spark, sf_dir),
        attributes=["image", "username", "target_id", "width", "height", "ui_type", "trial"])


def pairs(spark, sf_dir) -> DataFrame:
    """One row per trial and answer: human arrays x, y, t and predicted px, py.

    The answer is made from the trial's arrays, so no second grouping is needed.
    """
    human = trials(spark, sf_dir)
    with_gen = human.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("gen_no"))
    g = F.col("gen_no")
    steps = F.transform(F.arrays_zip("x", "y"), lambda s, i: F.struct(i.alias("pos"), s["x"].alias("x"), s["y"].alias("y")))
    kept = F.filter(steps, lambda s: (s["pos"] + g) % 5 != 4)

    def moved(s, axis, a, b, c, d):
        return F.greatest(F.lit(0.0), s[axis] + ((s["pos"] * a + g * b) % c).cast("double") * (1 + g) - d * (1 + g))

    return with_gen.withColumn("_kept", kept).withColumns({
        "px": F.transform("_kept", lambda s: moved(s, "x", 37, 11, 81, 40)),
        "py": F.transform("_kept", lambda s: moved(s, "y", 53, 7, 61, 30))}).drop("_kept")


def canvas_pairs(spark, sf_dir, pad=True) -> DataFrame:
    """Pairs on the scoring canvas, durations in ms, predicted durations 0."""
    df = pairs(spark, sf_dir).withColumns({
        "x": G.rescale("x", "width", G.CANVAS_WIDTH), "y": G.rescale("y", "height", G.CANVAS_HEIGHT),
        "px": G.rescale("px", "width", G.CANVAS_WIDTH), "py": G.rescale("py", "height", G.CANVAS_HEIGHT),
        "t": G.to_millis("t")}).withColumn("pt", F.transform("px", lambda _: F.lit(0.0)))
    return df.withColumns({c: G.padded(c) for c in ("x", "y", "t", "px", "py", "pt")}) if pad else df


def user_no(username="username"):
    return F.substring(username, 2, 10).cast("bigint")


def completions(spark, sf_dir) -> DataFrame:
    """Logged answers with the human path as solution."""
    df = pairs(spark, sf_dir)

    def listed(xs, ys):
        pts = F.arrays_zip(F.col(xs).alias("x"), F.col(ys).alias("y"))
        return F.array_join(F.transform(pts, lambda p: F.concat(
            F.lit("["), F.floor(p["x"]).cast("string"), F.lit(", "), F.floor(p["y"]).cast("string"), F.lit("]"))), " ")

    said = F.concat(F.lit("The scanpath is "), listed("px", "py"))
    u = user_no()
    content = (F.when(u % 13 == 12, F.lit("No Objects")).when(u % 11 == 10, said)
               .otherwise(F.concat(F.lit("<think>look</think> <answer>"), said, F.lit("</answer>"))))
    return df.select(F.col("img_usr_tgt").alias("prompt_id"), "gen_no", content.alias("content"),
                     F.concat(F.lit("The scanpath is "), listed("x", "y")).alias("solution"),
                     "width", "height", "ui_type", "image", "target_id", "username", "trial")


def target2text(spark) -> DataFrame:
    return spark.createDataFrame(list(TARGETS.items()), "target_key string, target string")


def _paired(batches):
    """Rows (image_id, t) to (image_id, hyp, refs); the words are those of ``W.words``."""
    for batch in batches:
        ids = batch.column("image_id")
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            hyps, refs = [], []
            for key, text in zip(part.column("image_id").to_pylist(), part.column("t").to_pylist()):
                words = None if text is None else text.split()
                refs.append([None, None] if words is None else [" ".join(words), " ".join(words[2:])])
                if words is not None:
                    del words[4::5]
                hyps.append("" if key is not None and key % 97 == 96 else None if words is None else " ".join(words))
            yield pa.RecordBatch.from_arrays([ids.slice(start, 256), pa.array(hyps, pa.string()), pa.array(refs, pa.list_(pa.string()))], ["image_id", "hyp", "refs"])


def captions(spark, sf_dir) -> DataFrame:
    """References: the lower-cased words, and those from the third on.

    The hypothesis leaves out every fifth word; some are empty.
    """
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("image_id"), F.lower("text").alias("t"))
    kind = docs.schema["image_id"].dataType.simpleString()
    return docs.mapInArrow(_paired, f"image_id {kind}, hyp string, refs array<string>")


def token_logps(spark, sf_dir) -> DataFrame:
    """One completion per order: log-probs, reference log-probs, token flags."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag")
    rows = F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (-F.col("l_discount") - 0.01).alias("lp"), (-F.col("l_tax") - 0.01).alias("rp"), "l_returnflag")))
    grouped = items.groupBy("l_orderkey").agg(rows.alias("r"))
    return grouped.select(
        F.floor(F.col("l_orderkey") / 4).alias("prompt_id"), (F.col("l_orderkey") % 4).alias("gen_no"),
        F.col("r.lp").alias("logps"), F.col("r.rp").alias("ref_logps"), F.col("r.l_returnflag").alias("token_ids"))


def samples(spark, sf_dir) -> DataFrame:
    """Training samples from the conversations; some name an image."""
    turns = table(spark, sf_dir, "conversations")
    speaker = F.when(F.col("role") == "user", "human").when(F.col("role") == "system", "system").otherwise("gpt")
    rows = F.array_sort(F.collect_list(F.struct("turn", speaker.alias("from"), F.col("text").alias("value"))))
    grouped = turns.groupBy("conv_id").agg(rows.alias("r"))
    has_image = F.col("conv_id") % 3 != 0
    image = F.array(F.concat(F.lit("img"), "conv_id", F.lit(".png")))
    conversations = F.transform("r", lambda s, i: F.struct(
        s["from"].alias("from"),
        F.when((i == 0) & has_image & (F.col("conv_id") % 7 != 6), F.concat(s["value"], F.lit("\n<image>")))
        .otherwise(s["value"]).alias("value")))
    return grouped.select(
        "conv_id", F.when(has_image, image).otherwise(F.slice(image, F.lit(1), F.lit(0))).alias("image"),
        F.slice(image, F.lit(1), F.lit(0)).alias("video"), conversations.alias("conversations"))


def media_listing(spark, sf_dir) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.filter(F.col("conv_id") % 5 != 0).select(F.concat(F.lit("img"), "conv_id", F.lit(".png")).alias("path"))


def segmentation_rows(fx: DataFrame) -> DataFrame:
    """Category raster of every image, one row per raster line (320 x 512)."""
    images = fx.select("image").distinct().withColumn("image_no", F.substring("image", 3, 10).cast("int"))
    lines = images.select("image", "image_no", F.explode(F.sequence(F.lit(0), F.lit(319))).alias("y"))
    tiles = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda tile: F.array_repeat(
        ((tile + F.floor(F.col("y") / 64) + F.col("image_no")) % 5).cast("int"), 64))
    return lines.select("image", "y", F.flatten(tiles).alias("categories"))
