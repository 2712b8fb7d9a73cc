"""Media checks of training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MARKERS = {"image": "<image>", "video": "<video>"}


def marker_counts(samples: DataFrame) -> DataFrame:
    """Add expected and actual media counts and whether an answer has a marker."""
    def in_questions(marker):
        human = F.filter("conversations", lambda m: m["from"] == "human")
        return F.aggregate(human, F.lit(0), lambda acc, m: acc + F.size(
            F.split(F.coalesce(m["value"], F.lit("")), marker, -1)) - 1)

    out = samples
    for kind, marker in MARKERS.items():
        actual = in_questions(marker)
        out = out.withColumns({f"expected_{kind}": F.size(F.coalesce(F.col(kind), F.array().cast("array<string>"))),
                               f"actual_{kind}": actual})
    marked = F.exists("conversations", lambda m: (m["from"] == "gpt") & (
        F.contains(m["value"], F.lit("<image>")) | F.contains(m["value"], F.lit("<video>"))))
    return out.withColumn("marker_in_answer", F.coalesce(marked, F.lit(False)))


def missing_media(samples: DataFrame, listing: DataFrame, key) -> DataFrame:
    """``key + (path)`` of media that are not listed; ``listing`` is ``(path)``."""
    used = samples.select(key, F.explode(F.concat(*[
        F.coalesce(F.col(k), F.array().cast("array<string>")) for k in MARKERS])).alias("path"))
    return used.join(listing.select("path"), "path", "left_anti").select(key, "path")


def check(samples: DataFrame, listing: DataFrame, key) -> DataFrame:
    """Add ``missing_files`` and ``problems`` (empty for a valid sample).

    Of the two marker counts only the first mismatch is reported.
    """
    # as many entries as the sample names media
    missing = missing_media(samples, listing, key).groupBy(key).agg(
        F.array_sort(F.collect_list("path")).alias("missing_files"))
    counted = marker_counts(samples).join(missing, key, "left").withColumn(
        "missing_files", F.coalesce("missing_files", F.array().cast("array<string>")))

    def mismatch(kind):
        message = F.format_string(f"Expected %d <{kind}> tokens, found %d", f"expected_{kind}", f"actual_{kind}")
        return F.when(F.col(f"expected_{kind}") != F.col(f"actual_{kind}"), F.struct(
            F.lit("token_mismatch").alias("type"), message.alias("message")))

    files = F.when(F.size("missing_files") > 0, F.struct(
        F.lit("missing_files").alias("type"),
        F.concat(F.lit("Missing media files: "), F.array_join("missing_files", ", ")).alias("message")))
    in_answer = F.when(F.col("marker_in_answer"), F.struct(
        F.lit("gpt_media_token").alias("type"),
        F.lit("GPT response contains media token (<image> or <video>)").alias("message")))
    return counted.withColumn("problems", F.array_compact(F.array(
        files, F.coalesce(mismatch("image"), mismatch("video")), in_answer)))


def validate_media(samples: DataFrame, listing: DataFrame, key) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split into valid and problem samples, with a one-row summary."""
    checked = check(samples, listing, key)
    valid = checked.filter(F.size("problems") == 0).select(samples.columns)
    bad = checked.filter(F.size("problems") > 0).select(*samples.columns, F.col("problems").alias("validation_problems"))
    return valid, bad, statistics(checked)


def statistics(checked: DataFrame) -> DataFrame:
    def has(kind):
        return F.exists("problems", lambda p: p["type"] == kind)

    image, video = F.col("expected_image") > 0, F.col("expected_video") > 0
    return checked.agg(
        F.count("*").alias("total_entries"),
        F.count_if(F.size("problems") == 0).alias("valid_entries"),
        F.count_if(has("missing_files")).alias("missing_media"),
        F.count_if(has("token_mismatch")).alias("token_mismatches"),
        F.count_if(has("gpt_media_token")).alias("gpt_media_tokens"),
        F.count_if(image & ~video).alias("image_only"),
        F.count_if(video & ~image).alias("video_only"),
        F.count_if(image & video).alias("mixed"))


def first_missing(samples: DataFrame, listing: DataFrame, key, n=5) -> DataFrame:
    """A sample of missing files for the report, in key order."""
    return missing_media(samples, listing, key).orderBy(key, "path").limit(n)
