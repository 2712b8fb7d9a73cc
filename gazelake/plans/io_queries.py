"""Queries through sinks, readers and column functions: written, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from .. import schemas
from ..functions import geometry as G, prompts as P
from ..operators import packing, scanpath, sequences
from ..session import scratch_path
from ..sources import catalog, readers, writers
from . import sqlviews as S, testviews as V
from .path_queries import _CENTERS, _HUMAN_SYMBOLS, KEYS, tile_centers
from .registry import ints, query, r6, sql_r6
from .training_queries import _WORDS

ID = ["img_usr_tgt", "gen_no"]


@query("record_files", S.with_(S.FIXATIONS + S.TRIALS, """
SELECT form, img_usr_tgt, image, array_to_string(list_transform(x, lambda v: v::bigint), ',') AS xs, array_to_string(list_transform(y, lambda v: v::bigint), ',') AS ys
FROM trials CROSS JOIN (SELECT unnest(['jsonl', 'parquet']) AS form) f"""))
def record_files(spark, sf):
    """Trials written as JSON lines and as Parquet, each read under the declared schema."""
    trials, path, read = V.trials(spark, sf), scratch_path(spark), []
    fields = [f for f in schemas.SCANPATH.fields if f.name in trials.columns]
    for form in ("jsonl", "parquet"):
        writers.write_records(trials.select([F.col(f.name).cast(f.dataType) for f in fields]), f"{path}/trials.{form}")
        back = readers.read_annotations(spark, f"{path}/trials.{form}", T.StructType(fields))
        read.append(back.withColumn("form", F.lit(form)))
    long = lambda c: ints(F.transform(c, lambda v: v.cast("bigint")))
    return read[0].unionByName(read[1]).select("form", "img_usr_tgt", "image", long("x").alias("xs"), long("y").alias("ys"))


@query("prediction_files", S.with_(S.PREDICTED, f"""
SELECT image, username, {sql_r6('px')} AS x, {sql_r6('py')} AS y, 0.0::double AS timestamp FROM pred_fixations"""))
def prediction_files(spark, sf):
    """Predicted fixations in long form through CSV files."""
    pairs, path = V.pairs(spark, sf), scratch_path(spark)
    writers.write_long_predictions(pairs.withColumn("pt", F.transform("px", lambda _: F.lit(0.0))), path)
    rows = spark.read.schema("image string, width double, height double, username string, x double, y double, timestamp double").csv(path, header=True)
    return rows.select("image", "username", r6("x").alias("x"), r6("y").alias("y"), "timestamp")


@query("cluster_files", S.with_(S.FIXATIONS + S.TRIALS + _CENTERS + _HUMAN_SYMBOLS, """
SELECT image, target_id, username, array_to_string(arg_max(symbols, trial), ',') AS symbols, any_value(clusters) AS clusters FROM human GROUP BY ALL"""))
def cluster_files(spark, sf):
    """Centres and strings as a stored artefact, built once and read twice."""
    path, built = scratch_path(spark), []

    def build():
        built.append(1)
        return tile_centers(spark, sf)

    centers = [writers.stored(spark, f"{path}/built", build) for _ in range(2)][-1]
    trials = V.trials(spark, sf).withColumns({"X": G.rescale("x", "width", G.CANVAS_WIDTH), "Y": G.rescale("y", "height", G.CANVAS_HEIGHT)})
    strings = sequences.subject_strings(sequences.symbolize(trials, centers, KEYS, "X", "Y"), "trial", KEYS)
    writers.write_clusters(centers, strings, f"{path}/artefact")
    centers, strings = writers.read_clusters(spark, f"{path}/artefact")
    sizes = centers.groupBy(*KEYS).agg((F.count("*") * len(built)).alias("clusters"))
    return strings.join(sizes, KEYS).select(*KEYS, "username", ints("symbols").alias("symbols"), "clusters")


@query("reward_log", "SELECT event_id, value AS reward FROM events")
def reward_log(spark, sf):
    """Rewards appended in two parts."""
    events, path = V.table(spark, sf, "events").select("event_id", F.col("value").alias("reward")), scratch_path(spark)
    for part in (0, 1):
        writers.append_rewards(events.filter(F.col("event_id") % 2 == part), path)
    return spark.read.parquet(path).filter("logged_at is not null").select("event_id", "reward")


@query("split_records", S.with_(S.PAIRS, """
SELECT img_usr_tgt AS image_path, gen_no::varchar AS problem, username AS solution, concat(width::int, 'x', height::int) AS resolution FROM pairs WHERE gen_no % 2 = 0"""))
def split_records(spark, sf):
    """One split of a set that is partitioned by split."""
    pairs, path = V.pairs(spark, sf), scratch_path(spark)
    records = pairs.select(F.lit(None).cast("binary").alias("image"), F.col("img_usr_tgt").alias("image_path"), F.col("gen_no").cast("string").alias("problem"),
                           F.col("username").alias("solution"), F.array(F.col("width").cast("int"), F.col("height").cast("int")).alias("resolution"),
                           F.when(F.col("gen_no") % 2 == 0, "train").otherwise("test").alias("split"))
    records.write.partitionBy("split").parquet(path)
    return readers.read_split(spark, path, "train").select("image_path", "problem", "solution", F.array_join("resolution", "x").alias("resolution"))


@query("lookup_map", "SELECT n_nationkey::varchar AS key, n_name AS name FROM nation")
def lookup_map(spark, sf):
    """A lookup as one JSON object."""
    path = scratch_path(spark)
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))
    # as long as the lookup
    V.table(spark, sf, "nation").agg(F.to_json(pairs).alias("value")).write.text(path)
    return readers.read_lookup(spark, path, "key", "name")


@query("media_folders", "SELECT DISTINCT event_type AS folder FROM events")
def media_folders(spark, sf):
    """Files below a folder, by the folder they lie in."""
    path = scratch_path(spark)
    V.table(spark, sf, "events").select("event_type", F.col("props").alias("value")).write.partitionBy("event_type").text(path)
    listed = readers.list_media(spark, path).filter(~F.col("path").contains("_SUCCESS"))
    return listed.select(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("folder")).distinct()


@query("raster_lines", S.with_(S.FIXATIONS, """
SELECT image, y, array_to_string(list(n ORDER BY x), ',') AS categories
FROM (SELECT image, floor(y)::int AS y, floor(x)::int AS x, count(*) AS n FROM fixations GROUP BY ALL) GROUP BY image, y"""))
def raster_lines(spark, sf):
    """Lines of a raster from its pixels, stored and read."""
    pixels = V.fixations(spark, sf).groupBy("image", F.floor("y").cast("int").alias("y"), F.floor("x").cast("int").alias("x")).agg(
        F.count("*").cast("int").alias("category"))
    path = scratch_path(spark)
    readers.raster_lines(pixels).write.parquet(path)
    return readers.read_segmentation(spark, path).select("image", "y", ints("categories").alias("categories"))


@query("named_sets", """
SELECT 'c' AS data_path, count(*) AS n, min(c_custkey) >= 0 AS ok FROM customer
UNION ALL SELECT 's', floor(count(*) * 0.25)::bigint, true FROM supplier""")
def named_sets(spark, sf):
    """Two named sets, of one of them a quarter."""
    source = lambda name, key: lambda s: V.table(s, sf, name).select(F.col(key).alias("key"))
    sets = catalog.Catalog({"customers": {"annotations": source("customer", "c_custkey"), "data_path": "c"},
                            "suppliers": {"annotations": source("supplier", "s_suppkey"), "data_path": "s"}})
    return sets.load(spark, "customers, suppliers%25", "key").groupBy("data_path").agg(
        F.count("*").alias("n"), (F.count_distinct("key") == F.count("*")).alias("ok"))


# --- columns -----------------------------------------------------------------

@query("image_names", S.with_(S.FIXATIONS, """
SELECT img_usr_tgt, pos, concat('vsgui10k-images/', image, '.png') AS path, image AS stem, floor(x + t * 1000 / 2) AS corner, floor(x)::bigint AS center FROM fixations"""))
def image_names(spark, sf):
    """Stored paths, their stems, and the centre of a box by either anchor."""
    rows = V.fixations(spark, sf).withColumns({"path": G.image_path("image"), "w": F.col("t") * 1000})
    return rows.select("img_usr_tgt", "pos", "path", G.image_stem("path").alias("stem"),
                       G.target_center("x", "w").cast("double").alias("corner"), G.target_center("x", "w", "center").alias("center"))


@query("turn_angles", S.with_(S.FIXATIONS + S.TRIALS + """, moves AS (
  SELECT img_usr_tgt, list_transform(range(1, len(x)), lambda i: {'dx': x[i + 1] - x[i], 'dy': y[i + 1] - y[i]}) AS m FROM trials
), turns AS (
  SELECT img_usr_tgt, unnest(range(1, len(m))) AS no, m FROM moves
), sized AS (
  SELECT img_usr_tgt, no, m[no].dx * m[no + 1].dx + m[no].dy * m[no + 1].dy AS dot, sqrt(m[no].dx ** 2 + m[no].dy ** 2) * sqrt(m[no + 1].dx ** 2 + m[no + 1].dy ** 2) AS size FROM turns
)""", "SELECT img_usr_tgt, no, CASE WHEN size > 0 THEN round(degrees(acos(least(greatest(dot / size, -1.0), 1.0))), 3) + 0e0 END AS angle FROM sized"))
def turn_angles(spark, sf):
    """Degrees between neighbouring saccades; none where one has no length."""
    angles = V.trials(spark, sf).select("img_usr_tgt", F.posexplode(G.turn_angles(G.saccades("x", "y"))).alias("no", "angle"))
    return angles.select("img_usr_tgt", (F.col("no") + 1).cast("bigint").alias("no"),
                         (F.round(F.nanvl("angle", F.lit(None).cast("double")), 3) + F.lit(0.0)).alias("angle"))


@query("custom_regions", S.with_(S.FIXATIONS, """
SELECT img_usr_tgt, array_to_string(list((floor(x / 100) + 10 * floor(y / 100))::int ORDER BY pos), ',') AS symbols FROM fixations GROUP BY img_usr_tgt"""))
def custom_regions(spark, sf):
    """Symbols of a mask of its own in place of a grid."""
    rows = V.fixations(spark, sf).select("img_usr_tgt", "pos", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    mask = rows.select("x", "y").distinct().withColumn("symbol", (F.floor(F.col("x") / 100) + 10 * F.floor(F.col("y") / 100)).cast("int"))
    return scanpath.custom_regions(rows, mask).select("img_usr_tgt", ints("symbols").alias("symbols"))


def _sized(xs, ys):
    cell = lambda v, size, bins: f"floor(trunc(CASE WHEN greatest({v}, 0) >= {size} THEN {size} - 1 ELSE greatest({v}, 0) END) * {bins} / {size})"
    return (f"list_transform(range(1, len({xs}) + 1), lambda i: ({cell(f'{ys}[i]', 'height', 12)} * 16 + {cell(f'{xs}[i]', 'width', 16)})::int)")


@query("sized_scanmatch", S.with_(S.PAIRS + f", sized AS (SELECT *, {_sized('x', 'y')} AS a, {_sized('px', 'py')} AS b FROM pairs)", f"""
SELECT img_usr_tgt, gen_no, {sql_r6(S.grid_alignment('a', 'b') + ' / (3.5 * greatest(len(a), len(b)))')} AS scanmatch FROM sized"""))
def sized_scanmatch(spark, sf):
    """Grid alignment with the size of each row's own screen."""
    return scanpath.scanmatch(V.pairs(spark, sf), width="width", height="height").select(*ID, r6("scanmatch").alias("scanmatch"))


@query("first_turns", S.with_(S.SAMPLES + ", late AS (SELECT conv_id, CASE WHEN conv_id % 2 = 1 THEN senders[2:] ELSE senders END AS s FROM samples)", """
SELECT conv_id, CASE WHEN len(s) > 0 AND s[1] <> 'human' THEN len(s) - 1 ELSE len(s) END::int AS turns,
       CASE WHEN len(s) > 0 AND s[1] <> 'human' THEN s[2] ELSE s[1] END AS first FROM late"""))
def first_turns(spark, sf):
    """Conversations whose first turn may be a reply."""
    late = F.when(F.col("conv_id") % 2 == 1, F.slice("conversations", F.lit(2), F.greatest(F.size("conversations") - 1, F.lit(0)))).otherwise(F.col("conversations"))
    rows = V.samples(spark, sf).withColumn("late", late)
    kept = P.without_leading_reply("late")
    return rows.select("conv_id", F.size(kept).alias("turns"), F.get(kept, F.lit(0))["from"].alias("first"))


@query("stored_lengths", S.with_(S.SAMPLES, f"""
SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 1 ELSE ({_WORDS} + 21)::int END AS length FROM samples"""))
def stored_lengths(spark, sf):
    """Lengths that samples bring along; 1 where there is none."""
    rows = packing.lengths(V.samples(spark, sf))
    known = F.when(F.col("conv_id") % 4 != 0, F.col("num_tokens")).cast("int")
    return rows.withColumn("known", known).select("conv_id", packing.stored_length("known").alias("length"))


@query("merged_packs", S.with_(S.SAMPLES + """, ids AS (
  SELECT conv_id, conv_id // 16 AS batch, list_transform(vals, lambda v: len(v)::bigint) AS input_ids FROM samples
), joined AS (SELECT batch, flatten(list(input_ids ORDER BY conv_id)) AS input_ids, list(len(input_ids) ORDER BY conv_id) AS sizes FROM ids GROUP BY batch)""", """
SELECT batch, 0 AS pack, array_to_string(input_ids, ',') AS input_ids, array_to_string(list_transform(input_ids, lambda v: -v), ',') AS labels,
       array_to_string(list_transform(range(0, len(sizes) + 1), lambda i: coalesce(list_sum(sizes[1:i]), 0)::bigint), ',') AS cumulative FROM joined"""))
def merged_packs(spark, sf):
    """Packs as one sequence each, with the borders of their samples."""
    ids = F.transform("conversations", lambda m: F.length(m["value"]).cast("bigint"))
    rows = V.samples(spark, sf).select("conv_id", ids.alias("input_ids"), F.transform(ids, lambda v: -v).alias("labels"),
                                       F.floor(F.col("conv_id") / 16).alias("batch"), F.lit(0).alias("pack"))
    merged = packing.merge_packs(rows.select("batch", "pack", "conv_id"), rows, "conv_id")
    return merged.select("batch", "pack", ints("input_ids").alias("input_ids"), ints("labels").alias("labels"), ints("cumulative_lengths").alias("cumulative"))
