"""Queries on trials, answers and path comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import comparisons as C
from ..functions import geometry as G
from ..functions import prompts as P
from ..operators import clusters, prepare, saliency, scanpath, sequences
from ..session import cut_lineage
from ..sources import writers
from . import evaluation, sqlviews as S, testviews as V
from .registry import fixed, ints, query, r6, sql_fixed, sql_r6, sql_text

ID = ("img_usr_tgt", "gen_no")
KEYS = ["image", "target_id"]


# --- trials ------------------------------------------------------------------

@query("fixation_positions", S.with_(S.FIXATIONS, "SELECT img_usr_tgt, pos, x, y, t FROM fixations"))
def fixation_positions(spark, sf):
    return V.fixations(spark, sf).select("img_usr_tgt", "pos", "x", "y", "t")


@query("trials", S.with_(S.FIXATIONS + S.TRIALS, f"""
SELECT img_usr_tgt, image, username, target_id, width, height, ui_type, len(x) AS fixations,
       {sql_fixed('x', 0)} AS xs, {sql_fixed('y', 0)} AS ys, {sql_fixed('t', 2)} AS ts FROM trials"""))
def trials(spark, sf):
    return V.trials(spark, sf).select(
        "img_usr_tgt", "image", "username", "target_id", "width", "height", "ui_type",
        F.size("x").cast("bigint").alias("fixations"), fixed("x", 0).alias("xs"), fixed("y", 0).alias("ys"), fixed("t", 2).alias("ts"))


@query("canvas_paths", S.with_(S.CANVAS, f"""
SELECT img_usr_tgt, gen_no, {sql_fixed('x')} AS xs, {sql_fixed('y')} AS ys, {sql_fixed('t')} AS ts,
       {sql_fixed('px')} AS pxs, {sql_fixed('py')} AS pys FROM canvas"""))
def canvas_paths(spark, sf):
    return V.canvas_pairs(spark, sf).select(
        *ID, fixed("x").alias("xs"), fixed("y").alias("ys"), fixed("t").alias("ts"),
        fixed("px").alias("pxs"), fixed("py").alias("pys"))


@query("trimmed_paths", S.with_(S.PAIRS, f"""
SELECT img_usr_tgt, gen_no, least(len(px), len(x)) AS kept, {sql_fixed('px[1:least(len(px), len(x))]', 2)} AS xs,
       {sql_fixed("list_transform(px[1:coalesce(nullif(list_position(list_transform(px, lambda v: v::bigint % 5), 0), 0), len(px))], lambda v: v * 2.0::double + 3.0::double)", 2)} AS stopped
FROM pairs"""))
def trimmed_paths(spark, sf):
    """Sentinel tail, stop flag and de-normalised coordinates."""
    df = V.pairs(spark, sf)
    tail = df.withColumns({"px3": F.concat("px", F.array_repeat(F.lit(-1.0), 3)), "py3": F.concat("py", F.array_repeat(F.lit(-1.0), 3))})
    cut = prepare.trim_paths(tail, "px3", "py3", "py3")
    n = F.least(F.size("px3"), F.size("x"))
    stops = F.transform("px", lambda v: F.when(v.cast("bigint") % 5 == 0, 1).otherwise(0))
    return cut.select(*ID, n.cast("bigint").alias("kept"), fixed(G.prefix("px3", n), 2).alias("xs"),
                      fixed(G.denormalize(G.prefix("px", G.stop_length(stops)), 3.0, 2.0), 2).alias("stopped"))


@query("long_predictions", S.with_(S.PAIRS, """
, long AS (SELECT image, width, height, username, unnest(px) AS x, unnest(py) AS y FROM pairs)
SELECT image, width, height, username, x, y, 0.5::double AS timestamp FROM long"""))
def long_predictions(spark, sf):
    df = V.pairs(spark, sf).withColumn("pt", F.transform("px", lambda _: F.lit(0.5)))
    return writers.long_predictions(df)


_TARGET = "CASE target_id " + " ".join(f"WHEN 'txt_{k}' THEN '{v}'" for k, v in V.TARGETS.items()) + " END"
_QUESTION_SQL = sql_text(P.QUESTION, "width::int", "height::int", _TARGET)
_RULES_SQL = sql_text(P.THINK_RULES)


def _with_text(spark, sf):
    return prepare.attach_targets(V.trials(spark, sf), V.target2text(spark))


@query("prompts", S.with_(S.FIXATIONS + S.TRIALS, f"SELECT img_usr_tgt, {_QUESTION_SQL} || {_RULES_SQL} AS prompt FROM trials"))
def prompts(spark, sf):
    return _with_text(spark, sf).select("img_usr_tgt", P.inference_prompt().alias("prompt"))


_LISTED_SQL = "array_to_string(list_transform(range(1, len(x) + 1), lambda i: concat('[', floor(x[i])::bigint, ', ', floor(y[i])::bigint, ']')), ' ')"


@query("sft_conversations", S.with_(S.FIXATIONS + S.TRIALS, f"""
SELECT img_usr_tgt, {_QUESTION_SQL} || '<image>' AS human, concat('The scanpath is ', {_LISTED_SQL}, ' ') AS gpt,
       concat('<think>Look for ', {_TARGET}, '</think> <answer>The scanpath is ', {_LISTED_SQL}, '</answer>') AS gpt_think FROM trials"""))
def sft_conversations(spark, sf):
    plain = _with_text(spark, sf).withColumn("explanation", F.concat(F.lit("Look for "), "target"))
    conv = plain.select("img_usr_tgt", P.training_conversation().alias("c"), P.reasoning_conversation().alias("r"))
    return conv.select("img_usr_tgt", F.col("c")[0]["value"].alias("human"), F.col("c")[1]["value"].alias("gpt"),
                       F.col("r")[1]["value"].alias("gpt_think"))


_SOLUTION_SQL = ("concat('<answer>[', array_to_string(list_transform(range(1, len(x) + 1), lambda i: "
                 "concat('{''Position'': [', floor(x[i])::bigint, ', ', floor(y[i])::bigint, ']}')), ', '), ']</answer>')")


@query("rl_records", S.with_(S.FIXATIONS + S.TRIALS, f"""
SELECT img_usr_tgt, {sql_text(P.RL_PROBLEM, _TARGET, "width::int", "height::int", _TARGET)} AS problem,
       {_SOLUTION_SQL} AS solution, {sql_fixed('x', 0)} AS xs, 'user:image+text|system:,user:text' AS messages FROM trials"""))
def rl_records(spark, sf):
    df = _with_text(spark, sf).withColumns({"problem": P.rl_problem(), "solution": P.rl_solution()})
    inner = F.regexp_extract("solution", A.ANSWER, 1)
    with_image, plain = P.rl_messages("problem"), P.rl_messages("problem", with_image=False)
    parts = F.transform(with_image[0]["content"], lambda p: F.when((p["type"] == "text") & (p["text"] != F.col("problem")), "wrong").otherwise(p["type"]))
    text = F.transform(plain, lambda m: F.concat(m["role"], F.lit(":"), F.when(m["content"] == F.col("problem"), "text").when(
        m["content"] == P.SYSTEM_PROMPT, "").otherwise("wrong")))
    return df.select(
        "img_usr_tgt", "problem", "solution",
        fixed(F.transform(A.structured_points(inner), lambda p: p["x"]), 0).alias("xs"),
        F.concat(with_image[0]["role"], F.lit(":"), F.array_join(parts, "+"), F.lit("|"), F.array_join(text, ",")).alias("messages"))


@query("leakage", S.with_(S.FIXATIONS + S.TRIALS, """
SELECT image, target_id FROM trials WHERE trial < 2 INTERSECT SELECT image, target_id FROM trials WHERE trial >= 2"""))
def leakage(spark, sf):
    """Early trials as test, later ones as train."""
    df = V.trials(spark, sf)
    return prepare.leaked_keys(df.filter("trial >= 2"), df.filter("trial < 2"), KEYS)


@query("type_partition", S.with_(S.FIXATIONS + S.TRIALS, """
SELECT ui_type, count(*) AS trials, 0::bigint AS uncovered, 0::bigint AS unknown FROM trials GROUP BY ui_type"""))
def type_partition(spark, sf):
    df = V.trials(spark, sf)
    types = df.select("image", "ui_type").distinct()
    plain = df.select("img_usr_tgt", "image")
    parts = [prepare.keep_type(plain, types, t).select("img_usr_tgt", "image") for t in ("web", "desktop", "mobile")]
    uncovered = prepare.uncovered_trials(plain, parts).agg(F.count("*").alias("n")).scalar()
    unknown = prepare.unknown_images(plain, types).agg(F.count("*").alias("n")).scalar()
    return prepare.attach_types(plain, types).groupBy("ui_type").agg(F.count("*").alias("trials")).select(
        "*", uncovered.alias("uncovered"), unknown.alias("unknown"))


@query("sources_union", S.with_(S.FIXATIONS + S.TRIALS, """
SELECT CASE WHEN trial < 2 THEN 'test' ELSE 'train' END AS data_path, count(*) AS trials, sum(len(x))::bigint AS fixations
FROM trials WHERE image <> 'im3' GROUP BY 1"""))
def sources_union(spark, sf):
    df = prepare.exclude_images(V.trials(spark, sf), ["im3"])
    both = prepare.union_sources({"test": df.filter("trial < 2"), "train": df.filter("trial >= 2")})
    return both.groupBy("data_path").agg(F.count("*").alias("trials"), F.sum(F.size("x")).alias("fixations"))


# --- answers -----------------------------------------------------------------

@query("answers", S.with_(S.COMPLETIONS, f"""
SELECT prompt_id, gen_no, think, len(ax) AS points, {sql_fixed('ax', 0)} AS xs, {sql_fixed('ay', 0)} AS ys FROM parsed"""))
def answers(spark, sf):
    df = V.completions(spark, sf).withColumn("p", A.answer_points("content"))
    return df.select("prompt_id", "gen_no", A.reasoning("content").alias("think"), F.size("p").cast("bigint").alias("points"),
                     ints(F.transform("p", lambda p: p["x"])).alias("xs"), ints(F.transform("p", lambda p: p["y"])).alias("ys"))


@query("loose_answers", S.with_(S.COMPLETIONS, """
SELECT prompt_id, gen_no, len(regexp_extract_all(content, '\\[(\\d+)\\s*[\\s,]\\s*(\\d+)\\]', 1)) AS points FROM parsed"""))
def loose_answers(spark, sf):
    return V.completions(spark, sf).select(
        "prompt_id", "gen_no", F.size(A.points("content", A.LOOSE_POINT)).cast("bigint").alias("points"))


_BROKEN_SQL = "list_transform(range(1, len(px) + 1), lambda i: CASE WHEN (i + gen_no) % 3 = 0 OR gen_no = 3 THEN [px[i]::int] ELSE [px[i]::int, py[i]::int] END)"


@query("repaired_answers", S.with_(S.PAIRS, f"""
, broken AS (SELECT *, {_BROKEN_SQL} AS p FROM pairs), good AS (SELECT *, list_filter(p, lambda q: len(q) = 2) AS g FROM broken)
SELECT img_usr_tgt, gen_no, len(g) = len(p) AS well_formed,
       CASE WHEN len(g) = 0 THEN concat(floor(width / 2)::int, ' ', floor(height / 2)::int)
            ELSE array_to_string(list_transform(g, lambda q: concat(q[1], ' ', q[2])), ',') END AS points FROM good"""))
def repaired_answers(spark, sf):
    """Points of one coordinate are dropped, an emptied answer becomes the centre."""
    df = V.pairs(spark, sf)
    pts = F.transform(F.arrays_zip("px", "py"), lambda p, i: F.when(
        ((i + 1 + F.col("gen_no")) % 3 == 0) | (F.col("gen_no") == 3), F.array(p["px"].cast("int"))
    ).otherwise(F.array(p["px"].cast("int"), p["py"].cast("int"))))
    broken = df.withColumn("p", pts).withColumn("fixed", A.repaired("p", "width", "height"))
    return broken.select(*ID, A.well_formed("p").alias("well_formed"), F.array_join(F.transform(
        "fixed", lambda q: F.concat(q[0].cast("string"), F.lit(" "), q[1].cast("string"))), ",").alias("points"))


# --- geometry ----------------------------------------------------------------

@query("saccades", S.with_(S.FIXATIONS + """, s AS (
  SELECT img_usr_tgt, pos, x, y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM fixations WINDOW w AS (PARTITION BY img_usr_tgt ORDER BY pos)
), a AS (
  SELECT *, lead(dx) OVER w AS nx, lead(dy) OVER w AS ny FROM s WHERE dx IS NOT NULL WINDOW w AS (PARTITION BY img_usr_tgt ORDER BY pos)
)""", f"""
SELECT img_usr_tgt, pos, dx, dy, {sql_r6('sqrt(dx * dx + dy * dy)')} AS length, {sql_r6('atan2(dy, dx)')} AS theta,
       CASE WHEN nx IS NULL THEN NULL
            WHEN sqrt(dx * dx + dy * dy) = 0 OR sqrt(nx * nx + ny * ny) = 0 THEN NULL
            ELSE {sql_r6('degrees(acos(least(greatest((dx * nx + dy * ny) / (sqrt(dx * dx + dy * dy) * sqrt(nx * nx + ny * ny)), -1.0), 1.0)))')} END AS turn
FROM a"""))
def saccades(spark, sf):
    df = V.trials(spark, sf).withColumn("s", G.saccades("x", "y")).withColumn("turns", G.turn_angles("s"))
    long = df.select("img_usr_tgt", "turns", F.posexplode("s").alias("pos", "s"))
    return long.select("img_usr_tgt", "pos", "s.dx", "s.dy", r6("s.length").alias("length"), r6("s.theta").alias("theta"),
                       r6(F.nanvl(F.get("turns", F.col("pos")), F.lit(None).cast("double"))).alias("turn"))


_CELLS = f", cells AS (SELECT *, {S.grid_cells('x', 'y')} AS a, {S.grid_cells('px', 'py')} AS b FROM canvas)"
_LETTERS = f", letters AS (SELECT *, {S.grid_letters('x', 'y')} AS la, {S.grid_letters('px', 'py')} AS lb FROM canvas)"


@query("grid_symbols", S.with_(S.CANVAS + _CELLS, f"""
SELECT img_usr_tgt, gen_no, array_to_string(a, ',') AS human, array_to_string(b, ',') AS predicted,
       {S.grid_letters('x', 'y')} AS letters, array_to_string({S.repeated('a', 't', 'half_even')}, ',') AS timed FROM cells"""))
def grid_symbols(spark, sf):
    df = V.canvas_pairs(spark, sf).withColumns({"a": G.grid_symbols("x", "y"), "b": G.grid_symbols("px", "py")})
    return df.select(*ID, ints("a").alias("human"), ints("b").alias("predicted"), G.grid_letters("x", "y").alias("letters"),
                     ints(G.repeat_by_duration("a", "t")).alias("timed"))


@query("sed", S.with_(S.CANVAS + _LETTERS, "SELECT img_usr_tgt, gen_no, levenshtein(la, lb)::int AS sed FROM letters"))
def sed(spark, sf):
    return scanpath.edit_distance(V.canvas_pairs(spark, sf)).select(*ID, "sed")


def _answer_canvas(spark, sf):
    """Points parsed from the logged answers, on the canvas, next to the human path."""
    said = V.completions(spark, sf).withColumn("p", A.answer_points("content"))
    true = F.transform("p", lambda p: p["x"].cast("double"))
    df = said.withColumns({"px": true, "py": F.transform("p", lambda p: p["y"].cast("double")),
                           "s": A.points(A.normalized("solution"))})
    df = df.withColumns({"x": F.transform("s", lambda p: p["x"].cast("double")), "y": F.transform("s", lambda p: p["y"].cast("double"))})
    return prepare.normalize(prepare.normalize(df), "px", "py")


@query("sed_by_type", S.with_(S.REWARDS, f"""
, s AS (SELECT ui_type, levenshtein({S.grid_letters('spx3', 'spy3')}, {S.grid_letters('apx3', 'apy3')}) AS sed FROM reward_pad)
SELECT coalesce(ui_type, 'all') AS subset, count(*) AS answers, {sql_r6('avg(sed)')} AS sed FROM s GROUP BY GROUPING SETS ((ui_type), ())"""))
def sed_by_type(spark, sf):
    """Logged answers to points to letter strings to mean distance per UI type and overall."""
    scored = scanpath.edit_distance(_answer_canvas(spark, sf)).select("ui_type", "sed")
    sets = scored.groupingSets([[F.col("ui_type")], []], F.col("ui_type")).agg(
        F.count("*").alias("answers"), F.avg("sed").alias("sed"))
    return sets.select(F.coalesce("ui_type", F.lit("all")).alias("subset"), "answers", r6("sed").alias("sed"))


@query("edit_distance_cost2", S.with_(S.CANVAS + _CELLS + ", lettered AS (SELECT img_usr_tgt, gen_no, "
       + "list_transform(string_split({}, ''), lambda c: ascii(c)::double) AS a, list_transform(string_split({}, ''), lambda c: ascii(c)::double) AS b FROM canvas)".format(
           S.grid_letters("x", "y"), S.grid_letters("px", "py")),
       f"SELECT img_usr_tgt, gen_no, (len(a) + len(b) - 2 * {S.common('a', 'b')})::int AS distance FROM lettered"))
def edit_distance_cost2(spark, sf):
    return scanpath.edit_distance(V.canvas_pairs(spark, sf), substitution=2, name="distance").select(*ID, "distance")


@query("point_distance", S.with_(S.CANVAS, f"""
SELECT img_usr_tgt, gen_no, CASE WHEN len(x) = len(px) THEN
  {sql_r6('list_sum(list_transform(range(1, len(x) + 1), lambda i: sqrt(pow(x[i] - px[i], 2) + pow(y[i] - py[i], 2))))')} END AS point_distance FROM canvas"""))
def point_distance(spark, sf):
    return scanpath.point_distance(V.canvas_pairs(spark, sf)).select(*ID, r6("point_distance").alias("point_distance"))


# --- alignment ---------------------------------------------------------------

@query("lcs", S.with_(S.CANVAS + _CELLS, f"""
SELECT img_usr_tgt, gen_no, {S.common('a', 'b')}::int AS lcs, {sql_r6(S.common('a', 'b') + ' / greatest(len(a), len(b))')} AS match_ratio FROM cells"""))
def lcs(spark, sf):
    df = V.canvas_pairs(spark, sf).withColumns({"a": G.grid_symbols("x", "y"), "b": G.grid_symbols("px", "py")})
    return df.select(*ID, C.common_length("a", "b").alias("lcs"), r6(C.match_ratio("a", "b")).alias("match_ratio"))


@query("scanmatch", S.with_(S.CANVAS + _CELLS, f"""
SELECT img_usr_tgt, gen_no, {sql_r6(S.grid_alignment('a', 'b') + ' / (3.5 * greatest(len(a), len(b)))')} AS scanmatch FROM cells"""))
def scanmatch(spark, sf):
    return scanpath.scanmatch(V.canvas_pairs(spark, sf)).select(*ID, r6("scanmatch").alias("scanmatch"))


@query("scanmatch_duration", S.with_(S.CANVAS + _CELLS + f""", timed AS (
  SELECT img_usr_tgt, gen_no, {S.repeated('a', 't', 'half_even')} AS a,
         {S.repeated('b', 'list_transform(range(1, len(px) + 1), lambda i: 80.0 + 45.0 * (i % 4))', 'half_even')} AS b FROM cells)""", f"""
SELECT img_usr_tgt, gen_no, {sql_r6(S.grid_alignment('a', 'b') + ' / (3.5 * greatest(len(a), len(b)))')} AS scanmatch FROM timed"""))
def scanmatch_duration(spark, sf):
    df = V.canvas_pairs(spark, sf).withColumn("pt", F.transform("px", lambda _, i: 80.0 + 45.0 * ((i + 1) % 4)))
    return scanpath.scanmatch(df, temp_bin=50).select(*ID, r6("scanmatch").alias("scanmatch"))


_STEPS = f"""WITH RECURSIVE {S.CANVAS.strip()}{_CELLS}, scored AS (
  SELECT img_usr_tgt, gen_no, a, b, list_transform(range(0, len(a) + 1), lambda n: CASE WHEN n = 0 THEN list_transform(range(0, len(b) + 1), lambda z: 0.0::double)
    ELSE {S.grid_alignment('a[1:n]', 'b').removesuffix('[-1]')} END) AS m FROM cells
), back AS (
  SELECT img_usr_tgt, gen_no, a, b, m, len(a) AS i, len(b) AS j, 0 AS no, NULL::int AS sa, NULL::int AS sb FROM scored
  UNION ALL
  SELECT img_usr_tgt, gen_no, a, b, m, CASE WHEN move = 'b' THEN i ELSE i - 1 END, CASE WHEN move = 'a' THEN j ELSE j - 1 END, no + 1,
         CASE WHEN move = 'b' THEN -1 ELSE a[i] END, CASE WHEN move = 'a' THEN -1 ELSE b[j] END
  FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND m[i + 1][j + 1] = m[i][j] + (3.5 - sqrt(pow(a[i] % 16 - b[j] % 16, 2) + pow(floor(a[i] / 16) - floor(b[j] / 16), 2))) THEN 'both'
                       WHEN i > 0 AND (j = 0 OR m[i + 1][j + 1] = m[i][j + 1]) THEN 'a' ELSE 'b' END AS move FROM back WHERE i > 0 OR j > 0)
)"""


@query("scanmatch_steps", f"""{_STEPS}
SELECT img_usr_tgt, gen_no, (max(no) OVER (PARTITION BY img_usr_tgt, gen_no) - no)::int AS step, sa AS a, sb AS b FROM back WHERE no > 0""")
def scanmatch_steps(spark, sf):
    return scanpath.scanmatch_align(V.canvas_pairs(spark, sf)).select(*ID, "step", "a", "b")


@query("multimatch")
def multimatch(spark, sf):
    df = scanpath.multimatch(V.canvas_pairs(spark, sf))
    return df.select(*ID, *[r6(f"multimatch.{f}").alias(f) for f in C.MULTIMATCH_FIELDS])


@query("multimatch_simplified")
def multimatch_simplified(spark, sf):
    df = scanpath.multimatch(V.canvas_pairs(spark, sf), grouping=True, t_dir=45.0, t_dur=300.0, t_amp=80.0)
    return df.select(*ID, *[r6(f"multimatch.{f}").alias(f) for f in C.MULTIMATCH_FIELDS])


def _windows_sql(k):
    """Closest human window of every simulated window: list of distance / k."""
    d = "sqrt(pow(px[s + o] - x[h + o], 2) + pow(py[s + o] - y[h + o], 2))"
    return (f"list_transform(range(1, len(px) - {k} + 2), lambda s: list_min(list_transform(range(1, len(x) - {k} + 2), "
            f"lambda h: list_sum(list_transform(range(0, {k}), lambda o: {d})))) / {k})")


@query("time_delay", S.with_(S.CANVAS, f"""
SELECT img_usr_tgt, gen_no, {sql_r6('list_avg(' + _windows_sql(3) + ')')} AS mean_distance,
       {sql_r6('list_max(' + _windows_sql(3) + ')')} AS hausdorff,
       CASE WHEN least(len(x), len(px)) >= 5 THEN {sql_r6('list_avg(' + _windows_sql(5) + ')')} END AS mean_distance_5 FROM canvas"""))
def time_delay(spark, sf):
    df = scanpath.time_delay(V.canvas_pairs(spark, sf), 3, "mean", "mean_distance")
    df = scanpath.time_delay(scanpath.time_delay(df, 3, "hausdorff", "hausdorff"), 5, "mean", "mean_distance_5")
    return df.select(*ID, *[r6(c).alias(c) for c in ("mean_distance", "hausdorff", "mean_distance_5")])


_SCALED = ", unit AS (SELECT * REPLACE (list_transform(x, lambda v: v / 512) AS x, list_transform(y, lambda v: v / 512) AS y, list_transform(px, lambda v: v / 512) AS px, list_transform(py, lambda v: v / 512) AS py) FROM canvas)"
_PER_K = ", per_k AS (SELECT img_usr_tgt, gen_no, list_avg(" + _windows_sql("k") + ") AS d FROM (SELECT *, unnest(range(1, least(len(x), len(px)) + 1)) AS k FROM unit))"


@query("stde", S.with_(S.CANVAS + _SCALED + _PER_K, f"""
SELECT img_usr_tgt, gen_no, {sql_r6('avg(exp(-d))')} AS stde, {sql_r6('avg(d)')} AS distance FROM per_k GROUP BY ALL"""))
def stde(spark, sf):
    df = scanpath.scaled_time_delay(V.canvas_pairs(spark, sf))
    df = scanpath.scaled_time_delay(df, similarity=False, name="distance")
    return df.select(*ID, r6("stde").alias("stde"), r6("distance").alias("distance"))


# --- clusters and categories -------------------------------------------------

_CENTERS = """, centers AS (
  SELECT image, target_id, (least(floor(x / width * 4), 3) + 4 * least(floor(y / height * 3), 2))::int AS cluster_id,
         any_value(width) AS w, any_value(height) AS h, sum(x) / count(*) AS mx, sum(y) / count(*) AS my
  FROM fixations GROUP BY ALL
), packed AS (
  SELECT image, target_id, count(*) AS clusters, list({'id': cluster_id, 'cx': mx / w * 512.0::double, 'cy': my / h * 384.0::double} ORDER BY cluster_id) AS c
  FROM centers GROUP BY ALL
)"""


def _nearest_sql(xs, ys):
    d = "(c[k].cx - {x}[i]) * (c[k].cx - {x}[i]) + (c[k].cy - {y}[i]) * (c[k].cy - {y}[i])".format(x=xs, y=ys)
    return (f"list_transform(range(1, len({xs}) + 1), lambda i: "
            f"list_sort(list_transform(range(1, len(c) + 1), lambda k: {{'d': {d}, 'id': c[k].id}}))[1].id)")


def tile_centers(spark, sf):
    """Mean fixation of every tile of a 4 x 3 grid per key, as a centre table."""
    fx = V.fixations(spark, sf)
    tile = (F.least(F.floor(F.col("x") / F.col("width") * 4), F.lit(3))
            + 4 * F.least(F.floor(F.col("y") / F.col("height") * 3), F.lit(2))).cast("int")
    means = fx.groupBy(*KEYS, "width", "height", tile.alias("cluster_id")).agg(
        (F.sum("x") / F.count("*")).alias("mx"), (F.sum("y") / F.count("*")).alias("my"))
    return means.select(*KEYS, "cluster_id", (F.col("mx") / F.col("width") * 512.0).alias("cx"),
                        (F.col("my") / F.col("height") * 384.0).alias("cy"))


def _human_canvas(spark, sf):
    return V.trials(spark, sf).withColumns({"X": G.rescale("x", "width", G.CANVAS_WIDTH), "Y": G.rescale("y", "height", G.CANVAS_HEIGHT)})


_HUMAN_SYMBOLS = (", human AS (SELECT t.*, clusters, {} AS symbols FROM (SELECT *, list_transform(x, lambda v: v / width * 512.0::double) AS hx, "
                  "list_transform(y, lambda v: v / height * 384.0::double) AS hy FROM trials) t JOIN packed USING (image, target_id))").format(_nearest_sql("hx", "hy"))


@query("nearest_center", S.with_(S.FIXATIONS + S.TRIALS + _CENTERS + _HUMAN_SYMBOLS,
                                 "SELECT img_usr_tgt, array_to_string(symbols, ',') AS symbols FROM human"))
def nearest_center(spark, sf):
    return sequences.symbolize(_human_canvas(spark, sf), tile_centers(spark, sf), KEYS, "X", "Y").select(
        "img_usr_tgt", ints("symbols").alias("symbols"))


@query("transition_rate", S.with_(S.FIXATIONS + S.TRIALS + _CENTERS + _HUMAN_SYMBOLS, f"""
SELECT image, target_id, {sql_r6('''coalesce(sum(list_sum(list_transform(range(1, len(symbols)), lambda i:
  CASE WHEN symbols[i] <> symbols[i + 1] THEN 1.0::double ELSE -1.0::double END))), 0) / any_value(clusters)''')} AS rate
FROM human GROUP BY ALL"""))
def transition_rate(spark, sf):
    centers = tile_centers(spark, sf)
    symbolized = sequences.symbolize(_human_canvas(spark, sf), centers, KEYS, "X", "Y")
    return sequences.transition_rate(symbolized, centers, KEYS).select(*KEYS, r6("rate").alias("rate"))


_STRINGS = """, strings AS (
  SELECT image, target_id, username, arg_max(symbols, trial) AS human_symbols FROM human GROUP BY ALL
), scored AS (
  SELECT c.img_usr_tgt, c.gen_no, c.t, """ + _nearest_sql("c.px", "c.py").replace("c[k]", "p.c[k]").replace("len(c)", "len(p.c)") + """[1:20] AS a, s.human_symbols[1:20] AS b,
         list_transform(range(1, len(c.px) + 1), lambda i: 60.0 + 50.0 * (i % 3)) AS pt
  FROM canvas c JOIN packed p USING (image, target_id) JOIN strings s USING (image, target_id, username)
)"""


@query("sequence_score", S.with_(S.CANVAS + _CENTERS + _HUMAN_SYMBOLS + _STRINGS + f""", timed AS (
  SELECT *, {S.repeated('a', 'pt', 'floor')} AS ta, {S.repeated('b', 't', 'floor')} AS tb FROM scored)""", f"""
SELECT img_usr_tgt, gen_no, {sql_r6(S.common('a', 'b') + ' / greatest(len(a), len(b))')} AS ss,
       {sql_r6(S.common('ta', 'tb') + ' / greatest(len(ta), len(tb))')} AS ss_time FROM timed"""))
def sequence_score(spark, sf):
    centers = tile_centers(spark, sf)
    strings = sequences.subject_strings(
        sequences.symbolize(_human_canvas(spark, sf), centers, KEYS, "X", "Y"), "trial", KEYS)
    df = V.canvas_pairs(spark, sf).withColumn("pt", F.transform("px", lambda _, i: 60.0 + 50.0 * ((i + 1) % 3)))
    return sequences.sequence_score(df, centers, strings, KEYS).select(*ID, r6("ss").alias("ss"), r6("ss_time").alias("ss_time"))


#: Mean-shift by recursion: every distinct point walks to the mean of its neighbourhood; the strongest ends that are apart stay.
_FITTED = """
fitted_points AS (
  SELECT image, target_id, floor(x) / width * 512.0::double AS cx, floor(y) / height * 384.0::double AS cy, count(*)::double AS w
  FROM fixations GROUP BY ALL
), neighbours AS (
  SELECT p.image, p.target_id, p.cx, p.cy, p.w, sqrt((q.cx - p.cx) ** 2 + (q.cy - p.cy) ** 2) AS d, q.w AS qw
  FROM fitted_points p JOIN fitted_points q USING (image, target_id)
), reached AS (
  SELECT *, sum(qw) OVER (PARTITION BY image, target_id, cx, cy ORDER BY d) AS mass, sum(qw) OVER (PARTITION BY image, target_id, cx, cy) AS total
  FROM neighbours
), kth AS (
  SELECT image, target_id, cx, cy, w, min(d) AS d FROM reached WHERE mass >= greatest(1, floor(total * 0.3)) GROUP BY ALL
), bandwidths AS (SELECT image, target_id, sum(d * w) / sum(w) AS bandwidth FROM kth GROUP BY ALL
), reaches AS (SELECT *, bandwidth * factor AS r FROM bandwidths CROSS JOIN (SELECT unnest([0.2, 0.5, 0.8, 1.0, 1.2, 1.5, 1.8]::double[]) AS factor) f
), shifted AS (
  SELECT image, target_id, factor, r, cx AS sx, cy AS sy, cx AS mx, cy AS my, w AS mass, 0 AS step, r > 0 AS moving
  FROM fitted_points JOIN reaches USING (image, target_id)
  UNION ALL
  SELECT image, target_id, factor, r, sx, sy, nx, ny, mass, step + 1, sqrt((nx - mx) ** 2 + (ny - my) ** 2) > 0.001 * r AND step < 300
  FROM (SELECT m.image, m.target_id, m.factor, m.r, m.sx, m.sy, m.mx, m.my, m.step, sum(p.w) AS mass, sum(p.w * p.cx) / sum(p.w) AS nx, sum(p.w * p.cy) / sum(p.w) AS ny
        FROM shifted m JOIN fitted_points p ON p.image = m.image AND p.target_id = m.target_id AND (m.mx - p.cx) ** 2 + (m.my - p.cy) ** 2 <= m.r ** 2
        WHERE m.moving GROUP BY ALL)
), ends AS (
  SELECT image, target_id, factor, r, round(mx, 6) AS cx, round(my, 6) AS cy, max(mass) AS within FROM shifted WHERE NOT moving GROUP BY ALL
), alive AS (
  SELECT *, 0 AS step FROM ends
  UNION ALL
  SELECT image, target_id, factor, r, cx, cy, within, step + 1
  FROM (SELECT *, first_value(cx) OVER best AS tx, first_value(cy) OVER best AS ty FROM alive
        WINDOW best AS (PARTITION BY image, target_id, factor ORDER BY within DESC, cx DESC, cy DESC))
  WHERE (cx - tx) ** 2 + (cy - ty) ** 2 > r ** 2
), separate AS (
  SELECT image, target_id, factor, step AS cluster_id, cx, cy FROM alive
  QUALIFY row_number() OVER (PARTITION BY image, target_id, factor, step ORDER BY within DESC, cx DESC, cy DESC) = 1
), nearest AS (
  SELECT f.img_usr_tgt, f.pos, f.image, f.target_id, s.factor,
         arg_min(s.cluster_id, {'d': (floor(f.x) / f.width * 512.0::double - s.cx) ** 2 + (floor(f.y) / f.height * 384.0::double - s.cy) ** 2, 'id': s.cluster_id}) AS symbol
  FROM fixations f JOIN separate s USING (image, target_id) GROUP BY ALL
), steps_between AS (
  SELECT image, target_id, factor, symbol <> lag(symbol) OVER (PARTITION BY img_usr_tgt, factor ORDER BY pos) AS changed FROM nearest
), rates AS (
  SELECT image, target_id, factor, sum(CASE WHEN changed THEN 1 WHEN NOT changed THEN -1 ELSE 0 END) / any_value(clusters) AS rate
  FROM steps_between JOIN (SELECT image, target_id, factor, count(*) AS clusters FROM separate GROUP BY ALL) USING (image, target_id, factor) GROUP BY ALL
), chosen AS (
  SELECT image, target_id, arg_max(factor, {'rate': rate, 'low': -factor}) AS factor FROM rates GROUP BY ALL
), packed AS (
  SELECT image, target_id, count(*) AS clusters, list({'id': cluster_id, 'cx': cx, 'cy': cy} ORDER BY cluster_id) AS c
  FROM separate JOIN chosen USING (image, target_id, factor) GROUP BY ALL
)"""


@query("cluster_centers", f"""WITH RECURSIVE {S.FIXATIONS}, {_FITTED}
SELECT image, target_id, cluster_id, {sql_r6('cx')} AS cx, {sql_r6('cy')} AS cy FROM separate JOIN chosen USING (image, target_id, factor)""")
def cluster_centers(spark, sf):
    centers, _ = clusters.fit_clusters(cut_lineage(V.trials(spark, sf)), KEYS)
    return centers.select(*KEYS, "cluster_id", r6("cx").alias("cx"), r6("cy").alias("cy"))


@query("cluster_sequence_score", f"""WITH RECURSIVE {S.CANVAS}, {_FITTED}{_HUMAN_SYMBOLS}{_STRINGS}, timed AS (
  SELECT *, {S.repeated('a', 'pt', 'floor')} AS ta, {S.repeated('b', 't', 'floor')} AS tb FROM scored)
SELECT img_usr_tgt, gen_no, {sql_r6(S.common('a', 'b') + ' / greatest(len(a), len(b))')} AS ss,
       {sql_r6(S.common('ta', 'tb') + ' / greatest(len(ta), len(tb))')} AS ss_time FROM timed""")
def cluster_sequence_score(spark, sf):
    centers, strings = clusters.fit_clusters(cut_lineage(V.trials(spark, sf)), KEYS)
    df = V.canvas_pairs(spark, sf).withColumn("pt", F.transform("px", lambda _, i: 60.0 + 50.0 * ((i + 1) % 3)))
    scored = sequences.sequence_score(df, centers, strings, KEYS)
    return scored.select(*ID, r6("ss").alias("ss"), r6("ss_time").alias("ss_time"))


def _category_sql(xs, ys):
    px, py = f"trunc({xs}[i] / 512 * 512)", f"trunc({ys}[i] / 384 * 320)"
    return (f"list_transform(range(1, len({xs}) + 1), lambda i: CASE WHEN {px} < 512 AND {py} < 320 THEN "
            f"((floor({px} / 64) + floor({py} / 64) + image_no) % 5)::int END)")


@query("semantic_score", S.with_(S.CANVAS + f""", cats AS (
  SELECT img_usr_tgt, gen_no, t, {_category_sql('x', 'y')} AS b, {_category_sql('px', 'py')} AS a,
         list_transform(range(1, len(px) + 1), lambda i: 60.0 + 50.0 * (i % 3)) AS pt FROM canvas
), usable AS (SELECT *, len(list_filter(list_concat(a, b), lambda v: v IS NULL)) = 0 AS ok FROM cats
), timed AS (SELECT *, {S.repeated('a', 'pt', 'floor')} AS ta, {S.repeated('b', 't', 'floor')} AS tb FROM usable)""", f"""
SELECT img_usr_tgt, gen_no, CASE WHEN ok THEN {sql_r6(S.common('a', 'b') + ' / greatest(len(a), len(b))')} END AS sss,
       CASE WHEN ok THEN {sql_r6(S.common('ta', 'tb') + ' / greatest(len(ta), len(tb))')} END AS sss_time FROM timed"""))
def semantic_score(spark, sf):
    df = V.canvas_pairs(spark, sf).withColumn("pt", F.transform("px", lambda _, i: 60.0 + 50.0 * ((i + 1) % 3)))
    scored = sequences.semantic_score(df, V.segmentation_rows(V.fixations(spark, sf)), list(ID))
    null = F.lit(None).cast("double")
    return scored.select(*ID, *[r6(F.nanvl(c, null)).alias(c) for c in ("sss", "sss_time")])


@query("merged_symbols", S.with_(S.FIXATIONS + """, mask AS (
  SELECT event_id, ((floor(x / 128) + 5 * floor(y / 96)))::int AS symbol FROM (SELECT user_id * 1000 + trial * 12 + pos AS event_id, x, y FROM fixations)
), c AS (SELECT symbol, count(*) AS n FROM mask GROUP BY 1
), k AS (SELECT symbol, CASE WHEN n <= 330 THEN -1 ELSE symbol END AS kept FROM c)""", """
SELECT kept AS symbol, (dense_rank() OVER (ORDER BY kept) - 1)::int AS symbol_no, count(*) AS cells FROM mask JOIN k USING (symbol) GROUP BY kept"""))
def merged_symbols(spark, sf):
    mask = V.fixations(spark, sf).select((F.floor(F.col("x") / 128) + 5 * F.floor(F.col("y") / 96)).cast("int").alias("symbol"))
    return scanpath.merge_rare_symbols(mask, 330, -1).groupBy("symbol", "symbol_no").agg(F.count("*").alias("cells"))


# --- saliency ----------------------------------------------------------------

def canvas_points(df, x, y):
    return df.withColumns({x: F.col(x) / F.col("width") * 512.0, y: F.col(y) / F.col("height") * 384.0})


def _pixel_sql(v, size, to, shift):
    i = f"least(trunc({v} / {size} * {to}.0::double - {shift}), {to - 1})"
    return f"((({i} % {to}) + {to}) % {to})::int"


_HUMAN_PIXELS = f", human_pixels AS (SELECT image, target_id, {_pixel_sql('y', 'height', 384, 1)} AS y, {_pixel_sql('x', 'width', 512, 1)} AS x FROM fixations)"


@query("heatmap", S.with_(S.FIXATIONS + _HUMAN_PIXELS, "SELECT image, target_id, y, x, count(*) AS n FROM human_pixels GROUP BY ALL"))
def heatmap(spark, sf):
    return saliency.heatmap(canvas_points(V.fixations(spark, sf), "x", "y"), KEYS)


@query("predicted_heatmap", S.with_(S.PREDICTED, f"""
SELECT gen_no, image, target_id, {_pixel_sql('py', 'height', 384, 0)} AS y, {_pixel_sql('px', 'width', 512, 0)} AS x, count(*) AS n FROM pred_fixations GROUP BY ALL"""))
def predicted_heatmap(spark, sf):
    pred = canvas_points(V.pred_fixations(V.fixations(spark, sf)), "px", "py")
    return saliency.heatmap(pred, ["gen_no", *KEYS], "px", "py", human=False)


@query("shuffle_map", S.with_(S.FIXATIONS + _HUMAN_PIXELS, "SELECT DISTINCT y, x FROM human_pixels"))
def shuffle_map(spark, sf):
    return saliency.shuffle_map(canvas_points(V.fixations(spark, sf), "x", "y"))


@query("saliency")
def saliency_query(spark, sf):
    """Six scores per answer number and key; the shuffle map is per answer number."""
    fx = V.fixations(spark, sf)
    human = canvas_points(fx, "x", "y").select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("gen_no"))
    pred = canvas_points(V.pred_fixations(fx), "px", "py")
    scores = saliency.saliency_scores(human, pred, ["gen_no", *KEYS], subset=["gen_no"], extra=True)
    names = [c for c in scores.columns if c not in ("gen_no", *KEYS)]
    return scores.select("gen_no", *KEYS, *[r6(c).alias(c) for c in names])


# --- report ------------------------------------------------------------------

@query("report")
def report(spark, sf):
    """All metrics overall and per UI type; every answer counts as a prediction."""
    df = V.pairs(spark, sf)
    wide = evaluation.evaluate(df, KEYS, by="ui_type", history=cut_lineage(V.trials(spark, sf)),
                               segmentation=V.segmentation_rows(V.fixations(spark, sf)), id_cols=ID)
    return evaluation.long_report(wide)
