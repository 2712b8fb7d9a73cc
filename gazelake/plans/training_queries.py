"""Queries on rewards, token logs and training sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import prompts as P
from ..operators import packing, prepare, rewards as R, validation
from ..session import cut_lineage
from ..sources import readers
from . import sqlviews as S, testviews as V
from .registry import fixed, ints, query, r6, sql_r6, sql_text

NAMES = ("accuracy_scanpath", "format")
ANSWER_ID = ("prompt_id", "gen_no")


@query("format_reward", S.with_(S.REWARDS, "SELECT prompt_id, gen_no, format FROM rewards"))
def format_reward(spark, sf):
    return R.format_reward(V.completions(spark, sf)).select(*ANSWER_ID, "format")


@query("scanpath_reward", S.with_(S.REWARDS, f"SELECT prompt_id, gen_no, {sql_r6('accuracy_scanpath')} AS accuracy_scanpath FROM rewards"))
def scanpath_reward(spark, sf):
    return R.scanpath_reward(V.completions(spark, sf)).select(*ANSWER_ID, r6("accuracy_scanpath").alias("accuracy_scanpath"))


@query("rewards", S.with_(S.REWARDS, f"SELECT prompt_id, gen_no, {sql_r6('accuracy_scanpath + format')} AS reward FROM rewards"))
def rewards(spark, sf):
    return R.rewards(V.completions(spark, sf), NAMES).select(*ANSWER_ID, r6("reward").alias("reward"))


def scored(spark, sf, *columns):
    """Rewards written once, as advantages and metrics read them twice."""
    return cut_lineage(R.rewards(V.completions(spark, sf), NAMES).select(*ANSWER_ID, *columns, *NAMES, "reward"))


@query("advantages", S.with_(S.REWARDS + ", total AS (SELECT prompt_id, gen_no, accuracy_scanpath + format AS reward FROM rewards)", f"""
SELECT prompt_id, gen_no, {sql_r6('reward')} AS reward, {sql_r6('(reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-4)')} AS advantage
FROM total WINDOW g AS (PARTITION BY prompt_id)"""))
def advantages(spark, sf):
    return R.advantages(scored(spark, sf)).select(*ANSWER_ID, r6("reward").alias("reward"), r6("advantage").alias("advantage"))


@query("prompt_columns", S.with_(S.COMPLETIONS, """
SELECT prompt_id, count(*) AS answers, any_value(image) AS image, any_value(target_id) AS target_id FROM logged GROUP BY prompt_id"""))
def prompt_columns(spark, sf):
    prompts = V.trials(spark, sf).select(F.col("img_usr_tgt").alias("prompt_id"), "image", "target_id")
    answers = V.completions(spark, sf).select(*ANSWER_ID)
    return R.with_prompts(answers, prompts).groupBy("prompt_id").agg(
        F.count("*").alias("answers"), F.min("image").alias("image"), F.min("target_id").alias("target_id"))


@query("kl_tokens", S.with_(S.TOKENS, f"""
SELECT prompt_id, gen_no, answer_length::int AS answer_length, {sql_r6('mean_kl')} AS mean_kl, {sql_r6('kl_sum')} AS kl_sum FROM kl"""))
def kl_tokens(spark, sf):
    df = R.kl_tokens(V.token_logps(spark, sf))
    total = F.aggregate("kl", F.lit(0.0), lambda a, v: a + v)
    return df.select(*ANSWER_ID, "answer_length", r6("mean_kl").alias("mean_kl"), r6(total).alias("kl_sum"))


@query("objective", S.with_(S.TOKENS + ", a AS (SELECT *, (answer_length - avg(answer_length) OVER g) / (coalesce(stddev_samp(answer_length) OVER g, 'nan'::double) + 1e-4) AS advantage FROM kl WINDOW g AS (PARTITION BY prompt_id))", f"""
SELECT prompt_id, gen_no, CASE WHEN isnan(advantage) THEN NULL ELSE {sql_r6('-(advantage - 0.04 * mean_kl)')} END AS loss FROM a"""))
def objective(spark, sf):
    """Answer length as reward: advantage, then the logged objective."""
    df = R.kl_tokens(V.token_logps(spark, sf)).withColumn("reward", F.col("answer_length").cast("double"))
    scored_df = R.objective(R.advantages(df))
    return scored_df.select(*ANSWER_ID, r6(F.nanvl("loss", F.lit(None).cast("double"))).alias("loss"))


_STEPS = S.TOKENS + """, answered AS (SELECT *, prompt_id // 50 AS step, answer_length::double AS reward FROM kl
), grouped AS (SELECT *, stddev_samp(reward) OVER (PARTITION BY step, prompt_id) AS sd FROM answered
), steps AS (
  SELECT step, avg(answer_length) AS completion_length, avg(reward) AS "rewards/length", avg(reward) AS reward, avg(mean_kl) AS kl,
         CASE WHEN count(*) > count(sd) THEN NULL ELSE avg(sd) END AS reward_std FROM grouped GROUP BY step
)"""


def _steps(spark, sf):
    df = R.kl_tokens(V.token_logps(spark, sf)).withColumn("reward", F.col("answer_length").cast("double"))
    df = df.withColumns({"step": F.floor(F.col("prompt_id") / 50), "length": F.col("reward")})
    # a prompt of one answer has no deviation: the mean of its step is not a number
    return R.step_metrics(df, ("length",))


def _number(c) -> Column:
    """Six digits; not a number is compared as null."""
    return r6(F.nanvl(c, F.lit(None).cast("double")))


@query("step_metrics", S.with_(_STEPS, "SELECT step, " + ", ".join(
    f'{sql_r6(chr(34) + c + chr(34))} AS "{c}"' for c in ("completion_length", "rewards/length", "reward", "kl", "reward_std")) + " FROM steps"))
def step_metrics(spark, sf):
    df = _steps(spark, sf)
    return df.select("step", *[_number(F.col(f"`{c}`")).alias(c) for c in ("completion_length", "rewards/length", "reward", "kl", "reward_std")])


@query("logged_metrics", S.with_(_STEPS, f"""
, long AS (SELECT * FROM (SELECT step // 10 AS log_no, completion_length, "rewards/length", reward, kl, reward_std FROM steps)
  UNPIVOT INCLUDE NULLS (value FOR metric IN (completion_length, "rewards/length", reward, kl, reward_std)))
SELECT log_no, concat('eval_', metric) AS metric, {sql_r6('CASE WHEN count(*) > count(value) THEN NULL ELSE avg(value) END')} AS value FROM long GROUP BY ALL"""))
def logged_metrics(spark, sf):
    return R.logged_metrics(_steps(spark, sf), 10, prefix="eval_").select("log_no", "metric", _number(F.col("value")).alias("value"))


@query("last_tokens", S.with_(S.TOKENS, """
SELECT prompt_id, gen_no, array_to_string(list(l_returnflag ORDER BY pos)[-3:], '') AS flags FROM tok GROUP BY prompt_id, gen_no"""))
def last_tokens(spark, sf):
    return V.token_logps(spark, sf).select(*ANSWER_ID, F.array_join(R.last_tokens("token_ids", 3), "").alias("flags"))


# --- training sets -----------------------------------------------------------

_WORDS = "list_sum(list_transform(vals, lambda v: len(regexp_extract_all(v, '\\S+'))))"


@query("lengths", S.with_(S.SAMPLES, f"""
SELECT conv_id, ({_WORDS} + CASE WHEN has_image THEN 128 ELSE 0 END)::int AS length,
       (CASE WHEN has_image THEN {_WORDS} ELSE -{_WORDS} END)::int AS modality_length, ({_WORDS} + 21)::int AS num_tokens FROM samples"""))
def lengths(spark, sf):
    return packing.lengths(V.samples(spark, sf)).select("conv_id", "length", "modality_length", "num_tokens")


_ROLE = "CASE s[i] " + " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in P.ROLES.items()) + " ELSE s[i] END"
_CHAT_SYSTEM, _CHAT_TURN = sql_text(P.BLOCK, "'system'", sql_text(P.CHAT_SYSTEM)), sql_text(P.BLOCK, _ROLE, "v[i]")


@query("chat_text", S.with_(S.SAMPLES + """, kept AS (
  SELECT conv_id, CASE WHEN senders[1] <> 'human' THEN senders[2:] ELSE senders END AS s, CASE WHEN senders[1] <> 'human' THEN vals[2:] ELSE vals END AS v FROM samples)""", f"""
SELECT conv_id, {_CHAT_SYSTEM} || array_to_string(list_transform(range(1, len(s) + 1), lambda i: {_CHAT_TURN}), '') AS chat FROM kept"""))
def chat_text(spark, sf):
    return V.samples(spark, sf).select("conv_id", P.rendered_chat("conversations").alias("chat"))


@query("expanded_media", S.with_(S.SAMPLES, """
SELECT conv_id, array_to_string(list_transform(range(1, len(vals) + 1), lambda i: CASE WHEN senders[i] = 'human' THEN
  replace(vals[i], '<image>', concat('<|vision_start|>', repeat('<|image_pad|>', (3 + conv_id % 4)::int), '<|vision_end|>')) ELSE vals[i] END), chr(10)) AS text FROM samples"""))
def expanded_media(spark, sf):
    df = V.samples(spark, sf).withColumn("counts", F.array((3 + F.col("conv_id") % 4).cast("int")))
    out = P.conversation_with_media("conversations", "counts", "counts")
    return df.select("conv_id", F.array_join(F.transform(out, lambda m: m["value"]), "\n").alias("text"))


_CHECKED = S.SAMPLES + """, checked AS (
  SELECT conv_id, has_image::int AS expected, coalesce(list_sum(list_transform(range(1, len(vals) + 1), lambda i:
           CASE WHEN senders[i] = 'human' THEN len(string_split(vals[i], '<image>')) - 1 ELSE 0 END)), 0) AS actual,
         has_image AND conv_id % 5 = 0 AS missing FROM samples
)"""


@query("media_problems", S.with_(_CHECKED, """
SELECT conv_id, concat_ws('; ', CASE WHEN missing THEN concat('Missing media files: img', conv_id, '.png') END,
  CASE WHEN expected <> actual THEN concat('Expected ', expected, ' <image> tokens, found ', actual::int) END) AS messages
FROM checked WHERE missing OR expected <> actual"""))
def media_problems(spark, sf):
    _, bad, _ = validation.validate_media(V.samples(spark, sf), V.media_listing(spark, sf), "conv_id")
    return bad.select("conv_id", F.array_join(F.transform("validation_problems", lambda p: p["message"]), "; ").alias("messages"))


@query("sample_forms", S.with_(S.SAMPLES, """
SELECT conv_id, CASE WHEN has_image THEN concat('img', conv_id, '.png') ELSE '' END AS images,
       array_to_string(senders, ',') AS senders, array_to_string(vals, chr(10)) AS texts FROM samples"""))
def sample_forms(spark, sf):
    """Samples as files hold them, by turns with a string or a list, one or plural, brought into one form."""
    def where(form, value):
        return F.when((F.col("conv_id") % 4 == form) & (F.size("image") > 0), value)

    def turn(m):
        named = F.col("conv_id") % 3 == 0
        return F.struct(F.when(~named, m["from"]).alias("from"), F.when(~named, m["value"]).alias("value"),
                        F.when(named, m["from"]).alias("role"), F.when(named, m["value"]).alias("content"))

    name, listed = F.get("image", F.lit(0)), F.to_json("image")
    forms = V.samples(spark, sf).select(
        "conv_id", F.coalesce(where(0, name), where(1, listed)).alias("image"), F.coalesce(where(2, name), where(3, listed)).alias("images"),
        F.lit(None).cast("string").alias("video"), F.lit(None).cast("string").alias("videos"),
        F.transform("conversations", turn).alias("conversations"))
    return readers.uniform_samples(forms).select(
        "conv_id", F.coalesce(F.array_join("image", "|"), F.lit("")).alias("images"),
        F.array_join("conversations.from", ",").alias("senders"), F.array_join("conversations.value", "\n").alias("texts"))


@query("media_statistics", S.with_(_CHECKED, """
SELECT count(*) AS total_entries, count(*) FILTER (NOT missing AND expected = actual) AS valid_entries, count(*) FILTER (missing) AS missing_media,
       count(*) FILTER (expected <> actual) AS token_mismatches, 0::bigint AS gpt_media_tokens, count(*) FILTER (expected = 1) AS image_only,
       0::bigint AS video_only, 0::bigint AS mixed FROM checked"""))
def media_statistics(spark, sf):
    return validation.statistics(validation.check(V.samples(spark, sf), V.media_listing(spark, sf), "conv_id"))


@query("first_missing", S.with_(_CHECKED, "SELECT conv_id, concat('img', conv_id, '.png') AS path FROM checked WHERE missing ORDER BY conv_id LIMIT 5"))
def first_missing(spark, sf):
    return validation.first_missing(V.samples(spark, sf), V.media_listing(spark, sf), "conv_id")


@query("batches", S.with_(S.FIXATIONS, """
SELECT img_usr_tgt, pos::int AS pos, (row_number() OVER (ORDER BY img_usr_tgt, pos) - 1) // 256 AS batch FROM fixations"""))
def batches(spark, sf):
    fx = V.fixations(spark, sf).select("img_usr_tgt", "pos")
    return prepare.in_batches(fx, "img_usr_tgt", "pos").select("img_usr_tgt", "pos", "batch")


def counted_samples(spark, sf):
    return packing.lengths(V.samples(spark, sf)).select("conv_id", "num_tokens")


#: Best fit, a sample a step: the fullest pack with room, the earlier one on ties, else a new one.
_PACKED = f"""WITH RECURSIVE {S.SAMPLES.strip()}, counted AS (
  SELECT conv_id, ({_WORDS} + 21)::bigint AS t, (row_number() OVER (ORDER BY conv_id) - 1) // {packing.BATCH_ROWS} AS batch FROM samples
), batches AS (SELECT batch, list({{'id': conv_id, 't': t}} ORDER BY t DESC, conv_id) AS items FROM counted GROUP BY batch
), filled AS (
  SELECT batch, 0 AS k, []::bigint[] AS load, NULL::bigint AS b, NULL::bigint AS t, NULL::bigint AS id FROM batches
  UNION ALL
  SELECT batch, k + 1, CASE WHEN b > len(load) THEN list_append(load, t)
           ELSE list_transform(range(1, len(load) + 1), lambda j: load[j] + CASE WHEN j = b THEN t ELSE 0 END) END, b, t, id
  FROM (SELECT batch, k, load, t, id, coalesce(list_sort(list_transform(list_filter(range(1, len(load) + 1), lambda j: load[j] + t <= {packing.PACK_TOKENS}),
                 lambda j: {{'u': -load[j], 'j': j}}))[1].j, len(load) + 1) AS b
        FROM (SELECT f.batch, k, load, items[k + 1].t AS t, items[k + 1].id AS id FROM filled f JOIN batches USING (batch) WHERE k < len(items)))
)"""


@query("packs", f"{_PACKED} SELECT batch, (b - 1)::int AS pack, id AS conv_id, t::int AS num_tokens FROM filled WHERE k > 0")
def packs(spark, sf):
    return packing.pack(counted_samples(spark, sf), "conv_id").select("batch", "pack", "conv_id", "num_tokens")


@query("pack_totals", f"{_PACKED} SELECT batch, (b - 1)::int AS pack, count(*) AS samples, sum(t)::bigint AS tokens FROM filled WHERE k > 0 GROUP BY ALL")
def pack_totals(spark, sf):
    packed = packing.pack_offsets(packing.pack(counted_samples(spark, sf), "conv_id"), "conv_id")
    return packed.groupBy("batch", "pack").agg(F.count("*").alias("samples"), F.max("end").alias("tokens"))


@query("sample_offsets", S.with_(S.SAMPLES + f", l AS (SELECT conv_id, conv_id // 16 AS batch, {_WORDS} + 21 AS n FROM samples)", """
SELECT conv_id, (sum(n) OVER w - n)::bigint AS "start", (sum(n) OVER w)::bigint AS "end" FROM l WINDOW w AS (PARTITION BY batch ORDER BY conv_id)"""))
def sample_offsets(spark, sf):
    """Cumulative offsets with fixed runs of 16 samples as packs."""
    df = counted_samples(spark, sf).withColumns({"batch": F.floor(F.col("conv_id") / 16), "pack": F.lit(0)})
    return packing.pack_offsets(df, "conv_id").select("conv_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("label_mask", S.with_(S.SAMPLES + """, tok AS (
  SELECT conv_id, unnest(range(1, len(vals) + 1)) AS i, senders, vals FROM samples
), per_turn AS (SELECT conv_id, i, senders[i] AS s, list_transform(regexp_extract_all(vals[i], '\\S+'), lambda w: length(w)) AS ids FROM tok)""", """
SELECT conv_id, array_to_string(flatten(list(list_transform(range(1, len(ids) + 1), lambda k: CASE WHEN s = 'gpt' AND k > 3 THEN ids[k] ELSE -100 END) ORDER BY i)), ',') AS labels
FROM per_turn GROUP BY 1"""))
def label_mask(spark, sf):
    turns = F.transform("conversations", lambda m: F.struct(
        P.role_of(m["from"]).alias("role"), F.transform(F.split(F.trim(m["value"]), r"\s+"), lambda w: F.length(w)).alias("ids")))
    return V.samples(spark, sf).select("conv_id", ints(packing.label_mask(turns)).alias("labels"))


_FRAMES = "greatest(least(round_even(n_chars / (10 + doc_id % 20) / 4.0, 0), 8), 4)"


@query("frame_plan", f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(range(0, {_FRAMES}::int), lambda i: floor(i * ((n_chars - 1) / ({_FRAMES} - 1)))::int))), ',') AS frames,
       {sql_r6(f'2.0 / (len(list_distinct(list_transform(range(0, {_FRAMES}::int), lambda i: floor(i * ((n_chars - 1) / ({_FRAMES} - 1)))::int))) / (n_chars / (10 + doc_id % 20)))')} AS seconds
FROM documents""")
def frame_plan(spark, sf):
    """A document as a video of as many frames as it has characters."""
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("frames"), (10 + F.col("doc_id") % 20).alias("fps"))
    plan = docs.withColumn("plan", packing.frame_plan("frames", "fps"))
    return plan.select("doc_id", F.array_join(F.transform("plan", lambda v: v.cast("string")), ",").alias("frames"),
                       r6(packing.seconds_per_grid("frames", "fps", "plan")[0]).alias("seconds"))


# --- order and sampling ------------------------------------------------------

@query("exact_sample", S.with_(S.FIXATIONS, "SELECT floor(count(*) * 0.3)::bigint AS taken, floor(count(*) * 0.3)::bigint AS different FROM fixations"))
def exact_sample(spark, sf):
    fx = V.fixations(spark, sf).select("img_usr_tgt", "pos")
    return prepare.exact_sample(fx, "img_usr_tgt", "pos", rate=0.3).agg(
        F.count("*").alias("taken"), F.countDistinct("img_usr_tgt", "pos").alias("different"))


@query("shuffled_trials", S.with_(S.FIXATIONS + S.TRIALS, "SELECT img_usr_tgt FROM trials"))
def shuffled_trials(spark, sf):
    return prepare.shuffled(V.trials(spark, sf).select("img_usr_tgt"), "img_usr_tgt")


@query("repeat_sample", S.with_(S.FIXATIONS + S.TRIALS, "SELECT img_usr_tgt, unnest([1, 2, 3])::int AS copy_no FROM trials"))
def repeat_sample(spark, sf):
    return prepare.repeat_sample(V.trials(spark, sf).select("img_usr_tgt"), "img_usr_tgt", times=3)
