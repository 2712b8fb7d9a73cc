"""Mixing sources to target weights by pivotal rounding in a reduction tree, in DataFrame functions only.

All rows of a source have the same fractional number of copies. Within a small
group, rows are taken in turn: the row that is still fractional meets the next
one, and a random transfer of words between the two makes one of them integral.
The transfer keeps the expected copies of both and the sum of the group's words.
Each group leaves one fractional row; groups of those are folded again until a
source has a single one, which goes to the nearer whole number: a source misses its
target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gazelake.operators.prepare import row_numbers

from .common import stage, table

#: Weights of the sources in their order, repeated as often as needed.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all words, and the most copies of a document.
SHARE, MOST = 1.5, 2.0
#: Rows folded by one step of the tree, on average.
GROUP = 256
#: Probabilities this near to 0 or 1 are that.
NEAR = 1e-9

ROW = "doc_id bigint, size bigint, key bigint, source_size bigint, target double, base bigint"
OUT = ("doc_id", "key", "size", "source_size", "target")


def words(text) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text", "source")


def uniform(key: Column, step: int) -> Column:
    """A number from [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit(step)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size, n): words by weight, none above ``most`` times the source's size.

    What is cut off is shared again by weight: every target is its weight times one
    level, or its bound. The level is found by a few sums over the sources.
    """
    order = F.col("source").asc_nulls_last()
    ranked = row_numbers(totals, order, name="_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("source", "source_size", "n", weight.alias("_w"), (F.col("source_size") * most).alias("_bound")))
    total = ranked.agg((F.sum("source_size") * share).alias("t")).first()["t"] or 0.0
    level, bounded = 0.0, -1
    while True:
        free = F.col("_w") * level < F.col("_bound") if bounded >= 0 else F.lit(True)
        s = ranked.agg(F.sum(F.when(free, F.col("_w"))).alias("w"), F.sum(F.when(free, 0.0).otherwise(F.col("_bound"))).alias("b"),
                       F.count(F.when(~free, 1)).alias("n")).first()
        if s["n"] == bounded or not s["w"]:
            break
        level, bounded = (total - s["b"]) / s["w"], s["n"]
    return ranked.select("source", "source_size", "n", F.least(F.col("_w") * level, F.col("_bound")).alias("target"))


def _step(state: Column, row: Column, level: int) -> Column:
    """The fractional row meets ``row``: one of the two becomes integral and is done."""
    a, b = state["pivot"], row
    wa, pa, wb, pb = a["size"], a["p"], b["size"], b["p"]
    to_a, to_b = F.least(wa * (1 - pa), wb * pb), F.least(wb * (1 - pb), wa * pa)
    up_a = uniform(b["key"], level) * (to_a + to_b) < to_b
    # if a gains: it is full, or b is empty; else b is full, or a is empty
    a_ends = F.when(up_a, wa * (1 - pa) <= wb * pb).otherwise(wa * pa <= wb * (1 - pb))
    pa_new = F.when(up_a, pa + to_a / wa).otherwise(pa - to_b / wa)
    pb_new = F.when(up_a, pb - to_a / wb).otherwise(pb + to_b / wb)
    ended, left = F.when(a_ends, a).otherwise(b), F.when(a_ends, b).otherwise(a)
    extra = F.when(a_ends == up_a, 1).otherwise(0)
    p = F.least(F.greatest(F.when(a_ends, pb_new).otherwise(pa_new), F.lit(0.0)), F.lit(1.0))
    return F.struct(left.withField("p", p).alias("pivot"),
                    F.array_append(state["done"], ended.withField("p", extra.cast("double"))).alias("done"))


def _fold(rows: DataFrame, level: int) -> DataFrame:
    """One step of the tree: a row for each (source, bucket) with ``pivot`` and ``done``."""
    fields = ["doc_id", "size", "key", "source_size", "target", "base", "p"]
    item = F.struct((-F.col("size")).alias("order"), *fields)
    # the large first, so that what is left over in the end is small; about GROUP rows
    group = rows.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    item_type = f"struct<order:bigint,{', '.join(ROW.split(', ')).replace(' ', ':').replace(',:', ',')},p:double>"
    start = F.struct(F.element_at("rows", 1).alias("pivot"), F.array().cast(f"array<{item_type}>").alias("done"))
    folded = F.aggregate(F.slice("rows", 2, F.size("rows")), start, lambda s, r: _step(s, r, level))
    return group.select("source", "bucket", folded.alias("f")).select("source", "bucket", "f.pivot", "f.done")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """How often the mix takes each document.

    Takes doc_id, text and source; returns doc_id, key (a hash of the three), size
    (words), source_size, target (both of the row's source), copies and taken (= size * copies). A null text has
    size 0 and is never taken; a null source is a source of its own, the last one. Rows
    are kept one for one. Rows alike in doc_id, text and source are counted first:
    the whole part of their common copies is given out, only the rest is drawn. The
    result depends on the rows alone, so reruns agree.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"),
                       row_key().alias("key"))
    alike = stage(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("m")))
    totals = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    goals = targets(totals, weights, share, most)
    most_rows = goals.agg(F.max("n")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = (alike.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
              .withColumn("base", F.floor(ratio + NEAR)).withColumn("_all", (ratio - F.col("base")) * F.col("m"))
              .withColumn("_all", F.when((F.col("size") > 0) & (F.col("_all") > NEAR), F.col("_all")).otherwise(0.0))
              .withColumn("_whole", F.floor(F.col("_all") + NEAR))
              .withColumn("p", F.greatest(F.col("_all") - F.col("_whole"), F.lit(0.0))))
    copies = joined.withColumn("_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    drawn = (F.col("_no") == F.col("_whole") + 1) & (F.col("p") > NEAR)
    fixed = copies.filter(~drawn).select(*OUT, (F.col("base") + (F.col("_no") <= F.col("_whole")).cast("long")).alias("copies"))
    open_rows = joined.filter(F.col("p") > NEAR).withColumn(
        "bucket", F.pmod(F.xxhash64("key", F.lit("bucket")), F.ceil(F.col("n") / GROUP)))
    parts, level, groups = [fixed], 0, max(1, -(-most_rows // GROUP))
    while True:
        folded = stage(_fold(open_rows, level))
        parts.append(_decided(folded.select(F.explode("done").alias("r")), F.col("r.p")))
        if groups == 1:
            break
        open_rows = folded.select("source", F.floor(F.col("bucket") / GROUP).alias("bucket"), "pivot.*").drop("order")
        level, groups = level + 1, -(-groups // GROUP)
    last = folded.select(F.col("pivot").alias("r"))
    parts.append(_decided(last, F.col("r.p")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Of rows alike in doc_id, text and source one stands for all.
    """
    taken = mix(docs).groupBy(F.col("key").alias("k"), F.col("doc_id").alias("d")).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    # numbered names: a document's own columns may be called anything
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(row_key(), F.col("doc_id").cast("long"), "*").toDF("key", "id", *names).dropDuplicates(["key", "id"])
    rows = rows.join(taken, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("d")))
    return rows.withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(names).toDF(*docs.columns)


def _decided(rows: DataFrame, extra: Column) -> DataFrame:
    return rows.select(*[f"r.{c}" for c in OUT], (F.col("r.base") + F.round(extra).cast("long")).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
