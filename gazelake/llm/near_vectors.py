"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is a row of random hyperplane signs. Rows are ordered by
pass and key, and each is compared with the next few. The number of passes follows the
number of vectors. How long a prefix of a row's key those neighbours cover says how
likely a pair of that row is to be missed; rows of dense places, where this is too
likely, are compared with each other exactly. Pairs that are similar enough join their
components. What a component holds is then counted exactly, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gazelake.operators.prepare import row_numbers

from .common import stage, table
from .components import components
from .top_vectors import usable

COSINE = 0.95
#: Passes at least, neighbours that a row is compared with in each, and signs of a key.
PASSES, NEIGHBOURS, SIGNS = 24, 48, 62
#: Passes are added for more vectors until a pair is missed so rarely, or up to a number; rows above ten times that are compared exactly.
MISSED, MOST_PASSES = 1e-6, 128
#: Rows of a block.
BLOCK = 1024
#: Cells that rows of dense places are dealt to, at most.
CELLS = 256


def _same_sign(cosine: float) -> float:
    """The probability that a random plane does not part a pair at ``cosine``."""
    return 1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi


def passes_for(n: int, cosine: float, least: int, window: int) -> int:
    """Passes that find a pair among ``n`` evenly spread vectors."""
    chance = _same_sign(cosine) ** max(math.log2(max(n, 1) / window), 0.0)
    if not 0 < chance < 1:
        return least if chance else max(least, MOST_PASSES)
    return max(least, min(MOST_PASSES, math.ceil(math.log(MISSED) / math.log1p(-chance))))


def _keys(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        place = np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            ids = np.asarray(batch.column("head"))
            vectors = batch.column("embedding").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                x = np.array([vectors[i] for i in mine], np.float64).reshape(len(mine), size)
                # only directions count; very large or small lengths stay finite
                x = x / np.abs(x).max(axis=1, keepdims=True)
                for p in range(passes):
                    if (size, p) not in planes:
                        planes[size, p] = np.random.default_rng([int(size), p, 977]).standard_normal((size, SIGNS))
                    key = ((x @ planes[size, p] > 0) * place).sum(axis=1)
                    yield pa.RecordBatch.from_pydict({
                        "pass": pa.array(np.full(len(mine), p, np.int32)), "size": pa.array(np.full(len(mine), size, np.int32)),
                        "key": pa.array(key), "head": pa.array(ids[mine])})
    return run


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _log_missed(pdf: pd.DataFrame, cosine: float, window: int) -> np.ndarray:
    """For rows in order, the logarithm of the probability that a pass misses a pair of the row.

    All rows that share so many leading signs with a row that the first one beyond its window does not are in the window.
    """
    key, p, size = (pdf[c].to_numpy() for c in ("key", "pass", "size"))
    chance = np.full(len(pdf), 1 - 1e-12)
    far = window + 1
    both = np.flatnonzero((p[:-far] == p[far:]) & (size[:-far] == size[far:])) if len(pdf) > far else np.zeros(0, np.int64)
    differ = key[both] ^ key[both + far]
    high, low = differ >> 31, differ & ((1 << 31) - 1)
    bits = np.where(high > 0, 31 + np.frexp(high)[1], np.frexp(low)[1])
    covered = np.where(differ == 0, 0.0, _same_sign(cosine) ** (SIGNS - bits + 1.0))
    for at in (both, both + far):
        chance[at] = np.minimum(chance[at], covered)
    return np.log1p(-chance)


def _neighbours(cosine: float, window: int):
    """Links of a block's rows with the next ``window`` ones; of rows linked among themselves, a tree is enough.

    And for each of the block's own rows what its pass leaves to be missed.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        own = pdf["own"].to_numpy()
        covered = pd.DataFrame({"a": pdf["head"].to_numpy()[own], "missed": _log_missed(pdf, cosine, window)[own]})
        root = np.arange(len(pdf))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        ids, out = pdf["head"].to_numpy(), []
        for size, part in pdf.groupby("size"):
            where = np.flatnonzero(pdf["size"].to_numpy() == size)
            x, p = _unit(part["embedding"]), part["pass"].to_numpy()
            for k in range(1, min(window, len(x) - 1) + 1):
                near = np.flatnonzero((_cosines(x[:-k], x[k:]) >= cosine) & (p[:-k] == p[k:]))
                for i in near.tolist():
                    a, b = find(where[i]), find(where[i + k])
                    if a != b:
                        root[a] = b
                        out.append((ids[where[i]], ids[where[i + k]]))
        links = pd.DataFrame(out, columns=["a", "b"]).astype("Int64")
        covered["b"] = pd.array([pd.NA] * len(covered), "Int64")
        links["missed"] = np.nan
        return pd.concat([links, covered[["a", "b", "missed"]]])
    return run


def _nearest_pivot(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    """The cell of each row and its angle to the cell's pivot; rows of a size without pivots are one cell."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby("size"):
                cell, angle = np.full(len(part), CELLS + size), np.zeros(len(part))
                if size in pivots:
                    cells, y = pivots[size]
                    x = _unit(part["embedding"])
                    cosines = x @ y.T / np.sqrt((x * x).sum(axis=1))[:, None]
                    cell, angle = cells[cosines.argmax(axis=1)], np.arccos(np.clip(cosines.max(axis=1), -1, 1))
                yield part.assign(cell=cell.astype("int64"), angle=angle)[["head", "size", "embedding", "cell", "angle"]]
    return run


def _linked(cosine: float):
    """All links between the two blocks of a group, as a tree of each component."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        alone = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        if alone:
            right = left
        out = []
        if len(left) and len(right):
            x, y = _unit(left["embedding"]), _unit(right["embedding"])
            near = x @ y.T / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]) >= cosine
            near = np.triu(near, 1) if alone else near
            ids = left["head"].to_numpy() if alone else np.concatenate([left["head"], right["head"]])
            label, first = np.arange(len(ids)), 0 if alone else len(left)
            for r in np.flatnonzero(near.any(axis=1)):
                met = np.unique(label[np.concatenate([[r], np.flatnonzero(near[r]) + first])])
                out += [(ids[met[0]], ids[m]) for m in met[1:]]
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return run


def exact_links(dense: DataFrame, n: int, cosine: float) -> DataFrame:
    """Links among all pairs of ``dense`` (head, size, embedding), ``n`` rows: a tree of each component of a block pair.

    Rows are dealt to their nearest pivots. Two cells are left out only if the angle between
    their pivots is larger than the angles of both cells and of a pair together.
    """
    spark = dense.sparkSession
    rows = dense.orderBy(F.xxhash64("head"), "head").limit(min(CELLS, math.ceil(n / BLOCK))).select("size", "embedding").collect()
    pivots = {}
    for size in {r["size"] for r in rows}:
        y = _unit(pd.Series([r["embedding"] for r in rows if r["size"] == size]))
        pivots[size] = (np.array([i for i, r in enumerate(rows) if r["size"] == size]), y / np.sqrt((y * y).sum(axis=1))[:, None])
    dense = dense.select("head", "size", "embedding")
    schema = StructType([*dense.schema.fields, StructField("cell", LongType()), StructField("angle", DoubleType())])
    placed = stage(dense.mapInPandas(_nearest_pivot(pivots), schema))
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("c")).collect()}
    partners = [(c, c, math.ceil(r["c"] / BLOCK)) for c, r in cells.items()]
    for numbers, y in pivots.values():
        between = np.arccos(np.clip(y @ y.T, -1, 1))
        for a, i in enumerate(numbers.tolist()):
            for b, j in enumerate(numbers.tolist()):
                if i != j and i in cells and j in cells and between[a, b] <= cells[i]["reach"] + cells[j]["reach"] + math.acos(cosine) + 1e-6:
                    partners.append((i, j, math.ceil(cells[j]["c"] / BLOCK)))
    known = spark.createDataFrame([(c, math.ceil(r["c"] / BLOCK)) for c, r in cells.items()], "cell long, blocks long")
    partners = spark.createDataFrame(partners, "cell long, other long, other_blocks long")
    # cells are few by their bound
    unit = lambda cell, block: F.col(cell) * F.lit(1 << 32) + block
    placed = placed.join(F.broadcast(known), "cell").withColumn("unit", unit("cell", F.pmod(F.xxhash64("head"), F.col("blocks"))))
    pairs = placed.join(F.broadcast(partners), "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_blocks") - 1)))
    pairs = pairs.withColumn("met", unit("other", F.col("block"))).select(
        F.least("unit", "met").alias("i"), F.greatest("unit", "met").alias("j"), "head", "embedding",
        F.when(F.col("unit") <= F.col("met"), 0).otherwise(1).alias("side"))
    return pairs.groupBy("i", "j").applyInPandas(_linked(cosine), "a long, b long")


def _counted(cosine: float):
    """For each row of a group, the copies of other rows of its component that it is linked with."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, size), part in pdf.groupby(["component_id", "size"], sort=False):
            left = part[part["side"] == 0]
            right = left if part["i"].iloc[0] == part["j"].iloc[0] else part[part["side"] == 1]
            if not len(left) or not len(right):
                continue
            x, y = _unit(left["embedding"]), _unit(right["embedding"])
            nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            near = (x @ y.T) / (nx[:, None] * ny[None, :]) >= cosine
            near &= left["mark"].to_numpy()[:, None] != right["mark"].to_numpy()[None, :]
            out.append(pd.DataFrame({"mark": left["mark"], "n": near @ right["m"].to_numpy()}))
            if right is not left:
                out.append(pd.DataFrame({"mark": right["mark"], "n": left["m"].to_numpy() @ near}))
        return pd.concat(out) if out else pd.DataFrame({"mark": pd.Series([], dtype=object), "n": pd.Series([], dtype="int64")})
    return run


def near_vectors(rows: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = NEIGHBOURS) -> DataFrame:
    """Links of similar vectors: vec_id, n_links, component_id and kept.

    ``rows`` has vec_id and embedding; other columns are not read. Equal vectors are
    linked and compared once. A vector that is null, zero or empty or holds null or
    non-finite components, and a row without vec_id, is linked with nothing (kept, its
    own component). Vectors of different sizes are never linked. Rows are kept one
    for one; rows that repeat a vec_id share its component. ``passes`` is the least number
    of passes. A pair is found surely if both of its rows are in dense places, else it is
    missed about once in 100,000 at most; no pair below ``cosine`` is linked.
    """
    good = F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    base = stage(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").select(
        "vec_id", F.when(good, F.col("embedding")).alias("embedding")).withColumn(
        "mark", F.when(F.col("embedding").isNotNull(), F.concat_ws(":", F.xxhash64("embedding", F.lit(1)), F.xxhash64(F.lit(2), "embedding")))))
    full = base.filter("mark is not null")
    classes = full.groupBy("mark").agg(F.min("vec_id").alias("head"), F.count("*").alias("m"))
    heads = full.join(classes, "mark").filter("vec_id = head").select("mark", "head", "m", "embedding", F.size("embedding").alias("size"))
    heads = stage(heads.dropDuplicates(["mark"]))
    passes = passes_for(heads.count(), cosine, passes, window)
    keys = heads.select("head", "embedding").mapInArrow(_keys(passes), "pass int, size int, key long, head long")
    placed = row_numbers(keys, "pass", "size", "key", "head", name="_row")
    block = F.floor(F.col("_row") / BLOCK)
    # the last rows of a block meet the first ones of the next, and each row sees the first one beyond its window on both sides
    at = F.col("_row") % BLOCK
    around = F.array(block, F.when(at >= BLOCK - window - 1, block + 1), F.when((at <= window) & (block > 0), block - 1))
    blocks = placed.withColumn("block", F.explode(F.array_compact(around))).withColumn("own", F.col("block") == block)
    met = blocks.join(heads.select("head", "embedding", F.col("size").alias("_size")), "head").filter(F.col("size") == F.col("_size"))
    found = stage(met.select("block", "own", "_row", "pass", "size", "key", "head", "embedding").groupBy("block").applyInPandas(
        _neighbours(cosine, window), "a long, b long, missed double"))
    links = found.filter("b is not null").select("a", "b")
    dense = found.filter("b is null").groupBy(F.col("a").alias("head")).agg(F.sum("missed").alias("missed"))
    dense = stage(heads.join(dense.filter(F.col("missed") > math.log(10 * MISSED)).select("head"), "head"))
    n_dense = dense.count()
    if n_dense:
        links = links.unionByName(exact_links(dense, n_dense, cosine))
    copies = full.join(classes, "mark").filter("vec_id <> head").select(F.col("head").alias("a"), F.col("vec_id").alias("b"))
    links = stage(links.distinct())
    labels = stage(components(links.unionByName(copies)))
    # exact numbers of links within the components
    placed = heads.join(labels.select(F.col("id").alias("head"), "component_id"), "head")
    sizes = placed.groupBy("component_id").agg(F.count("*").alias("c")).filter("c > 1")
    placed = stage(placed.join(sizes, "component_id"))
    bins = placed.agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1))).first()[0]
    n_blocks = F.ceil(F.col("c") / BLOCK)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("mark"), n_blocks)).withColumn(
        "pair", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n_blocks - 1), lambda o: F.struct(
            F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))))
    # small components share a group, pairs of blocks of large ones have their own
    group = F.when(F.col("c") > BLOCK, F.col("component_id")).otherwise(-1 - F.pmod(F.xxhash64("component_id"), F.lit(bins)))
    placed = placed.select(group.alias("g"), "pair.i", "pair.j", "component_id", "mark", "m", "size", "embedding",
                           F.when(F.col("block") == F.col("pair.i"), 0).otherwise(1).alias("side"))
    counts = placed.groupBy("g", "i", "j").applyInPandas(_counted(cosine), "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    known = heads.select("mark", "m").join(counts, "mark", "left").select("mark", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = base.select("vec_id", "mark").join(known, "mark", "left").join(labels.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges as (
  select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id
  where len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.95),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
least_of as (select a, min(b) as b from reach group by a),
degree as (select a, count(*) as n from edges group by a)
select s.vec_id, coalesce(d.n, 0)::bigint as n_links, least(s.vec_id, coalesce(l.b, s.vec_id)) as component_id,
       s.vec_id = least(s.vec_id, coalesce(l.b, s.vec_id)) as kept
from embeddings s left join least_of l on l.a = s.vec_id left join degree d on d.a = s.vec_id
"""
