"""Near-duplicate texts: documents posted under the coordinates of their MinHash signature.

Documents with the same shingle set are one class. A class is posted under each
coordinate-value pair of its signature, but only under its rarest ones: two
signatures that agree in ``matches`` of ``coordinates`` values share one of the
first ``coordinates - matches + 1`` in any common order. The order is by frequency,
so passages that many documents share give no long lists. Collisions of classes
that are known to be in one component are skipped; the others count the values
they share and, above the threshold, are compared on their full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import among, drop_stage, joined, mix, prefix_hashes, slices, span_hashes, stage, table, write_stage
from .components import components


@dataclass(frozen=True)
class Settings:
    """``percent``: links have 100 * intersection >= percent * union.

    ``matches`` of ``coordinates`` values have to agree. At a similarity of 0.85 a
    pair has fewer than 40 of 64 with a probability of about 1e-6; so it is at 0.8 with
    34 of 64.
    """

    words: int = 3
    percent: int = 85
    coordinates: int = 64
    matches: int = 40

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1


#: Counters of the frequency sketch: a bounded table, whatever the corpus.
SKETCH = 1 << 16
POSTING = "key long, doc_id long, n long, coordinate int, mask long"
#: Postings of a list that are compared with each other at once.
BLOCK = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def shingles(data: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of several texts, end to end, and where each text's begin.

    ``data`` holds the bytes of all texts, ``starts`` each one's first byte and the total.
    """
    n = len(starts) - 1
    data = _LOWER[data]
    space = _SPACE[data]
    first = np.ones(len(data), bool)
    first[starts[:-1][starts[:-1] < len(data)]] = True
    first[1:] = space[:-1]
    first[starts[:-1][starts[:-1] < len(data)]] = True
    begin = np.flatnonzero(~space & first)
    last = np.ones(len(data), bool)
    last[:-1] = space[1:]
    last[starts[1:][starts[1:] > 0] - 1] = True
    end = np.flatnonzero(~space & last) + 1
    hashes = span_hashes(prefix_hashes(data), begin, end)
    # texts' numbers of words and of shingles
    bounds = np.searchsorted(begin, starts)
    count = np.diff(bounds)
    grams = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    out, at = np.zeros(int(grams.sum()), np.uint64), np.concatenate([[0], np.cumsum(grams)])
    owner = np.repeat(np.arange(n), grams)
    place = np.arange(len(out)) - at[owner] + bounds[owner]
    with np.errstate(over="ignore"):
        value = np.full(len(out), 0x51ED270B, np.uint64)
        for k in range(words):
            inside = place + k < bounds[owner + 1]
            value[inside] = mix(value[inside] * np.uint64(0x9FB21C651E98DF25) + hashes[place[inside] + k])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(n + 1))


def signatures(values: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash signatures (texts x coordinates) of non-empty shingle sets."""
    rng = np.random.default_rng(20_240)
    factors = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)
    out = np.zeros((len(at) - 1, coordinates), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(coordinates):
            out[:, k] = np.minimum.reduceat((values * factors[k] + shifts[k]) >> np.uint64(32), at[:-1])
    return out


def _signed(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, at = shingles(*joined(part.column("text").cast(pa.binary())), s.words)
                sizes = np.diff(at)
                some = np.flatnonzero(sizes)
                marks, signs = [None] * len(sizes), [None] * len(sizes)
                if len(some):
                    table_of = signatures(values, np.append(at[some], len(values)), s.coordinates)
                    for i, row in zip(some, table_of):
                        marks[i] = hashlib.blake2b(values[at[i]:at[i + 1]].tobytes(), digest_size=16).digest()
                        signs[i] = row.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()),
                    "mark": pa.array(marks, pa.binary()), "signature": pa.array(signs, pa.binary())})
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = joined(column)
    return data.view("<u4").reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint32)


def _keys(signs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each coordinate-value pair."""
    return mix(signs.astype(np.uint64) + (np.arange(signs.shape[1], dtype=np.uint64) << np.uint64(32)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        counts += np.bincount((_keys(_matrix(batch.column("signature"))) >> np.uint64(48)).astype(np.int64).ravel(), minlength=SKETCH)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(some.astype(np.int32)), "n": pa.array(counts[some])})


def _posted(s: Settings, sketch: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(_matrix(batch.column("signature")))
            order = np.lexsort((keys, counts[(keys >> np.uint64(48)).astype(np.int64)]), axis=1)[:, :s.prefix]
            rows = np.arange(len(keys))[:, None]
            mask = np.bitwise_or.reduce(np.uint64(1) << order.astype(np.uint64), axis=1)
            ids = np.asarray(batch.column("doc_id"))
            sizes = np.asarray(batch.column("n_shingles"))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys[rows, order].ravel().view(np.int64)), "doc_id": pa.array(np.repeat(ids, s.prefix)),
                "n": pa.array(np.repeat(sizes, s.prefix)), "coordinate": pa.array(order.ravel().astype(np.int32)),
                "mask": pa.array(np.repeat(mask.view(np.int64), s.prefix))})
    return run


def _alike(s: Settings):
    """Keep the pairs (a, b, sa, sb, na, nb) with enough equal signature values and sizes that allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            same = (_matrix(batch.column("sa")) == _matrix(batch.column("sb"))).sum(axis=1) >= s.matches
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            same &= 100 * np.minimum(na, nb) >= s.percent * np.maximum(na, nb)
            yield batch.select(["a", "b"]).filter(pa.array(same))
    return run


def _linked(s: Settings):
    """Keep the pairs (a, b, ta, tb) whose full shingle sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tb", 1 << 20):
                # equal neighbours (the usual case behind a join) are cut up once
                ta = part.column("ta").cast(pa.binary())
                ids = np.asarray(part.column("a"))
                fresh = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                left, la = shingles(*joined(ta.take(pa.array(fresh))), s.words)
                right, ra = shingles(*joined(part.column("tb").cast(pa.binary())), s.words)
                which = np.cumsum(np.append(True, ids[1:] != ids[:-1])) - 1
                keep = np.zeros(len(ids), bool)
                for i, k in enumerate(which.tolist()):
                    x, y = left[la[k]:la[k + 1]], right[ra[i]:ra[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= s.percent * (len(x) + len(y) - both)
                yield part.select(["a", "b"]).filter(pa.array(keep))
    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole (key, i, j) groups, and where the groups begin, from sorted rows."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if rows.num_rows:
            names = [rows.column(c).to_numpy() for c in ("key", "i", "j")]
            at = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in names], axis=0)))
            if len(at) > 1:
                yield rows.slice(0, at[-1]).combine_chunks(), at[:-1]
            rest = rows.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.zeros(1, np.int64)


class _Candidates:
    """Pairs of a group's rows that may be links and are this group's to look at."""

    def __init__(self, rows: pa.Table, signs: np.ndarray, s: Settings) -> None:
        self.signs, self.s = signs, s
        self.component, self.n, self.side, self.coordinate = (rows.column(c).to_numpy() for c in ("component_id", "n", "side", "coordinate"))
        self.one = rows.column("i").to_numpy() == rows.column("j").to_numpy()
        bits = np.arange(s.coordinates, dtype=np.uint64)
        self.prefix = (rows.column("mask").to_numpy().view(np.uint64)[:, None] >> bits & np.uint64(1)).astype(bool)

    def pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        left = np.arange(a, b) if self.one[a] else a + np.flatnonzero(self.side[a:b] == 0)
        right = left if self.one[a] else a + np.flatnonzero(self.side[a:b] == 1)
        found = []
        for k in range(0, len(left), 64):
            x = left[k:k + 64]
            smaller, larger = (f(self.n[x][:, None], self.n[right][None, :]) for f in (np.minimum, np.maximum))
            ok = (self.component[x][:, None] != self.component[right][None, :]) & (100 * smaller >= self.s.percent * larger)
            if self.one[a]:
                ok &= x[:, None] < right[None, :]
            i, j = np.nonzero(ok)
            i, j = x[i], right[j]
            same = self.signs[i] == self.signs[j]
            enough = np.flatnonzero(same.sum(axis=1) >= self.s.matches)
            i, j, same = i[enough], j[enough], same[enough]
            # of all lists that two documents share, the one of the lowest coordinate has the pair
            first = (same & self.prefix[i] & self.prefix[j]).argmax(axis=1)
            mine = first == self.coordinate[a]
            found.append((i[mine], j[mine]))
        return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _open(s: Settings):
    """Keep the rows of (key, i, j) groups that have a pair to be looked at, without their signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in _groups(batches):
            c = _Candidates(rows, _matrix(pa.concat_arrays(rows.column("signature").chunks)), s)
            keep = np.zeros(rows.num_rows, bool)
            for a, b in zip(at, np.append(at[1:], rows.num_rows)):
                for k in c.pairs(a, b):
                    keep[k] = True
            yield from rows.drop_columns(["signature"]).filter(pa.array(keep)).combine_chunks().to_batches()
    return run


def _proved(s: Settings):
    """Links within (key, i, j) groups, on the full sets; of rows linked already, a pair is skipped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in _groups(batches):
            ids = rows.column("doc_id").to_numpy()
            out = []
            for a, b in zip(at, np.append(at[1:], rows.num_rows)):
                group = rows.slice(a, b - a).combine_chunks()
                values, ends = shingles(*joined(pa.concat_arrays(group.column("text").chunks).cast(pa.binary())), s.words)
                c = _Candidates(group, signatures(values, ends, s.coordinates), s)
                root = {}

                def find(x: int) -> int:
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                for i, j in zip(*(k.tolist() for k in c.pairs(0, b - a))):
                    p, q = find(int(c.component[i])), find(int(c.component[j]))
                    if p == q:
                        continue
                    x, y = values[ends[i]:ends[i + 1]], values[ends[j]:ends[j + 1]]
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    if 100 * both >= s.percent * (len(x) + len(y) - both):
                        root[p] = q
                        out.append((ids[a + i], ids[a + j]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


def _confirmed(pairs: DataFrame, signed: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The links among ``pairs`` (a, b): first by signature, then on the full sets."""
    sign = signed.select(F.col("doc_id"), F.col("signature"), F.col("n_shingles"))
    full = (pairs.join(sign.toDF("a", "sa", "na"), "a").join(sign.toDF("b", "sb", "nb"), "b")
            .select("a", "b", "sa", "sb", "na", "nb"))
    pairs = stage(full.mapInArrow(_alike(s), "a long, b long"))
    text = docs.select("doc_id", "text")
    # the few texts that are needed, taken once
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    text = stage(among(text, "doc_id", needed).join(needed, "doc_id"))
    both = pairs.join(text.toDF("b", "tb"), "b").join(text.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(_linked(s), "a long, b long")


def _with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    found = rows.join(labels.select(F.col("id").alias("doc_id"), "component_id"), "doc_id", "left")
    return found.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Classes of similar texts: doc_id, n_shingles, component_id and kept.

    Takes doc_id and text; other columns are not read. A text that is null or has
    no word has an empty set and is linked with nothing; one with fewer words than a
    shingle has its whole sequence as one. Rows are kept one for one: a doc_id may
    repeat (its rows then share a component, as a link or as copies do), and a row
    without doc_id comes back as its own component, kept, with a null component_id.
    """
    spark, s = docs.sparkSession, settings
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = stage(source.mapInArrow(_signed(s), "doc_id long, n_shingles long, mark binary, signature binary"))
    full = signed.filter("mark is not null and doc_id is not null")
    # one document for each shingle set; the others are linked with it at once
    first = full.groupBy("mark").agg(F.min("doc_id").alias("first"))
    copies = full.join(first, "mark").filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    heads = stage(full.join(first, (full["mark"] == first["mark"]) & (full["doc_id"] == first["first"]), "left_semi")
                  .dropDuplicates(["doc_id", "mark"]).select("doc_id", "n_shingles", "signature"))
    sketch = np.zeros(SKETCH, np.int64)
    # at most SKETCH rows
    for row in heads.select("signature").mapInArrow(_sketched, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        sketch[row["slot"]] = row["n"]
    posted, posted_path = write_stage(heads.mapInArrow(_posted(s, sketch.tobytes()), POSTING))
    lists = posted.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    lists, lists_path = write_stage(lists.filter("low <> high").select("key", "low"))
    shared, shared_path = write_stage(among(posted, "key", lists.select("key")).join(lists, "key"))
    drop_stage(spark, posted_path)
    drop_stage(spark, lists_path)
    # each list's documents against its first one, then against one drawn for the list
    stars = shared.filter("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    text = source.filter("doc_id is not null")
    links = stage(_confirmed(stars, heads, text, s))
    labels = stage(components(links))
    draws = shared.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id", "key"), "doc_id")).alias("any"))
    drawn = shared.select("key", "doc_id").join(draws.select("key", F.col("any.doc_id").alias("any")), "key")
    drawn = _with_components(drawn, labels)
    other = labels.select(F.col("id").alias("any"), F.col("component_id").alias("other"))
    drawn = drawn.join(other, "any", "left").filter(F.col("component_id") != F.coalesce("other", "any"))
    stars = drawn.select(F.least("any", "doc_id").alias("a"), F.greatest("any", "doc_id").alias("b")).distinct()
    links = stage(links.unionByName(_confirmed(stars, heads, text, s)))
    labels = stage(components(links))
    # what is left: documents of one list in different components
    placed, placed_path = write_stage(_with_components(shared.drop("low"), labels))
    mixed = placed.groupBy("key").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y"), F.count("*").alias("m"))
    mixed = placed.join(mixed.filter("x <> y").select("key", "m"), "key")
    blocks = F.ceil(F.col("m") / BLOCK)
    mixed = mixed.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn(
        "pair", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(
            F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))))
    mixed = mixed.select("key", "pair.i", "pair.j", "doc_id", "n", "coordinate", "mask", "component_id",
                         F.when(F.col("block") == F.col("pair.i"), 0).otherwise(1).alias("side"))
    group = ("key", "i", "j")
    signs = mixed.join(heads.select("doc_id", "signature"), "doc_id").repartition(*group).sortWithinPartitions(*group)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mixed.schema.fields)
    undecided = stage(signs.select(*mixed.columns, "signature").mapInArrow(_open(s), shape))
    # a document's text goes to each group that has a pair of it to look at
    asked = undecided.select("doc_id").distinct()
    needed = stage(among(text, "doc_id", asked).join(asked, "doc_id"))
    read = undecided.join(needed, "doc_id").select(*mixed.columns, "text").repartition(*group).sortWithinPartitions(*group)
    links = stage(links.unionByName(read.mapInArrow(_proved(s), "a long, b long")))
    labels = stage(components(links.unionByName(copies)))
    drop_stage(spark, shared_path)
    drop_stage(spark, placed_path)
    out = _with_components(signed.select("doc_id", "n_shingles"), labels)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


SQL = """
with recursive texts as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from texts),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as m
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs where 100 * m >= 85 * (na + nb - m)),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept
from (select s.doc_id, s.s, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id
      from sets s left join reach r on r.a = s.doc_id group by s.doc_id, s.s)
"""
