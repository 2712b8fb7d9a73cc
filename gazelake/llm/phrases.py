"""Collocations by Toivonen mining: a sample proposes, full passes count, failures of the border widen the next pass.

The set of proposed phrases is held as a bitmap of fixed size. A full pass counts every
phrase whose parts (the phrases one word shorter inside it) are all in the set: the proposed
phrases and their negative border, together and exactly. Frequent phrases that were not
proposed are failures; they join the set, and a further pass counts what that adds, until
a pass adds none. A place of the bitmap that two phrases share only lets more be counted.

Phrases are counted inside a slice of text before anything is shuffled: words become
numbers by Arrow's dictionary, pairs and triples numbers by sorting, so a word that
fills a third of the corpus reaches a shuffle as one row a slice.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import joined, mix, slices, table, write_stage
from .textarrays import byte_table, rows_of, run_hashes, runs

UNDETERMINED = "und"
BREAK = byte_table(b".,;:!?\n\x0b\x0c\r")
WORD_BYTE = ~BREAK & ~byte_table(b" \t")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class Settings:
    #: Occurrences that make a phrase frequent, and words of a phrase at most.
    least: int = 10
    longest: int = 3
    #: One document in so many is sampled, and a phrase found so often there is proposed.
    sampled: int = 16
    proposed: int = 2
    #: The bitmap of the proposed set has two to this power bits, whatever the corpus: 8 MB.
    bits: int = 26
    #: Bytes of text that are counted together before the shuffle.
    slice_bytes: int = 6 << 20
    #: A phrase goes if a longer one around it has this share of its occurrences (in percent).
    inside: int = 50
    #: Phrases reported of each language.
    top: int = 2000


PHRASE = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("place", pa.int32()), ("known", pa.bool_()), ("f", pa.int64())])
PACKET = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("langs", pa.list_(pa.string())), ("rows", pa.binary())])


@dataclass(frozen=True)
class Counts:
    """Phrases of a slice: their hashes, length and membership (a bit), language, count, text."""

    hashes: np.ndarray
    flags: np.ndarray
    lang: np.ndarray
    f: np.ndarray
    phrase: pa.Array
    names: list[str]


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in turn, the text and the piece it lies in."""
    data, at = joined(column)
    data = LOWER[data]
    inside = WORD_BYTE[data]
    starts, ends = runs(inside, at)
    sizes = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=sizes[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    texts = rows_of(starts, at)
    # a piece ends at a break and at the end of a text
    piece = np.searchsorted(np.flatnonzero(BREAK[data]), starts) + texts
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), texts.astype(np.int32), piece.astype(np.int32)


def codes(words: pa.Array) -> np.ndarray:
    data, at = joined(words)
    return run_hashes(data, at[:-1], at[1:])


class Bitmap:
    """Membership of phrases, by the top bits of their hashes."""

    def __init__(self, raw: bytes) -> None:
        self.bytes = np.frombuffer(raw, np.uint8)

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def unpacked(packed: bytes) -> Bitmap:
        return Bitmap(zstandard.decompress(packed))

    def has(self, places: np.ndarray) -> np.ndarray:
        return (self.bytes[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


class Everything:
    """The set that holds every phrase: a sample is counted whole."""

    def has(self, places: np.ndarray) -> np.ndarray:
        return np.ones(len(places), bool)


def _firsts(slot: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The first of the ascending places ``at`` of each of ``n`` slots."""
    out = np.empty(n, np.int64)
    out[slot[::-1]] = at[::-1]
    return out


def counted(texts: pa.Array, langs: list[str], within, before, settings: Settings) -> Iterator[Counts]:
    """Hashes and counts of the phrases of a slice whose parts are all in ``within``, by length.

    What the pass under the smaller set ``before`` has counted is left out. A row of size 0 counts the words of a
    language. ``known`` tells whether a phrase is in ``within``.
    """
    words, number, text, piece = words_of(texts)
    names, n = sorted(set(langs)), len(number)
    if not n:
        return
    code, values = np.array([names.index(x) for x in langs], np.int64)[text], codes(words)
    # scrambled once more, as a language may have a word that is its name
    salt = mix(~codes(pa.array(names)))

    def rows(size: int, lang: np.ndarray, phrase: pa.Array, hashes: np.ndarray, known: np.ndarray, f: np.ndarray) -> Counts:
        flags = np.full(len(lang), size << 1, np.uint8) | known.astype(np.uint8)
        return Counts(hashes, flags, lang.astype(np.uint32), f.astype(np.uint32), phrase, names)

    if before is None:
        yield rows(0, np.arange(len(names)), pa.array([""] * len(names), pa.large_string()), salt, np.ones(len(names), bool),
                   np.bincount(code, minlength=len(names)))
    # for the phrase that begins at each word: its hash, whether it is counted now, and whether it was before
    hashes, now, old = mix(values[number] ^ salt[code]), np.ones(n, bool), np.full(n, before is not None)
    for size in range(1, settings.longest + 1):
        place = (hashes >> np.uint64(64 - settings.bits)).astype(np.int64)
        known = within.has(place)
        at = np.flatnonzero(now & ~old)
        if len(at):
            slot, unique = pd.factorize(hashes[at])
            first = _firsts(slot, at, len(unique))
            columns = [code[at], *[number[at + k] for k in range(size)]]
            if any((c != c[np.searchsorted(at, first)][slot]).any() for c in columns):
                # two phrases of one hash: told apart by their words
                slot = np.unique(np.stack(columns), axis=1, return_inverse=True)[1].reshape(-1)
                first = _firsts(slot, at, int(slot.max()) + 1)
                unique = hashes[first]
            parts = [words.take(pa.array(number[first + k])) for k in range(size)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
            yield rows(size, code[first], phrase, unique, known[first], np.bincount(slot, minlength=len(unique)))
        held = n - size
        if size == settings.longest or held <= 0:
            return
        # one word longer: both phrases inside have to be in the set
        whole = piece[:held] == piece[size:]
        counts = now[:held] & known[:held]
        now = whole & counts & (now & known)[1:held + 1]
        if before is not None:
            was = old & before.has(place)
            old = whole & was[:held] & was[1:held + 1]
        else:
            old = np.zeros(held, bool)
        hashes = mix(hashes[:held] ^ values[number[size:]])


def _cut(batch: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """The one row of ``batch`` as several texts of about ``most`` bytes, cut where pieces end anyway."""
    data, _ = joined(batch.column("text"))
    breaks = np.flatnonzero(BREAK[data]) + 1
    wanted = np.searchsorted(breaks, np.arange(most, len(data), most))
    at = np.unique(np.r_[0, breaks[wanted[wanted < len(breaks)]], len(data)])
    texts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    return pa.RecordBatch.from_pydict({"lang": pa.array(batch.column("lang").to_pylist() * len(texts), pa.large_string()), "text": texts})


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, text) together until they hold about ``most`` bytes of text; longer texts in parts."""
    shape = pa.schema([("lang", pa.large_string()), ("text", pa.large_string())])
    held, size = [], 0
    for batch in batches:
        for part in slices(batch.cast(shape), "text", most):
            pieces = [part]
            if part.num_rows == 1 and part.column("text").nbytes > 2 * most:
                pieces = slices(_cut(part, most), "text", most)
            for piece in pieces:
                held.append(piece)
                size += piece.nbytes
                if size >= most:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _packed(made: list[Counts], parts: int) -> Iterator[dict[str, object]]:
    """The counts of a slice, a packet for each range of hashes: columns one behind the other, the texts as lines."""
    top = np.concatenate([c.hashes for c in made]) >> np.uint64(32)
    part_of = (top >> np.uint64(32 - parts.bit_length() + 1)).astype(np.int64)
    order = np.argsort(part_of, kind="stable")
    columns = [v[order] for v in (top.astype("<u4"), *(np.concatenate([getattr(c, x) for c in made]) for x in ("f", "lang", "flags")))]
    phrases = pa.chunked_array([c.phrase for c in made]).combine_chunks().take(pa.array(order))
    ends = np.searchsorted(part_of[order], np.arange(parts + 1)).tolist()
    for part, (a, b) in enumerate(zip(ends, ends[1:])):
        if a < b:
            texts = "\n".join(phrases.slice(a, b - a).to_pylist()).encode()
            yield {"part": part, "n": b - a, "langs": made[0].names,
                   "rows": zstandard.compress(b"".join([v[a:b].tobytes() for v in columns]) + texts, 3)}


class Packet:
    """The columns of a packet; texts are cut into lines only when asked for."""

    def __init__(self, n: int, langs: list[str], rows: bytes) -> None:
        raw = zstandard.decompress(rows)
        self.langs, self.top, self.f = langs, np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u4", n, 4 * n)
        self.lang, self.flags = np.frombuffer(raw, "<u4", n, 8 * n), np.frombuffer(raw, np.uint8, n, 12 * n)
        self.raw, self.n = raw, n

    def rows(self, chosen: np.ndarray, bits: int) -> dict[str, list]:
        lines = self.raw[13 * self.n:].decode().split("\n")
        return {"lang": [self.langs[i] for i in self.lang[chosen].tolist()], "size": (self.flags[chosen] >> 1).astype(np.int32),
                "phrase": [lines[i] for i in chosen.tolist()], "place": (self.top[chosen] >> (32 - bits)).astype(np.int32),
                "known": (self.flags[chosen] & 1).astype(bool), "f": self.f[chosen].astype(np.int64)}


def _by_part(finish):
    """Call ``finish(part, packets)`` for each part; its rows lie together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for part, *packet in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "langs", "rows"))):
                if part != current and held:
                    yield from finish(current, held)
                    held = []
                current = part
                held.append(Packet(*packet))
        if held:
            yield from finish(current, held)
    return run


def _often(packets: list[Packet], least: int) -> Iterator[np.ndarray]:
    """For each packet whether the hash of a row occurs ``least`` times in all of them: a phrase can not have more."""
    top = np.concatenate([p.top for p in packets])
    slot, unique = pd.factorize(top)
    enough = (np.bincount(slot, np.concatenate([p.f for p in packets]), len(unique)) >= least)[slot]
    return np.split(enough, np.cumsum([p.n for p in packets])[:-1])


def _summed(settings: Settings):
    """Exact counts of the phrases of each part from ``least`` on, and of size 0; other texts are not even cut."""
    def finish(part: int, packets: list[Packet]) -> Iterator[pa.RecordBatch]:
        tables = []
        for packet, often in zip(packets, _often(packets, settings.least)):
            chosen = np.flatnonzero(often | (packet.flags < 2))
            if len(chosen):
                tables.append(pa.table(packet.rows(chosen, settings.bits), schema=PHRASE))
        if not tables:
            return
        sums = pa.concat_tables(tables).group_by(["lang", "size", "phrase", "place", "known"], use_threads=False).aggregate([("f", "sum")])
        sums = sums.filter(pc.or_(pc.greater_equal(sums["f_sum"], settings.least), pc.equal(sums["size"], 0)))
        yield from sums.rename_columns(PHRASE.names).combine_chunks().to_batches(max_chunksize=1 << 16)

    return _by_part(finish)


def _proposals(settings: Settings, parts: int):
    """The stretch of the bitmap that each part's hashes lie in, with the phrases found ``proposed`` times."""
    def finish(part: int, packets: list[Packet]) -> Iterator[pa.RecordBatch]:
        bits, first = np.zeros((1 << settings.bits - 3) // parts, np.uint8), part * ((1 << settings.bits) // parts)
        for packet, often in zip(packets, _often(packets, settings.proposed)):
            size = packet.flags >> 1
            place = (packet.top[often & (size > 0) & (size < settings.longest)] >> (32 - settings.bits)).astype(np.int64) - first
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([zstandard.compress(bits.tobytes())], pa.binary())})

    return _by_part(finish)


def _packets(texts: DataFrame, within: bytes | None, before: bytes | None, settings: Settings, parts: int) -> DataFrame:
    """Counts of the phrases of ``texts`` (lang, text) that a pass under ``within`` adds; the packets of a part together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = Everything() if within is None else Bitmap.unpacked(within)
        earlier = None if before is None else Bitmap.unpacked(before)
        for part in gathered(batches, settings.slice_bytes):
            made = list(counted(part.column("text"), part.column("lang").to_pylist(), inside, earlier, settings))
            held = []
            for packet in _packed(made, parts) if made else ():
                held.append(packet)
                if len(held) == 32:
                    yield pa.RecordBatch.from_pylist(held, PACKET)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, PACKET)

    packets = texts.mapInArrow(run, "part int, n int, langs array<string>, rows binary")
    return packets.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")


def _with_places(rows: DataFrame, have: np.ndarray) -> np.ndarray:
    """The bitmap ``have`` with the places of ``rows``; it comes to the driver as bitmaps of fixed total size."""
    place = F.col("place").cast("long") + 1
    bits = rows.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = have.copy()
    for row in bits.collect():
        part = np.frombuffer(row["bits"], np.uint8)
        start = (row["b"] - 1) * 4096
        out[start:start + 4096] |= part[:len(out) - start]
    return out


def frequent(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, int]:
    """All phrases with at least ``least`` occurrences (lang, size, phrase, f), and the number of full passes.

    Rows of size 0 hold the number of words of a language. Each pass is written to the shared folder.
    """
    spark = docs.sparkSession
    chosen = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(settings.sampled)) == 0
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)).alias("lang"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"), chosen.alias("chosen"))
    sample, texts = texts.filter("chosen").drop("chosen"), texts.drop("chosen")
    shorter = F.col("size").between(1, settings.longest - 1)
    # ranges of hashes, a power of two of them, at least one for each shuffle partition
    parts = min(1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), 1 << settings.bits - 3)
    bits = np.zeros(1 << settings.bits - 3, np.uint8)
    stretch = len(bits) // parts
    for row in _packets(sample, None, None, settings, parts).mapInArrow(_proposals(settings, parts), "part int, bits binary").collect():
        bits[row["part"] * stretch:(row["part"] + 1) * stretch] = np.frombuffer(zstandard.decompress(row["bits"]), np.uint8)
    found, before, passes = None, None, 0
    while True:
        within = zstandard.compress(bits.tobytes())
        rows = _packets(texts, within, before, settings, parts).mapInArrow(
            _summed(settings), "lang string, size int, phrase string, place int, known boolean, f long")
        rows, _ = write_stage(rows)
        found, passes = rows if found is None else found.unionByName(rows), passes + 1
        failures = rows.filter(shorter & ~F.col("known"))
        if failures.isEmpty():
            return found.select("lang", "size", "phrase", "f"), passes
        bits, before = _with_places(failures, bits), within


def _part(first, length):
    return F.array_join(F.slice("words", first, length), " ")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Reads doc_id, text and lang (null: ``und``); a null text is empty; every row counts, repeated ones too. Ties go by
    frequency, then by the bytes of the phrase, so a rerun gives the same rows. No frequent phrase, no rows. Products
    are exact up to 10^15 occurrences. Memory is bounded by the slice, save for a piece without a break that is longer.
    """
    spark = docs.sparkSession
    every, _ = frequent(docs, settings)
    counts = every.filter("size > 0").select("lang", "size", "phrase", "f")
    totals = every.filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    longer = counts.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = longer.select("lang", "phrase", "size", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"),
                       _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    side = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    exact = F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000BD) "
                   "div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    # the most frequent longer phrase around each phrase
    around = longer.filter("size > 2").select(
        "lang", "f", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    around = around.select("lang", "f", "words", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i"))
    around = around.select("lang", "f", _part(F.col("i"), F.col("k")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("_around"))
    left = (lowest.join(around, ["lang", "phrase"], "left")
            .filter(F.col("_around").isNull() | (100 * F.col("_around") < settings.inside * F.col("a")))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    # the best of each share of a language first, so that no task ranks a whole language
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = left.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*best)))
    some = some.filter(F.col("_rank") <= settings.top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    # one row a language
    return (ranked.filter(F.col("rank") <= settings.top).join(F.broadcast(totals), "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT row, lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
grams AS (SELECT lang, n AS size, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS phrase
          FROM (SELECT lang, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS l(n) WHERE len(ws) >= n)),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE size = 1 GROUP BY ALL),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, ws, unnest(range(1, size)) AS k FROM c),
sides AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM cuts),
heads AS MATERIALIZED (SELECT s.*, f.f AS l FROM sides s JOIN f ON f.lang = s.lang AND f.phrase = s.head),
scored AS (SELECT h.lang, h.phrase, a, k, l, f.f AS r, (1000000::HUGEINT * a * a) // (l * f.f) AS score
           FROM heads h JOIN f ON f.lang = h.lang AND f.phrase = h.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(a) AS a FROM (
             SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE size = 3
             UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN around USING (lang, phrase) WHERE around.a IS NULL OR 100 * around.a < 50 * lowest.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
