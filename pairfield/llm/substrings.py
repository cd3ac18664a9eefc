"""Exact repeated passages: every window of words that also starts earlier in the corpus is removed.

A place is a row's doc_id (null ids last) and a digest of its text, so rows that share an id stay apart. Later copies of
whole documents go by a digest of their words. For the rest, anchors (the least hash of each window's short grams) find
windows that can recur: equal windows have equal anchors, so a window whose anchor no other place has is unique. Only
windows with a recurring anchor are compared, by 96 bits of hashes of their words, and only the first place of each
distinct one is sent back. Every grouping combines before its shuffle, and no group of equal passages is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import word_hashes
from .common import cut, looked_up, slices, table, written

WINDOW = 20
#: Words of the grams from which anchors are chosen.
GRAM = 6
#: Odd multipliers of the two hashes, fixed values; of the second, the upper 32 bits are used.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes below which a text can't have a window.
LEAST_BYTES = 2 * WINDOW - 1
#: Anchors that so many of a sample of documents have, of about so many, count as recurring unseen. A wrong guess costs a
#: comparison of windows, nothing else. The others are in too few documents for their groups to be large.
SAMPLE_ROWS, HEAVY, HEAVY_MOST = 50_000, 25, 400_000
#: Documents that are worked on at once, if they aren't long.
SLICE = 256


def _mix(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    x = a * np.uint64(by) + b
    return x ^ (x >> np.uint64(31))


def runs(ids: np.ndarray, n: int, by: int = MULTIPLIERS[0]) -> np.ndarray:
    """Hashes of all runs of n words, put together from runs of powers of two."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, at = ids, 1, None, 0
    while True:
        if n & size:
            part = power[at : at + count]
            out, at = (part if out is None else _mix(out, part, by ^ 0x5555)), at + size
        if size * 2 > n:
            return _mix(out, out >> np.uint64(17), by)
        power, size = _mix(power[:-size], power[size:], by), size * 2


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each run of n values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x, have = op(x[:-step], x[step:]), have + step
    return x


def anchors(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor, and all anchors of the document, one for each place in order of hash."""
    grams = runs(ids, GRAM)
    width = WINDOW - GRAM + 1
    least = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    chosen = _sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams
    return least, np.sort(grams[chosen])


def _marked(least: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(least), bool)
    return values[np.minimum(np.searchsorted(values, least), len(values) - 1)] == least


#: What tells places apart, in their order.
PLACE = ("none", "doc", "tag")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(none, doc, tag, t): each row's place and text."""
    kind = docs.schema["doc_id"].dataType
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    place = F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit("0").cast(kind)).alias("doc"), F.xxhash64(t).alias("tag")
    return docs.select(*place, t.alias("t"))


def _fields(keyed: DataFrame, more: str) -> str:
    return ", ".join([*(f"{k} {keyed.schema[k].dataType.simpleString()}" for k in PLACE), more])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, len(PLACE), SLICE)


def _taken(part: pa.RecordBatch, rows: np.ndarray, more: dict[str, pa.Array]) -> pa.RecordBatch:
    """Places of those rows with further columns."""
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(len(PLACE))), *more.values()], names=[*PLACE, *more])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _numbers(values: pa.Scalar) -> np.ndarray:
    """A list of longs as sorted unsigned numbers; a null list is empty."""
    return np.sort(values.values.to_numpy(zero_copy_only=False).view(np.uint64)) if values.is_valid else np.zeros(0, np.uint64)


def _packed(keyed: DataFrame) -> DataFrame:
    """The places with z, texts compressed for a shuffle by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part in _slices(batches):
            yield _taken(part, np.arange(part.num_rows), {"z": pa.array([squeeze(t) for t in part.column(3).to_pylist()], pa.binary())})

    return keyed.mapInArrow(run, _fields(keyed, "z binary"))


def _anchored(keyed: DataFrame) -> DataFrame:
    """Places with their distinct anchors, those of them that a document has at several places itself (own), and a digest of
    its words (d1, d2); for documents of a window at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            rows, found, digests = [], [], []
            for i, ids in enumerate(word_hashes(part.column(3).to_pylist())):
                if len(ids) >= WINDOW:
                    every = anchors(ids)[1]
                    again = every[1:] == every[:-1]
                    rows.append(i)
                    found.append((every[np.append(True, ~again)], np.unique(every[1:][again])))
                    digests.append(hashlib.blake2b(ids.tobytes(), digest_size=16).digest())
            if rows:
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                more = {"anchors": _lists([f[0] for f in found]), "own": _lists([f[1] for f in found])}
                yield _taken(part, np.array(rows), more | {f"d{i + 1}": pa.array(np.ascontiguousarray(d[:, i])) for i in (0, 1)})

    return keyed.mapInArrow(run, _fields(keyed, "anchors array<long>, own array<long>, d1 long, d2 long"))


def _window_rows(packed: DataFrame) -> DataFrame:
    """The places with h1, h2: each distinct window of a place that can recur, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for part in _slices(batches):
            part = part.filter(pc.is_valid(part.column(4)))
            if not part.num_rows:
                continue
            rows, one, two = [], [], []
            for i, (ids, more) in enumerate(zip(word_hashes([unpack(z) for z in part.column(3).to_pylist()]), part.column(4), strict=True)):
                if len(ids) < WINDOW:
                    continue
                mark = _marked(anchors(ids)[0], _numbers(more))
                h1, h2 = (runs(ids, WINDOW, by)[mark] for by in MULTIPLIERS)
                first = np.unique(h1, return_index=True)[1]
                rows.append(np.full(len(first), i))
                one.append(h1[first].view(np.int64))
                two.append((h2[first] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            if rows:
                yield _taken(part, np.concatenate(rows), {"h1": pa.array(np.concatenate(one)), "h2": pa.array(np.concatenate(two))})

    return packed.select(*PLACE, "z", "recurring").mapInArrow(run, _fields(packed, "h1 long, h2 int"))


def covered(ids: np.ndarray, recurring: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Marks the words in windows that start earlier too. firsts: hashes of windows whose first document this one is."""
    out = np.zeros(len(ids), bool)
    if len(ids) < WINDOW or not len(recurring):
        return out
    at = np.flatnonzero(_marked(anchors(ids)[0], recurring))
    h1 = runs(ids, WINDOW)[at]
    first_here = np.zeros(len(at), bool)
    first_here[np.unique(h1, return_index=True)[1]] = True
    repeated = at[~(first_here & _marked(h1, firsts))]
    ends = np.zeros(len(ids) + 1, np.int64)
    np.add.at(ends, repeated, 1)
    np.add.at(ends, repeated + WINDOW, -1)
    return np.cumsum(ends[:-1]) > 0


def _heavy(anchored: DataFrame) -> DataFrame:
    """Anchors that many documents share, by a sample of places; their number is bounded, so they are broadcast."""
    share = max(1, anchored.count() // SAMPLE_ROWS)
    some = anchored.filter(F.pmod("tag", F.lit(share)) == 0).select(F.explode("anchors").alias("anchor"))
    often = some.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= HEAVY)
    return F.broadcast(cut(often.orderBy(F.desc("n"), "anchor").limit(HEAVY_MOST).select("anchor")))


def _recurring(anchored: DataFrame) -> DataFrame:
    """The places with the anchors that other places have too, or that they have several times themselves."""
    heavy, pairs = _heavy(anchored), anchored.select(*PLACE, F.explode("anchors").alias("anchor"))
    rest = pairs.join(heavy, "anchor", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("anchor")))
    met = pairs.join(heavy, "anchor", "left_semi").select(*PLACE, "anchor").unionByName(rest.filter("n > 1").drop("n"))
    return met.unionByName(anchored.select(*PLACE, F.explode("own").alias("anchor"))).groupBy(*PLACE).agg(F.collect_set("anchor").alias("recurring"))


def _later(anchored: DataFrame) -> DataFrame:
    """The places of documents whose words an earlier place has, all of them in order."""
    place = F.struct(*PLACE)
    originals = cut(anchored.groupBy("d1", "d2").agg(F.min(place).alias("__first"), F.count("*").alias("n")).filter("n > 1"))
    copies = looked_up(anchored.select(*PLACE, "d1", "d2"), originals, ["d1", "d2"])
    return copies.filter(place > F.col("__first")).select(*PLACE).distinct().withColumn("later", F.lit(True))


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text of the remaining words, joined by one space.

    A null or empty text has no words. Of equal windows, the one of the smallest doc_id stays, in a document the first; a
    null doc_id comes after all others. Rows that share a doc_id, or have none, are places of their own if their texts
    differ, in an order that a hash of the texts gives; rows equal in doc_id and text are one place and get the same
    result. Ids may be of any type that has an order. Other columns are ignored; an empty table gives an empty result.
    What is gathered of a place is in proportion to its own text; nothing else is.
    """
    keyed = _keyed(docs, text)
    short = F.octet_length("t") < LEAST_BYTES  # has no window: needs no shuffle
    long = keyed.filter(~short)
    anchored = written(_anchored(long))
    marks = _recurring(anchored).join(_later(anchored), [*PLACE], "full_outer")
    marks = cut(marks.select(*PLACE, F.when(F.col("later").isNull(), F.col("recurring")).alias("recurring"), "later"))
    packed = _packed(long).join(marks, [*PLACE], "left")  # both uses share one shuffle of the texts
    first = _window_rows(packed).groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("p"))
    firsts = first.groupBy(*[F.col(f"p.{k}").alias(k) for k in PLACE]).agg(F.collect_list("h1").alias("firsts"))
    joined = packed.join(firsts, [*PLACE], "left").select(*PLACE, "z", "recurring", "later", "firsts")

    def judged(plain: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            unpack = bytes if plain else zstandard.ZstdDecompressor().decompress
            for part in _slices(batches):
                texts = [unpack(z) for z in part.column(3).to_pylist()]
                some = [] if plain else [i for i, r in enumerate(part.column(4)) if r.is_valid]
                ids = dict(zip(some, word_hashes([texts[i] for i in some]), strict=True)) if some else {}
                n, gone, kept = [], [], []
                for i, t in enumerate(texts):
                    words = t.split()
                    n.append(len(words))
                    if not plain and part.column(5)[i].is_valid:
                        gone.append(len(words))
                        kept.append("")
                        continue
                    drop = covered(ids[i], _numbers(part.column(4)[i]), _numbers(part.column(6)[i])) if i in ids else None
                    gone.append(0 if drop is None else int(drop.sum()))
                    kept.append(b" ".join(compress(words, (~drop).tolist()) if gone[-1] else words).decode())
                yield _taken(part, np.arange(part.num_rows), {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())})

        return run

    schema = _fields(keyed, "n_words long, n_removed long, kept string")
    made = joined.mapInArrow(judged(False), schema).unionByName(keyed.filter(short).mapInArrow(judged(True), schema))
    return made.select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for op5_substrings.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest(range(0, {WINDOW})) AS j)),
k AS (SELECT d.doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM d),
s AS (SELECT k.doc_id, count(x.i) AS gone, coalesce(string_agg(t, ' ' ORDER BY k.i) FILTER (x.i IS NULL), '') AS kept
  FROM k LEFT JOIN x ON k.doc_id = x.doc_id AND k.i = x.i GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
