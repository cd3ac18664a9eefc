"""Near-duplicates by the similarity of word shingles: prefixes of ordered shingle sets meet, exact similarities confirm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import word_hashes
from .common import broadcast_if_small, looked_up, per_text, slices, superseded, written
from .components import components
from .decontaminate import grams
from .simhash import fingerprints_of, labelled, links

#: Words of a shingle, and the least Jaccard similarity of near-duplicates' sets of shingles.
SHINGLE, SIMILAR = 5, 0.8
#: About so many rows are sampled for shingles that many texts share. They come last in the order, which saves work only:
#: any order that is the same for all texts finds all pairs.
SAMPLE_ROWS, HEAVY, HEAVY_MOST = 20_000, 5, 200_000
#: Shingles of texts that a task remembers while it compares pairs.
REMEMBERED = 4_000_000
#: Bits of a set's sketch.
BITS = 512
#: Turns in which the sets that meet are compared with one of them.
LEADERS = 3
#: Of a set's first shingles, so many tell whether two sets have met before.
FIRST = 8


def shingles_of(texts: list, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of UTF-8 texts; a shorter text is one shingle."""
    words = word_hashes([(t or b"").lower() for t in texts])
    return [np.unique(grams(w, min(shingle, len(w)))).view(np.int64) if len(w) else np.zeros(0, np.int64) for w in words]


def _node(shingles: np.ndarray) -> int:
    """A digest of a set of shingles; 0 if it is empty."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else 0


def _prefix(shingles: np.ndarray, heavy: np.ndarray, similar: float) -> np.ndarray:
    """The first shingles, of which similar sets share one: all but the share that must be common, and one."""
    n = len(shingles)
    rank = heavy[np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)] == shingles if len(heavy) else np.zeros(n, bool)
    order = np.argsort(rank, kind="stable")
    return shingles[order[: n - int(np.ceil(similar * n - 1e-9)) + 1]] if n else shingles


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of BITS shares of all shingles, whether the set has an odd number of them.

    Sketches of two sets differ in no more bits than there are shingles in only one of the sets.
    """
    share = (shingles.view(np.uint64) >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(share, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def _heavy(docs: DataFrame, text: str) -> np.ndarray:
    t = F.col(f"`{text}`")
    share = max(1, docs.count() // SAMPLE_ROWS)
    some = docs.filter(F.pmod(F.xxhash64(t.cast("string")), F.lit(share)) == 0).select(t.alias("__t"))
    each = per_text(some, "s array<long>", lambda: lambda texts: (shingles_of(texts),), (), "__t")
    shared = each.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= HEAVY)
    return np.sort(np.array([r["s"] for r in shared.orderBy(F.desc("n"), "s").limit(HEAVY_MOST).collect()], np.int64))


def _could(n: str, m: str, p: str, q: str, similar: float) -> Column:
    """Whether sets of n and m shingles that meet at places p and q, the first that they share, can be similar at all."""
    n, m, p, q = map(F.col, (n, m, p, q))
    most = F.least(n - p, m - q)
    return (F.least(n, m) >= F.greatest(n, m) * similar - 1e-9) & (most * (1 + similar) >= (n + m) * similar - 1e-6)


def _alike(n: str, m: str, x: str, y: str, similar: float) -> Column:
    """Whether sets of n and m shingles with sketches x and y can be similar; similar sets always can."""
    x, y = F.col(x), F.col(y)
    different = sum(F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64))
    return different * (1 + similar) <= (F.col(n) + F.col(m)) * (1 - similar) + 1e-6


def _first_met() -> Column:
    """Whether sets that meet at places p and _p share none of the FIRST shingles of either before; so at their first meeting.

    Of those that share none among these, further meetings count as first ones too: a pair may come again, none is lost.
    """
    before = [F.slice(lead, F.lit(1), F.least(F.col(p).cast("int"), F.lit(FIRST))) for lead, p in (("lead", "p"), ("_lead", "_p"))]
    return ~F.arrays_overlap(*before)


def _sketched(pairs: DataFrame, sketches: DataFrame, similar: float) -> DataFrame:
    """Of pairs (a, b), those whose sketches leave it open; sketches: (node, n, sketch).

    They are dealt by both ends: most pairs of a large group have its leader as one end.
    """
    left, right = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"x{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").filter(_alike("na", "nb", "xa", "xb", similar)).select("a", "b").repartition("a", "b")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the numbers of x are in y; both are sorted as unsigned numbers, see shingles_of()."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)) if len(y) else 0


def _confirmed(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Of pairs (a, b), those whose texts are similar; texts: (node, z)."""
    left, right = (texts.select(F.col("node").alias(x), F.col("z").alias(f"z{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, sets, size = zstandard.ZstdDecompressor().decompress, {}, 0
        for batch in batches:
            for part in slices(batch, 2, 256):
                a, b = (part.column(i).to_pylist() for i in (0, 1))
                if size > REMEMBERED:
                    sets, size = {}, 0
                new = {x: i for k, nodes in enumerate((a, b)) for i, x in enumerate(nodes, k * part.num_rows) if x not in sets}
                at = [(2 + i // part.num_rows, i % part.num_rows) for i in new.values()]
                made = dict(zip(new, shingles_of([unpack(part.column(c)[i].as_py()) for c, i in at]), strict=True))
                size += sum(map(len, made.values()))
                sets |= made
                shared = [_common(sets[x], sets[y]) for x, y in zip(a, b, strict=True)]
                near = [c >= (len(sets[x]) + len(sets[y]) - c) * similar - 1e-9 for x, y, c in zip(a, b, shared, strict=True)]
                yield part.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _unconnected(named: DataFrame, known: DataFrame) -> DataFrame:
    """named (s, node, n, p, root) with roots by the pairs known; only shingles whose sets aren't all connected.

    The table that named is read from is deleted: nothing reads it again.
    """
    roots = components(known)
    labels = roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    before = named
    named = named.join(labels, named["node"] == labels["__n"], "left").withColumn("root", F.coalesce("__r", "root")).drop("__n", "__r")
    named = written(named)
    superseded(before)
    superseded(roots)
    groups = named.groupBy("s").agg(F.count("*").alias("k"), F.min("root").alias("low"), F.max("root").alias("high"))
    left = written(looked_up(named, written(groups.filter("low <> high").select("s", "k")), ["s"], "k"))
    superseded(named)
    return left


def _left(mixed: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b), some more than once, of sets with different roots that meet in mixed and may be similar.

    mixed: (s, node, n, p, root, first, sketch, lead), first being the root of one set of those that meet at s.
    """
    others = mixed.filter("root <> first").drop("first")
    every = mixed.select("s", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "p", "root", "sketch", "lead")])
    open_ = _could("n", "_n", "p", "_p", similar) & _alike("n", "_n", "sketch", "_sketch", similar) & _first_met()
    return others.join(every, "s").filter("root <> _root").filter(open_).select(*_pair("node", "_node"))


def similar_pairs(docs: DataFrame, prints: DataFrame, text: str, similar: float = SIMILAR) -> DataFrame:
    """(a, b): pairs of sets of shingles, by their digests, that connect the same sets as all pairs of that similarity.

    Sets meet at each shingle that their prefixes share, and are compared if sizes, places and sketches leave it open
    whether they are similar. First all that meet somewhere are compared with one of them, the
    leader, so a group of copies of one text is connected by as many pairs as it has members. The first turn's leaders
    come in one order for all shingles, later ones in an order of each shingle's own: a group that meets at many shingles
    has many leaders, so chains of similar texts are connected as well, by no more pairs than there are meetings. From the
    second turn on, shingles whose sets are all connected are done, and connected sets aren't compared. Then only pairs that
    aren't connected yet are compared: those of a set outside its leader's component with all others in its group. Such
    sets often share many shingles; their pair is taken where they meet first, not at each.
    """
    nodes = prints.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "sketch")])
    sketches = written(nodes.select("node", "n", "sketch", F.slice("prefix", 1, FIRST).alias("lead")))
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("p", "s"))
    shared = rows.groupBy("s").agg(F.count("*").alias("__times")).filter("__times > 1").select("s")
    met = written(rows.join(shared.hint("shuffle_hash"), "s"))
    wanted = written(met.select(F.col("node").alias("__w")).distinct())

    def make():
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        return lambda texts: ([_node(s) for s in shingles_of(texts)], [squeeze(t or b"") for t in texts])

    texts = per_text(docs, "node long, z binary", make, (), text)
    texts = texts.join(broadcast_if_small(wanted), texts["node"] == F.col("__w"), "left_semi")
    texts = written(texts.dropDuplicates(["node"]))
    tried, edges, named = [], [], met.withColumn("root", F.col("node"))
    for turn in range(LEADERS):
        by = F.xxhash64("node", F.col("s") if turn else F.lit(0), F.lit(turn))
        leaders = written(named.groupBy("s").agg(*[F.min_by(c, by).alias(f"_{c}") for c in ("node", "n", "p", "root")], F.count("*").alias("k")))
        found = looked_up(named, leaders, ["s"], "k").filter("root <> _root").filter(_could("n", "_n", "p", "_p", similar))
        found = _sketched(found.select(*_pair("node", "_node")).distinct(), sketches, similar)
        tried.append(written(reduce(lambda x, y: x.join(y, ["a", "b"], "left_anti"), tried, found)))
        superseded(leaders)
        edges.append(written(_confirmed(tried[-1], texts, similar)))
        if turn:
            named = _unconnected(named, reduce(DataFrame.unionByName, edges))
    known, seen = (reduce(DataFrame.unionByName, x) for x in (edges, tried))
    groups = named.groupBy("s").agg(F.min_by("root", F.xxhash64("node", F.lit(0))).alias("first"), F.count("*").alias("k"))
    mixed = looked_up(named, written(groups), ["s"], "k")
    mixed = written(mixed.join(sketches.select(F.col("node").alias("__n"), "sketch", "lead"), F.col("node") == F.col("__n")).drop("__n"))
    rest = written(_left(mixed, similar).distinct().join(seen, ["a", "b"], "left_anti"))
    return known.unionByName(written(_confirmed(rest, texts, similar)))


def near_duplicates(docs: DataFrame, text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, fp, component_id) for each document, as simhash.near_duplicates, with similar texts linked as well.

    Texts are linked if their fingerprints are, or if their sets of SHINGLE words' shingles have a Jaccard similarity of
    similar or more; every such pair is found. Odd cases are as in simhash.near_duplicates.
    """
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy(docs, text))

    def make():
        def work(texts: list) -> tuple[list, ...]:
            sets = shingles_of(texts)
            return fingerprints_of(texts), [_node(s) for s in sets], [len(s) for s in sets], [_prefix(s, heavy.value, similar) for s in sets], [_sketch(s) for s in sets]

        return work

    prints = written(per_text(docs, "fp long, node long, n long, prefix array<long>, sketch array<long>", make, ("doc_id",), text))
    ids = prints.select("doc_id", "fp", "node")
    edges = links(ids.select("fp").distinct()).unionByName(similar_pairs(docs, prints, text, similar))
    edges = edges.unionByName(ids.select(F.col("fp").alias("a"), F.col("node").alias("b")).distinct())
    return labelled(ids.select("doc_id", "fp"), edges)
