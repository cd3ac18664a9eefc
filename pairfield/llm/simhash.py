"""SimHash near-duplicates: fingerprints, pigeonring candidate filter, exact links, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, per_text, superseded, table, written
from .components import components

SHINGLE = 3
BITS = 64
MAX_DIFFERENT = 2
XX_SEED = 42
#: Segments of the ring, of four or five bits.
SEGMENTS = 15
#: Members up to which a bucket is compared pair by pair. Buckets have 29 bits or 30, so chance alone fills one with 20
#: members only at ten thousand million fingerprints; larger ones hold texts from one mould and take the way of links().
BUCKET = 128
#: Where each segment begins, and the end of the ring.
LOW = [i * BITS // SEGMENTS for i in range(SEGMENTS + 1)]
#: For each number of different bits, the longest chain of segments that may have no more: l segments may differ in
#: l / SEGMENTS of MAX_DIFFERENT bits.
CHAINS = [max(n for n in range(1, SEGMENTS + 1) if n * MAX_DIFFERENT // SEGMENTS == d) for d in range(MAX_DIFFERENT + 1)]


def fingerprints_of(texts: list, shingle: int = SHINGLE) -> list[int]:
    """Signed 64-bit fingerprints of UTF-8 texts; 0 where there is no word."""
    import xxhash

    digest, out = xxhash.xxh64_intdigest, []
    for text in texts:
        words = (text or b"").lower().split()
        if not words:
            out.append(0)
            continue
        if len(words) < shingle:
            grams = [b" ".join(words)]
        else:
            grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
        hashes = np.fromiter((digest(g, XX_SEED) for g in grams), np.uint64, len(grams))
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * ones > len(hashes), bitorder="little")
        out.append(int(bits.view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return per_text(docs, "fp long", lambda: lambda texts: (fingerprints_of(texts),), keys, text)


def chain_bits(start: int, length: int) -> int:
    """The bits of so many consecutive segments of the ring, from one on."""
    return sum(1 << b for i in range(start, start + length) for b in range(LOW[i % SEGMENTS], LOW[i % SEGMENTS + 1]))


def _signed(bits: int) -> Column:
    return F.lit(bits - (1 << BITS) if bits >> (BITS - 1) else bits).cast("long")


def _buckets(fp: Column) -> Column:
    """For each start, the bits of the chain that must be equal; which bits they are is told by the start."""
    equal = [fp.bitwiseAND(_signed(chain_bits(i, CHAINS[0]))) for i in range(SEGMENTS)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), bits.alias("s")) for i, bits in enumerate(equal)]))


def viable(a: Column, b: Column, start: Column) -> Column:
    """The pigeonring condition: no chain of the ring from start on differs in more than its share of MAX_DIFFERENT bits.

    Differences add up along a chain, so the longest one of each budget speaks for the shorter ones.
    """
    different, holds = a.bitwiseXOR(b), F.lit(True)
    for budget, length in enumerate(CHAINS):
        bits = F.get(F.array(*[_signed(chain_bits(i, length)) for i in range(SEGMENTS)]), start)
        holds = holds & (F.bit_count(different.bitwiseAND(bits)) <= budget)
    return holds


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints whose components are those of all pairs within MAX_DIFFERENT bits.

    distinct: a column fp of distinct fingerprints. Of two that link, one chain of the ring has no more differences than
    its share, from its start on: its first CHAINS[0] segments are equal. Fingerprints meet in buckets of such segments;
    pairs go on to the Hamming check if the whole chain is viable. Buckets are as wide as differences allow, so they stay
    small however many fingerprints there are. Members of buckets of more than BUCKET link through every value
    within one bit of them: two fingerprints differ in two bits at most exactly if they share such a value, and at most
    BITS + 1 fingerprints share one, so no group grows with the data.
    """
    keyed = distinct.select("fp", _buckets(F.col("fp")).alias("k")).select("fp", "k.i", "k.s")
    counts = keyed.groupBy("i", "s").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(keyed.join(counts.hint("shuffle_hash"), ["i", "s"]))
    few = met.filter(F.col("n") <= BUCKET).groupBy("i", "s").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    first = few.select("i", "fps", F.posexplode("fps").alias("p", "a"))
    pairs = first.select("i", "a", F.explode(F.slice("fps", F.col("p") + 2, F.lit(BUCKET))).alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DIFFERENT
    direct = pairs.filter(viable(F.col("a"), F.col("b"), F.col("i"))).filter(close).select("a", "b")
    crowded = met.filter(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[_signed(1 << i) for i in range(BITS)])
    near = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    star = near.groupBy("v").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    star = star.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return direct.unionByName(star).distinct()


def labelled(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of prints (doc_id, fp) whose fingerprints are linked by edges.

    A fingerprint that very many rows have is looked up by a broadcast, see looked_up().
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = components(edges)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = written(named)
    superseded(roots)
    smallest = written(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    linked = written(looked_up(named, smallest, ["root"], "members").select("fp", "n", "component_id"))
    superseded(named)
    superseded(smallest)
    return looked_up(prints, linked, ["fp"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each document; component_id is the smallest doc_id reachable, itself included.

    A text without words (null, empty or white space only) has fingerprint 0, which links like any other. Equal
    fingerprints are one node, so copies cost one row each however many there are. Rows repeated with the same doc_id
    give a row each; a null doc_id gets the component of its fingerprint but never names one, unless no other member
    has an id. An empty table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(docs, text))
    return labelled(prints, links(prints.select("fp").distinct()))


def one_of_each(docs: DataFrame, text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """The documents that name their component: one row of each group stays, with all columns of docs.

    Of rows equal in doc_id and text, one stays. Rows with a null doc_id stay only where their group has no id at all,
    and then one of each fingerprint. Texts are shuffled once, by id, for both steps. found: the components, if they
    aren't those of near_duplicates().
    """
    found = near_duplicates(docs, text) if found is None else found
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.join(keep, docs["doc_id"] == keep["__id"], "left_semi")
    same = Window.partitionBy("doc_id", text).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", text)] or [F.lit(0)])
    named = named.withColumn("__first", F.row_number().over(same)).filter("__first = 1").drop("__first")
    unnamed = found.filter("doc_id IS NULL AND component_id IS NULL").select(F.col("fp").alias("__lone")).distinct()
    rest = per_text(docs.filter("doc_id IS NULL"), "__fp long", lambda: lambda texts: (fingerprints_of(texts),), tuple(docs.columns), text)
    rest = rest.join(unnamed, rest["__fp"] == unnamed["__lone"], "left_semi").dropDuplicates(["__fp"])
    return named.unionByName(rest.select(docs.columns))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
