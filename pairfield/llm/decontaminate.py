"""Benchmark decontamination: counts of shared n-grams join documents to test items, Smith-Waterman alignment scores the copies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from .arrays import NOT_ALNUM, word_hashes
from .common import rows_where, slices, table

#: Seeds that more items than this share are left out, as far as no copy can be missed for it.
COMMON = 64
#: Items with fewer words match too much by chance to be aligned: all their words must follow each other in a document.
LEAST_WORDS = 5
#: Scripts that don't part words by spaces, of which each character is a word, and their punctuation, which parts words.
UNSPACED = re.compile(
    "[\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3031-\u3035\u303b-\u303c\u3041-\u3096\u3099-\u309f\u30a1-\u30fa\u30fc-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf"
    "\u4e00-\ua4cf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b2ff\U00020000-\U0003ffff"
    "\u0e01-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\ua980-\ua9ff\uaa60-\uaa7f]"
)
UNSPACED_GAPS = re.compile("[\u0e2f\u0e5a\u0e5b\u0f0b-\u0f14\u104a\u104b\u17d4-\u17da\u3000-\u3004\u3008-\u3020\u3030\u303d\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
MATCH, MISMATCH, GAP = 2, -1, -1
#: A document is contaminated by an item if its best alignment reaches this share of a full match. A copy in which one
#: word in five was substituted reaches 0.7.
THRESHOLD = 0.6
#: Items that are searched at once; more are searched block by block.
BLOCK_ITEMS = 20_000
#: Documents that are worked on at once, if they aren't long.
SLICE = 256
#: Words of a document that are aligned at once, unless an item is that long; parts overlap by what an alignment can span.
STRETCH = 1 << 15


def _parted(text: str) -> str:
    """A text with spaces around each character of scripts without them."""
    return text if text.isascii() else UNSPACED.sub(r" \g<0> ", UNSPACED_GAPS.sub(" ", text))


def words_of(texts: list) -> list[np.ndarray]:
    """Hashes of the words of UTF-8 texts, in lower case; all but letters, digits and what isn't ASCII parts words.

    In scripts without spaces each character is a word.
    """
    return word_hashes([_parted((t or b"").decode("utf-8", "replace").lower()).encode() for t in texts], NOT_ALNUM)


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = ids[: len(ids) - n + 1].copy()
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - n + 1 + i]
    return out ^ (out >> np.uint64(31))


class Lookup:
    """A sorted set of hashes behind a bit filter of fixed size, for looking up many at once."""

    def __init__(self, values: np.ndarray, bits: int = 21):
        self.values, self.shift = np.unique(values), np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.values >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that are in the set, and their places in the set."""
        at = np.flatnonzero(self.filter[(hashes >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        spot = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        hit = self.values[spot] == hashes[at]
        return at[hit], spot[hit]


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: the best score, and where in part it begins and ends.

    Row by row over the item; along a row, gaps are a running maximum, so each row is a few array operations.
    """
    n = len(part)
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    ramp = -GAP * np.arange(n + 1)
    for word in item:
        fresh = np.zeros(n + 1, np.int64)
        start = np.arange(n + 1)
        diagonal = score[:-1] + np.where(part == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        take_up = up > diagonal
        value = np.where(take_up, up, diagonal)
        origin = np.where(take_up, begin[1:], begin[:-1])
        better = value > 0
        fresh[1:][better], start[1:][better] = value[better], origin[better]
        lifted = fresh + ramp
        top = np.maximum.accumulate(lifted)
        where = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        gapped = top - ramp
        use = gapped > fresh
        fresh[use], start[use] = gapped[use], start[where[use]]
        score, begin = fresh, start
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(begin[j]), j)
    return best


def _bounds(n: int, threshold: float) -> tuple[int, int, int, int]:
    """Of an alignment of n item words that reaches the threshold: least score, words of a seed, least seeds in it, most words.

    Let it match m words, with e errors. A match gives 2 and an error takes 1, so e <= 2m - score. The matches are in e + 1
    runs at most, so score - 1 - m pairs of neighbours match at least, and m <= n. Where that is none, single words are the
    seeds, of which score / 2 match. Words that only the document has are 2n - score at most.
    """
    score = max(1, int(np.ceil(MATCH * threshold * n - 1e-9)))
    pairs = score - 1 - n
    return (score, 2, pairs, 3 * n - score) if pairs > 0 else (score, 1, -(-score // 2), 3 * n - score)


class Seeds:
    """The seeds of one length and the items that have each."""

    def __init__(self, words: int, hashes: np.ndarray, owner: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.words, self.owner, self.look = words, owner[order], Lookup(hashes)
        self.first = np.searchsorted(hashes[order], self.look.values)
        self.last = np.searchsorted(hashes[order], self.look.values, "right")

    def find(self, flat: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places of their seeds in the words of documents, by item, then place."""
        at, spot = self.look.find(grams(flat, self.words))
        within = doc[at] == doc[at + self.words - 1]
        at, spot = at[within], spot[within]
        times = self.last[spot] - self.first[spot]
        row = np.repeat(self.first[spot], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        order = np.argsort(self.owner[row], kind="stable")
        return self.owner[row][order], np.repeat(at, times)[order]


class Matcher:
    """Finds the items that documents copy; every alignment that reaches the threshold is found, see _bounds().

    items: pairs of a number and words; the best copy of all items of one number is found.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.items, self.threshold = items, threshold
        bounds = [_bounds(len(ids), threshold) for _, ids in items]
        long = [len(ids) >= LEAST_WORDS for _, ids in items]
        self.score, self.need, self.span = (np.array([b[i] for b in bounds], np.int64) for i in (0, 2, 3))
        self.words = [np.unique(ids) for _, ids in items]
        self.pairs = [np.unique(grams(ids, 2)) for _, ids in items]
        self.seeds = []
        for words in (1, 2):
            mine = [k for k, b in enumerate(bounds) if long[k] and b[1] == words]
            if mine:
                self.seeds.append(self._seeds(mine, words))
        self.whole = []
        for words in range(1, LEAST_WORDS):
            mine = [k for k, (_, ids) in enumerate(items) if len(ids) == words]
            if mine:
                self.whole.append(Seeds(words, np.concatenate([grams(items[k][1], words) for k in mine]), np.array(mine)))

    def _seeds(self, mine: list[int], words: int) -> Seeds:
        """All seeds of these items. Common ones go while fewer than the least number in an alignment have gone."""
        each = [np.unique(grams(self.items[k][1], words), return_counts=True) for k in mine]
        values, shared = np.unique(np.concatenate([g for g, _ in each]), return_counts=True)
        hashes, owner = [], []
        for k, (g, places) in zip(mine, each, strict=True):
            owners, keep = shared[np.searchsorted(values, g)], np.ones(len(g), bool)
            for i in np.argsort(-owners, kind="stable"):
                if owners[i] <= COMMON or self.need[k] <= places[i]:
                    break
                keep[i] = False
                self.need[k] -= places[i]
            hashes.append(g[keep])
            owner.append(np.full(keep.sum(), k))
        return Seeds(words, np.concatenate(hashes), np.concatenate(owner))

    def __call__(self, texts: list[np.ndarray]) -> list[list[tuple[int, float, int, int]]]:
        """For each text's words, (number, share of the full score, first word, word after the last) of each item that they copy."""
        out: list[dict] = [{} for _ in texts]
        ends = np.cumsum([len(ids) for ids in texts])
        flat, doc = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(ids) for ids in texts])
        for seeds in self.seeds:
            for k, d, left, right in self._regions(seeds, flat, doc):
                begin = ends[d] - len(texts[d])
                left, right, span = max(0, left - begin), min(len(texts[d]), right - begin), int(self.span[k])
                step = max(STRETCH, 4 * span)  # an alignment lies within one part, as parts overlap by its span
                for at in range(left, max(left + 1, right - span), step - span):
                    self._judge(k, texts[d], at, min(right, at + step), out[d])
        for seeds in self.whole:
            owner, at = seeds.find(flat, doc)
            for k, a in zip(owner.tolist(), at.tolist(), strict=True):
                d, (item_id, item) = doc[a], self.items[k]
                if out[d].get(item_id, (0.0,))[0] < 1.0 and np.array_equal(flat[a : a + len(item)], item):
                    begin = a - int(ends[d] - len(texts[d]))
                    out[d][item_id] = (1.0, begin, begin + len(item))
        return [[(i, *v) for i, v in sorted(found.items())] for found in out]

    def _regions(self, seeds: Seeds, flat: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Item, document and stretch of words, wherever as many seeds as an alignment needs are as near as one can hold."""
        owner, at = seeds.find(flat, doc)
        if not len(at):
            return
        last = np.arange(len(at)) + self.need[owner] - 1
        inside = last < len(at)
        last = np.minimum(last, len(at) - 1)
        enough = np.flatnonzero(inside & (owner[last] == owner) & (doc[at[last]] == doc[at]) & (at[last] - at < self.span[owner]))
        owner, at = owner[enough], at[enough]
        apart = (owner[1:] != owner[:-1]) | (doc[at[1:]] != doc[at[:-1]]) | (at[1:] - at[:-1] > 2 * self.span[owner[1:]])
        edge = np.flatnonzero(np.r_[True, apart, True]) if len(at) else np.zeros(0, np.int64)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            k = int(owner[a])
            yield k, int(doc[at[a]]), int(at[a] - self.span[k]), int(at[b - 1] + self.span[k])

    def _judge(self, k: int, ids: np.ndarray, left: int, right: int, out: dict) -> None:
        item_id, item = self.items[k]
        part, span = ids[left:right], int(self.span[k])
        words = np.isin(part, self.words[k], kind="sort")
        pairs = np.append(np.isin(grams(part, 2), self.pairs[k], kind="sort"), False)
        most = [np.concatenate([[0], np.cumsum(hit)]) for hit in (words, pairs)]
        m, p = (total[span:] - total[:-span] if len(part) > span else total[-1:] for total in most)
        # as in _bounds(), matches and pairs of neighbours that match are score - 1 at least
        if (np.minimum(m, len(item)) + np.minimum(p, len(item) - 1)).max() < self.score[k] - 1:
            return
        score, begin, end = align(item, part)
        share = score / (MATCH * len(item))
        if share >= self.threshold and share > out.get(item_id, (0.0,))[0]:
            out[item_id] = (share, left + begin, left + end)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): items that documents contain, exactly, edited or paraphrased.

    One pass over the documents, without a shuffle: stretches that share as many seeds with an item as any alignment that
    reaches the threshold must are aligned, so the result is that of aligning every document with every item. Items go in
    blocks of a fixed number, so what is broadcast is bounded; each further block is a further pass.
    Words are compared in lower case; punctuation only parts them. Null or empty texts match nothing; of items
    of fewer than LEAST_WORDS words only exact copies count, and items without a word match nothing; characters of scripts
    without spaces are words. Ids may be of any type. Items that share an id count as one, by their best copy; items with a
    null id are each their own. Repeated rows give a row each; ties go to the earliest place. An empty table on either
    side gives an empty result; other columns are ignored.
    """
    picked = docs.select("doc_id", F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    schema = StructType([docs.schema["doc_id"], benchmark.schema["item_id"]]).add("score", "double").add("first_word", "long").add("end_word", "long")
    for f in schema.fields:
        f.nullable = True
    target, parts = to_arrow_schema(schema), []
    for shared in _searches(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, ids = shared.value
            match = Matcher(items, threshold)
            for batch in batches:
                rows, found, at = [], [], 0
                for part in slices(batch, 1, SLICE):
                    for i, hits in enumerate(match(words_of(part.column(1).to_pylist()))):
                        rows += [at + i] * len(hits)
                        found += hits
                    at += part.num_rows
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), ids.take(pa.array([h[0] for h in found], pa.int64()))]
                columns += [pa.array([h[i] for h in found]) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        parts.append(picked.mapInArrow(run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _searches(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """The blocks of items, broadcast."""
    for block in _blocks(benchmark):
        yield docs.sparkSession.sparkContext.broadcast(block)


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, np.ndarray]], pa.Array]]:
    """Blocks of BLOCK_ITEMS items, by id, streamed to the driver; each is dropped before the next. Items, and the id of
    each number."""
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    rows = benchmark.select("item_id", F.col("text").cast("string").cast("binary").alias("t")).distinct()
    items: list[tuple[int, np.ndarray]] = []
    ids: list = []
    for r in rows.orderBy("item_id", "t").toLocalIterator():
        words = words_of([r["t"]])[0]
        if not len(words):
            continue
        same = ids and r["item_id"] is not None and ids[-1] == r["item_id"]
        if not same and len(items) >= BLOCK_ITEMS:
            yield items, pa.array(ids, kind)
            items, ids = [], []
        if not same:
            ids.append(r["item_id"])
        items.append((len(ids) - 1, words))
    if items:
        yield items, pa.array(ids, kind)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns; each row is judged by its own text, in place."""
    for shared in _searches(docs, benchmark):

        def make(shared=shared):
            match = Matcher(shared.value[0], threshold)
            return lambda texts: [not hits for hits in match(words_of(texts))]

        docs = rows_where(docs, make, text)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
