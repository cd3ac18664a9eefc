"""Spans that documents share with a bounded reference: suffix automata of its shards, broadcast one after another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import word_hashes
from .common import per_text

#: Words of a shard; its automaton has at most twice as many states.
SHARD_WORDS = 500_000


class SuffixAutomaton:
    """All runs of words of a few texts; texts are set apart by marks that no document has."""

    def __init__(self, texts: list[np.ndarray]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for mark, ids in enumerate(texts):
            for word in [*ids.tolist(), -1 - mark]:
                last = self._extend(last, word)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            to = nxt[at][word]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(nxt)
                nxt.append(nxt[to].copy())
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and nxt[at].get(word) == to:
                    nxt[at][word] = twin
                    at = link[at]
                link[to] = link[new] = twin
        return new

    def matching(self, ids: np.ndarray) -> np.ndarray:
        """For each place, the length of the longest run that ends there and occurs in the texts."""
        nxt, link, length = self.next, self.link, self.length
        out, state, have = np.zeros(len(ids), np.int64), 0, 0
        for i, word in enumerate(ids.tolist()):
            while state and word not in nxt[state]:
                state = link[state]
                have = length[state]
            if word in nxt[state]:
                state, have = nxt[state][word], have + 1
            else:
                have = 0
            out[i] = have
        return out


def spans(matching: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal stretches (first word, word after the last) covered by matches of at least so many words."""
    ends = np.flatnonzero(matching >= least)
    cover = np.zeros(len(matching) + 1, np.int64)
    np.add.at(cover, ends + 1 - matching[ends], 1)
    np.add.at(cover, ends + 1, -1)
    on = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def shards(reference: DataFrame, text: str = "text", words: int = SHARD_WORDS) -> Iterator[list[np.ndarray]]:
    """The reference's texts as word hashes, in lists of about so many words; each list is dropped before the next."""
    block, size = [], 0
    for r in reference.select(F.col(text).cast("string").cast("binary").alias("t")).filter("t IS NOT NULL").orderBy("t").toLocalIterator():
        ids = word_hashes([bytes(r["t"])])[0]
        block.append(ids)
        size += len(ids)
        if size >= words:
            yield block
            block, size = [], 0
    if block:
        yield block


def without_reference(docs: DataFrame, reference: DataFrame, least: int, text: str = "text") -> DataFrame:
    """docs with all columns, less the words in spans of at least so many that the reference has too.

    The rest is joined by single spaces where something was removed; other texts stay as they are, null ones too. Shards
    are taken one after another, each against all documents as they were given, so this is for references of a few
    shards, such as licences or notices; a corpus against itself is the work of without_repeats(), whose cost doesn't grow
    with shards times documents.
    """
    marks = docs.withColumn("__spans", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    for block in shards(reference, text):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        keys = tuple(c for c in marks.columns if c != text)

        def make(shared=shared):
            automaton = SuffixAutomaton(shared.value)
            find = lambda ids: [{"a": a, "b": b} for a, b in spans(automaton.matching(ids), least)]
            return lambda texts: ([None if t is None else t.decode() for t in texts], [find(ids) for ids in word_hashes([t or b"" for t in texts])])

        kinds = dict(marks.dtypes)
        marks = per_text(marks, f"`{text}` {kinds[text]}, __more array<struct<a:bigint,b:bigint>>", make, keys, text)
        marks = marks.withColumn("__spans", F.concat("__spans", "__more")).drop("__more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t, cut in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if t is not None and cut:
                    words = t.encode().split()
                    gone = {i for s in cut for i in range(s["a"], s["b"])}
                    t = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
                made.append(t)
            columns = [pa.array(made, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ordered = marks.select(*[F.col(f"`{c}`") for c in docs.columns], "__spans")
    names, at = docs.columns, docs.columns.index(text)
    return ordered.mapInArrow(run, docs.schema)
