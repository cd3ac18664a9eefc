"""Token counts by rank-synchronous array merging of byte-pair vocabularies."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import per_text, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters of the chunks whose counts a worker remembers, beyond which the memory starts anew; longer chunks than that
#: many characters are counted each time.
REMEMBERED, LONGEST = 4_000_000, 64
#: Symbols that are merged at once in one array.
BATCH_SYMBOLS = 1 << 20

#: The split before merges, a fixed value of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _printable_bytes() -> dict[str, int]:
    """The vocabulary files' stand-in character of each byte: itself if printable Latin-1, else the next one from 256."""
    shown = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load(path: str) -> dict:
    """Merge tables of a tokenizer file: pair keys in order with their ranks and results, byte symbols, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("a byte-level BPE without prefix space is expected")
    first = np.zeros(256, np.int64)
    for shown, b in _printable_bytes().items():
        first[b] = vocab[shown]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    base = max(vocab.values()) + 1
    keys = np.array([vocab[a] * base + vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    specials = sorted((t["content"] for t in spec.get("added_tokens", []) if t["special"]), key=len, reverse=True)
    return {"base": base, "first": first, "keys": keys[order], "rank": order.astype(np.int64), "made": made[order], "specials": specials}


class PairTable:
    """Ranks and results of pairs in an open-addressed table, for looking up many keys at once."""

    def __init__(self, keys: np.ndarray, rank: np.ndarray, made: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank, self.made = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # each round the first key at every free slot settles, the rest moves on
            first = np.unique(slot, return_index=True)[1]
            won = first[self.key[slot[first]] < 0]
            at = slot[won]
            self.key[at], self.rank[at], self.made[at] = keys[left[won]], rank[left[won]], made[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, slot = left[stay], (slot[stay] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, slot, -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.last
            there, wanted = self.key[slot], keys[open_]
            out[open_[there == wanted]] = slot[there == wanted]
            more = (there != wanted) & (there >= 0)
            open_, slot = open_[more], slot[more]
        return out


class Counter:
    """Counts tokens of pre-tokens, many at once."""

    def __init__(self, tables: dict):
        self.base, self.first, self.none = tables["base"], tables["first"], len(tables["keys"])
        self.table = PairTable(tables["keys"], tables["rank"], tables["made"])

    def _ranks(self, symbols: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each symbol with its right neighbour, and the merge's slot; none at a sequence's end."""
        slot = self.table.find(symbols[:-1] * self.base + symbols[1:])
        return np.where((slot >= 0) & (seq[:-1] == seq[1:]), self.table.rank[slot], self.none), slot

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that survive all merges, for each piece.

        All pieces lie in one flat array with the number of their sequence. In each round every sequence applies its
        lowest-rank pair at all its places, in runs of equal symbols at every second one from the left; sequences
        without a pair leave the array.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            rank, slot = self._ranks(symbols, seq)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(np.append(rank, self.none), starts)
            live = lowest < self.none
            if not live.any():
                break
            size = np.diff(np.append(starts, len(symbols)))
            mine = np.repeat(lowest, size)
            take = np.append(rank, self.none) == mine
            take &= mine < self.none
            again = take[1:] & take[:-1] & (symbols[1:] == symbols[:-1]) & (seq[1:] == seq[:-1])
            if again.any():  # overlapping places are in runs of one symbol: keep every second one
                place = np.arange(len(take))
                head = take & ~np.append(False, again)
                run = np.maximum.accumulate(np.where(head, place, -1))
                take &= (place - run) % 2 == 0
            left = np.flatnonzero(take)
            symbols[left] = self.table.made[slot[left]]
            keep = np.ones(len(symbols), bool)
            keep[left + 1] = False
            out -= np.bincount(seq[left], minlength=len(out))
            keep &= np.repeat(live, size)
            symbols, seq = symbols[keep], seq[keep]
        return out


def counter_of_texts(tables: dict):
    """A function from UTF-8 texts (or None) to their numbers of tokens.

    A text is cut before each single space between other characters, where no pre-token can continue; chunks seen
    before are looked up, the rest are pre-split, merged together and remembered.
    """
    import regex

    split = regex.compile(PATTERN).findall
    cuts = regex.compile(r"(?<=\S)(?= \S)")
    odd = regex.compile(r" \s|\s |^\s|\s$").search
    counter, seen, size_of_seen = Counter(tables), {}, 0
    specials = regex.compile("|".join(map(regex.escape, tables["specials"]))) if tables["specials"] else None

    def chunks(text: str) -> list[str]:
        if odd(text):
            return [c for c in cuts.split(text) if c]
        parts = text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]] if text else []

    def learn(new: list[str]) -> dict[str, int]:
        nonlocal size_of_seen
        at, learnt = 0, {}
        while at < len(new):
            pieces, owner, size, start = [], [], 0, at
            while at < len(new) and (size < BATCH_SYMBOLS or at == start):
                for piece in split(new[at]):
                    pieces.append(piece.encode())
                    owner.append(at - start)
                size += len(new[at])
                at += 1
            each = np.bincount(owner, counter.counts(pieces), at - start) if pieces else np.zeros(at - start)
            learnt.update(zip(new[start:at], each.astype(np.int64).tolist(), strict=True))
        for chunk, n in learnt.items():
            if len(chunk) <= LONGEST:
                seen[chunk] = n
                size_of_seen += len(chunk)
        return learnt

    def count(texts: list) -> list[int]:
        nonlocal size_of_seen
        if size_of_seen > REMEMBERED:
            seen.clear()
            size_of_seen = 0
        out, new, late = [], set(), []
        for raw in texts:
            text = (raw or b"").decode("utf-8", "replace")
            parts = specials.split(text) if specials else [text]
            every = chunks(parts[0]) if len(parts) == 1 else [c for part in parts for c in chunks(part)]
            known = list(map(seen.get, every))
            if None in known:
                new.update(c for c, n in zip(every, known, strict=True) if n is None)
                late.append((len(out), every))
                known = [0]
            out.append(len(parts) - 1 + sum(known))
        learnt = learn(list(new))
        for i, every in late:
            out[i] += sum(learnt[c] if c in learnt else seen[c] for c in every)
        return out

    return count


def _columns(texts: list, counts: list[int], limit: int) -> tuple[list, list, list]:
    return [len(t or b"") for t in texts], counts, [n > limit for n in counts]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the keys, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens. Special strings inside texts are one token each. Repeated rows
    are counted each; other columns are ignored; an empty table gives an empty result. The merge tables, of a fixed size
    given by the vocabulary file, are read on the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def make():
        count = counter_of_texts(shared.value)
        return lambda texts: _columns(texts, count(texts), limit)

    return per_text(docs, "n_bytes long, n_tokens long, over_limit boolean", make, keys, text)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
