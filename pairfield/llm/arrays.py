"""Texts as flat numpy arrays: hashes of words and of character n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

#: ASCII white space, and all ASCII that is neither a letter nor a digit.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A random number for each byte value, and the multiplier for a byte's place in its word; the same in all workers.
_BYTES = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = np.uint64(0xD6E8FEB86659FD95)
_GRAM = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are worked on at once, unless a single word is longer.
PIECE = 4 << 20


def pieces(text: bytes, limit: int = PIECE) -> list[bytes]:
    """A text in parts of about limit bytes, cut at spaces; a part without a space stays whole."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = text.find(b" ", at + limit)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _letters(texts: list[bytes], gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts: lengths, where each begins among the letters, letters' places in their words, what each
    letter adds to its word's hash, and the number of words up to each text's end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = gaps[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    at = np.cumsum(lengths) - lengths
    letters = data[~gap]
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    powers = np.full(int(lengths.max(initial=1)), _PLACE)
    powers[0] = 1
    return lengths, at, place, _BYTES[letters] * np.multiply.accumulate(powers)[place], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))


def _mixed(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    hashes = (sums ^ (sums >> np.uint64(32))) * _PLACE + lengths.astype(np.uint64)
    return hashes ^ (hashes >> np.uint64(29))


def word_hashes(texts: list[bytes], gaps: np.ndarray = SPACE) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, which are runs of bytes that aren't gaps.

    A hash is a sum over a word's bytes, each by its place, then mixed; it depends on the word alone. A space is a gap.
    """
    if sum(map(len, texts)) > 2 * PIECE:
        return [np.concatenate([word_hashes([p], gaps)[0] for p in pieces(t)]) for t in texts]
    lengths, at, _, adds, ends = _letters(texts, gaps)
    if not len(lengths):
        return [np.zeros(0, np.uint64) for _ in texts]
    return np.split(_mixed(np.add.reduceat(adds, at), lengths), ends[:-1])


def word_starts(texts: list[bytes], sizes: tuple[int, ...], gaps: np.ndarray) -> list[np.ndarray]:
    """For each text, hashes of its words and of their first so many bytes, where they have as many; in no order."""
    if sum(map(len, texts)) > 2 * PIECE:
        return [np.concatenate([word_starts([p], sizes, gaps)[0] for p in pieces(t)]) for t in texts]
    lengths, at, place, adds, ends = _letters(texts, gaps)
    if not len(lengths):
        return [np.zeros(0, np.uint64) for _ in texts]
    of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    hashes, texts_of = [_mixed(np.add.reduceat(adds, at), lengths)], [of]
    for n in sizes:
        long = lengths >= n
        part = np.add.reduceat(np.where(place < n, adds, np.uint64(0)), at)[long]
        hashes.append(_mixed(part, np.full(len(part), 1000 + n)))
        texts_of.append(of[long])
    every, of = np.concatenate(hashes), np.concatenate(texts_of)
    order = np.argsort(of, kind="stable")
    return np.split(every[order], np.cumsum(np.bincount(of, minlength=len(texts)))[:-1])


def character_grams(texts: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each size, the buckets of all n-grams and whether each counts, in flat arrays; and where each text starts.

    Runs of white space are one space, and each text has one at both ends, as the mark of a word's boundary; n-grams with
    a space inside don't count, nor does one over two texts. buckets is a power of two.
    """
    parts = [(b" %s " % b" ".join(t.split())).decode("utf-8", "replace") for t in texts]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    c = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    is_gap = c == 32
    code, shift = c.astype(np.uint64) + np.uint64(1), np.uint64(64 - buckets.bit_length() + 1)
    rolling, inside, out, counts = code, np.ones(len(c), bool), [], []
    have = 1
    for n in sorted(sizes):
        while have < n:
            rolling = (rolling[:-1] ^ (rolling[:-1] >> np.uint64(31))) * _GRAM + code[have:]
            if have == 1:
                inside = ~(is_gap[:-1] & is_gap[1:])
            else:
                inside = inside[:-1] & ~is_gap[have - 1 : -1]
            have += 1
        out.append((((rolling ^ (rolling >> np.uint64(32))) * _GRAM) >> shift).astype(np.int64))
        counts.append(inside)
    return out, counts, starts
