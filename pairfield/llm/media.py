"""Media columns: signature sniffing, lossless 8-bit sample storage, carving and features."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table

#: Payloads are padded with byte 255 to a positive multiple of this; it is also a frame of the features.
FRAME = 576
RATE = 8000


class Marks:
    """What validators look up in one text: places of end marks and ways through chains, each worked out once."""

    def __init__(self, d: bytes):
        self.d, self.places, self.ends = d, {}, {}
        self._archives: dict[int, int] | None = None

    def of(self, mark: bytes) -> list[int]:
        """All places of a mark, in order."""
        if mark not in self.places:
            found, at = [], self.d.find(mark)
            while at >= 0:
                found.append(at)
                at = self.d.find(mark, at + 1)
            self.places[mark] = found
        return self.places[mark]

    def archives(self) -> dict[int, int]:
        """Where ZIP archives start, as their end records tell, and where each ends; of several ends the last."""
        if self._archives is None:
            self._archives = {}
            for end in self.of(b"PK\x05\x06"):
                if end + 22 <= len(self.d):
                    size, offset, note = struct.unpack_from("<IIH", self.d, end + 12)
                    at, stop = end - offset - size, end + 22 + note
                    if at >= 0 and stop <= len(self.d) and (size == 0 or self.d[at + offset : at + offset + 4] == b"PK\x01\x02"):
                        self._archives[at] = stop
        return self._archives

    def subblocks(self, pos: int) -> int:
        """The place after a chain of GIF sub-blocks, or beyond the data; ways that meet are walked once."""
        way = []
        while pos < len(self.d) and self.d[pos] and pos not in self.ends:
            way.append(pos)
            pos += 1 + self.d[pos]
        end = self.ends[pos] if pos in self.ends else pos + 1
        self.ends.update(dict.fromkeys(way, end))
        return end


# Validators: (data, offset, marks) -> length of a well-formed object that starts there, or 0.


def _wav(d: bytes, at: int, marks: Marks) -> int:
    if len(d) < at + 12 or d[at + 8 : at + 12] != b"WAVE":
        return 0
    end, pos, fmt, data = at + 8 + int.from_bytes(d[at + 4 : at + 8], "little"), at + 12, False, False
    if end > len(d):
        return 0
    while pos + 8 <= end:
        size = int.from_bytes(d[pos + 4 : pos + 8], "little")
        fmt |= d[pos : pos + 4] == b"fmt " and size >= 16
        data |= d[pos : pos + 4] == b"data"
        pos += 8 + size + size % 2
    return end - at if fmt and data and pos == end else 0


def _png(d: bytes, at: int, marks: Marks) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(d):
        size, kind = int.from_bytes(d[pos : pos + 4], "big"), d[pos + 4 : pos + 8]
        if first and (kind != b"IHDR" or size != 13) or pos + 12 + size > len(d):
            return 0
        if zlib.crc32(d[pos + 4 : pos + 8 + size]) != int.from_bytes(d[pos + 8 + size : pos + 12 + size], "big"):
            return 0
        pos, first = pos + 12 + size, False
        if kind == b"IEND":
            return pos - at
    return 0


def _gif(d: bytes, at: int, marks: Marks) -> int:
    pos = at + 13
    if len(d) < pos:
        return 0
    if d[at + 10] & 0x80:
        pos += 3 << ((d[at + 10] & 7) + 1)
    while pos < len(d):
        mark = d[pos]
        if mark == 0x3B:
            return pos + 1 - at
        if mark == 0x2C and pos + 10 <= len(d):
            packed = d[pos + 9]
            pos += 11 + ((3 << ((packed & 7) + 1)) if packed & 0x80 else 0)
        elif mark == 0x21:
            pos += 2
        else:
            return 0
        pos = marks.subblocks(pos)
    return 0


def _jpeg(d: bytes, at: int, marks: Marks) -> int:
    pos, scanned = at + 2, False
    while pos + 4 <= len(d):
        if d[pos] != 0xFF:
            return 0
        mark = d[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        size = int.from_bytes(d[pos + 2 : pos + 4], "big")
        if mark in (0x00, 0x01, 0xD8, 0xD9) or 0xD0 <= mark <= 0xD7 or size < 2:
            return 0
        pos += 2 + size
        if mark == 0xDA:
            scanned = True
            while True:
                pos = d.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(d):
                    return 0
                if d[pos + 1] == 0xD9:
                    return pos + 2 - at if scanned else 0
                if d[pos + 1] and not 0xD0 <= d[pos + 1] <= 0xD7:
                    break
                pos += 2
    return 0


def _bmp(d: bytes, at: int, marks: Marks) -> int:
    if len(d) < at + 30:
        return 0
    size, start, header, width, _, planes, bits = struct.unpack_from("<I4xIIiiHH", d, at + 2)
    ok = header in (12, 40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= start <= size and width > 0
    return size if ok and at + size <= len(d) else 0


def _pdf(d: bytes, at: int, marks: Marks) -> int:
    """Up to the last end mark before the next document begins: a revised one has several."""
    if not d[at + 5 : at + 6].isdigit():
        return 0
    starts, ends, references = marks.of(b"%PDF-"), marks.of(b"%%EOF"), marks.of(b"startxref")
    i = bisect_right(starts, at)
    last = bisect_left(ends, starts[i] if i < len(starts) else len(d)) - 1
    first = bisect_left(references, at)
    return ends[last] + 5 - at if last >= 0 and ends[last] > at and first < len(references) and references[first] < ends[last] else 0


def _zip(d: bytes, at: int, marks: Marks) -> int:
    return marks.archives().get(at, at) - at


def _gzip(d: bytes, at: int, marks: Marks) -> int:
    if d[at + 2 : at + 3] != b"\x08":
        return 0
    try:
        z = zlib.decompressobj(31)
        pos = at
        while pos < len(d) and not z.eof:
            z.decompress(d[pos : pos + 65536])
            pos += 65536
        return min(pos, len(d)) - len(z.unused_data) - at if z.eof else 0
    except zlib.error:
        return 0


def _flac(d: bytes, at: int, marks: Marks) -> int:
    pos, first = at + 4, True
    while pos + 4 <= len(d):
        kind, size = d[pos] & 0x7F, int.from_bytes(d[pos + 1 : pos + 4], "big")
        if first and (kind or size != 34) or pos + 4 + size > len(d):
            return 0
        last, pos, first = d[pos] & 0x80, pos + 4 + size, False
        if last:  # frames have no length of their own: the stream ends with the data
            return len(d) - at if pos + 1 < len(d) and d[pos] == 0xFF and d[pos + 1] & 0xFC == 0xF8 else 0
    return 0


def _mp4(d: bytes, at: int, marks: Marks) -> int:
    pos, at, movie = at - 4, at - 4, False
    if at < 0:
        return 0
    while pos + 8 <= len(d):
        size, kind = int.from_bytes(d[pos : pos + 4], "big"), d[pos + 4 : pos + 8]
        if size < 8 or pos + size > len(d) or not kind.isalnum():
            break
        movie |= kind in (b"moov", b"moof")
        pos += size
    return pos - at if movie else 0


#: Magic bytes, type, validator, and how far before the magic bytes the object starts.
SIGNATURES: tuple[tuple[bytes, str, Callable[[bytes, int, Marks], int], int], ...] = (
    (b"RIFF", "audio/wav", _wav, 0),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png, 0),
    (b"GIF87a", "image/gif", _gif, 0),
    (b"GIF89a", "image/gif", _gif, 0),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg, 0),
    (b"BM", "image/bmp", _bmp, 0),
    (b"%PDF-", "application/pdf", _pdf, 0),
    (b"PK\x03\x04", "application/zip", _zip, 0),
    (b"\x1f\x8b", "application/gzip", _gzip, 0),
    (b"fLaC", "audio/flac", _flac, 0),
    (b"ftyp", "video/mp4", _mp4, 4),
)


def automaton():
    """The Aho-Corasick automaton of all magic bytes, over bytes as Latin-1 characters."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, *_) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def sniff(data: bytes, magic) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each well-formed object whose magic bytes occur, by offset, the outermost first.

    An offset is judged once for each type. Objects within others are reported as well.
    """
    found, marks = [], Marks(data)
    for last, i in magic.iter(data.decode("latin-1")):
        word, kind, check, before = SIGNATURES[i]
        at = last - len(word) + 1
        if length := check(data, at, marks):
            found.append((kind, at - before, length))
    return sorted(set(found), key=lambda x: (x[1], -x[2], x[0]))


def corrected(declared: str | None, found: list[tuple[str, int, int]]) -> str:
    """The type to declare: that of the object at offset 0 if there is one, else what is declared, else octets."""
    at_start = [kind for kind, at, _ in found if at == 0]
    return at_start[0] if at_start else declared or "application/octet-stream"


def to_samples(data: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples that holds the bytes, padded with 255 to a positive multiple of FRAME."""
    payload = data + b"\xff" * (-len(data) % FRAME or (0 if data else FRAME))
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload


def from_samples(stored: bytes, at: int = 0) -> bytes:
    """The samples of a WAV file that starts at an offset."""
    pos, end = at + 12, at + 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
    while pos + 8 <= end:
        size = int.from_bytes(stored[pos + 4 : pos + 8], "little")
        if stored[pos : pos + 4] == b"data":
            return stored[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    raise ValueError("no data chunk")


def feature(payload: bytes, kind: str, inner: list[tuple[str, int, int]]) -> str:
    """Type, frames, level and spread of the samples, changes of sign about the middle, frames' energies, carved objects."""
    x = np.frombuffer(payload, np.uint8)
    c = x.astype(np.int16) - 128
    energy = np.square(c.astype(np.int64)).reshape(-1, FRAME).sum(axis=1) // FRAME
    crossings = int(np.count_nonzero((c[1:] < 0) != (c[:-1] < 0)))
    parts = [kind, f"frames={len(energy)}", f"sum={int(x.sum(dtype=np.int64))}", f"min={int(x.min())}", f"max={int(x.max())}", f"crossings={crossings}"]
    parts += [f"energy={int(energy.min())}:{int(energy.sum()) // len(energy)}:{int(energy.max())}", f"carved={','.join(f'{k}@{a}+{n}' for k, a, n in inner)}"]
    return ";".join(parts)


def digests_of(texts: list, magic, declared: str) -> tuple[list, ...]:
    rows = []
    for text in texts:
        text = text or b""
        stored = to_samples(text)
        found = sniff(stored, magic)
        kind = corrected(declared, found)
        whole = next(x for x in found if x[1] == 0)
        payload = from_samples(stored[whole[1] : whole[1] + whole[2]])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        inner = [x for x in found if x is not whole]
        rows.append((len(text), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(stored), sha(stored), feature(payload, kind, inner)))
    return tuple(zip(*rows, strict=True)) if rows else tuple([] for _ in range(7))


def media_digests(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stores each text's UTF-8 bytes as a media file, reads them back by sniffing and carving, and describes both.

    Media are declared as plain octets; the sniffed type corrects that. A null text counts as empty, which is one frame
    of padding. Equal texts give equal values; repeated rows give a row each; other columns are ignored; an empty table
    gives an empty result. Rows are independent, and a very long text takes memory in proportion to itself alone.
    """
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def make():
        magic = automaton()
        return lambda texts: digests_of(texts, magic, "application/octet-stream")

    return per_text(docs, schema, make, keys, text, 64)


def carve(media: DataFrame, data: str = "data", declared: str = "declared", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """For a column of media bytes with declared types: the corrected type and all carved objects (type, at, length, bytes).

    Null bytes count as empty and keep the declared type; nothing is dropped.
    """
    key_types = {f.name: f.dataType.simpleString() for f in media.schema.fields}
    out = ", ".join([*(f"{k} {key_types[k]}" for k in keys), "type string, corrected boolean, carved array<struct<type:string,at:long,length:long,bytes:binary>>"])

    def run(batches):
        import pandas as pd

        magic = automaton()
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                d = bytes(r["__data"]) if r["__data"] is not None else b""
                found = sniff(d, magic)
                kind = corrected(r["__declared"], found)
                rows.append([*(r[k] for k in keys), kind, kind != r["__declared"], [{"type": k, "at": a, "length": n, "bytes": d[a : a + n]} for k, a, n in found]])
            yield pd.DataFrame(rows, columns=[*keys, "type", "corrected", "carved"])

    picked = media.select(*keys, F.col(data).cast("binary").alias("__data"), F.col(declared).cast("string").alias("__declared"))
    return picked.mapInPandas(run, out)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
