"""Token counts, media, substrings, fingerprints, HTML."""

import gzip
import hashlib
import io
import random
import struct
import wave
import zipfile
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairfield.llm import common, components, html, media, simhash, substrings, tokens

DOCS = "doc_id long, text string"
public_tokenizers = pytest.importorskip("public_tokenizers")


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)


# tokens


@pytest.fixture(scope="module")
def counting():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.VOCABULARY)
    return tokens.counter_of_texts(tokens.load(path)), Tokenizer.from_file(path)


ODD = ["", " ", "  a  b\n\n c\t d ", "a" * 3000, "<|endoftext|>x <|endoftext|>", "it's I'll 'sx", "\x1c a\x85c\xa0d", "日本語 テキスト 😀😀", "(((((", "x\r\n\r\n y", "..,,..", "é é", "ab" * 501]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab  \n.,'s1é<|"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=8))
def test_token_counts_of_any_text(counting, texts):
    count, library = counting
    assert count([t.encode() for t in texts]) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_query(spark, counting):
    d = docs(spark, [*ODD, None, "the same", "the same", "word " * 30000]).withColumn("n_tokens", F.lit("clash"))
    rows = tokens.token_counts(d, public_tokenizers.path(tokens.VOCABULARY)).orderBy("doc_id").collect()
    want = [len(e.ids) for e in counting[1].encode_batch([*ODD, "", "the same", "the same", "word " * 30000], add_special_tokens=False)]
    assert [r["n_tokens"] for r in rows] == want and [r["over_limit"] for r in rows] == [n > 1024 for n in want]
    assert rows[0]["n_bytes"] == 0 and tokens.token_counts(d.limit(0), public_tokenizers.path(tokens.VOCABULARY)).collect() == []


# media


def test_media_round_trip(spark):
    texts = ["", None, "short", "x" * 576, "é" * 577, "RIFF%PDF-PK\x03\x04" * 9, "long " * 50000, "short"]
    rows = media.media_digests(docs(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        stored = media.to_samples(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored))
        assert (r["payload_sha256"], r["media_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest(), zlib.crc32(payload[-32:]))
        with wave.open(io.BytesIO(stored)) as w:
            assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == payload
        assert r["feature"].startswith("audio/wav;")
    assert rows[0][1:] == rows[1][1:] and rows[2][1:] == rows[7][1:]
    assert media.media_digests(docs(spark, [])).collect() == []


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cdscan\xff\x00more\xff\xd9"
BMP = b"BM" + struct.pack("<I4xIIiiHH", 58, 54, 40, 1, 1, 1, 24) + bytes(24) + bytes(4)
PDF = b"%PDF-1.4\nstartxref\n0\n%%EOF"


def archive():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    return b.getvalue()


def test_sniffing_and_carving(spark):
    magic = media.automaton()
    parts = [("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("image/bmp", BMP), ("application/pdf", PDF), ("application/zip", archive()), ("audio/wav", media.to_samples(b"hi"))]
    parts.append(("application/gzip", gzip.compress(b"hello")))
    for kind, data in parts:
        assert media.sniff(data, magic)[0] == (kind, 0, len(data)), kind
        assert (kind, 4, len(data)) in media.sniff(b"junk" + data + b"tail", magic)
        if kind != "application/gzip":
            assert not [x for x in media.sniff(data[:-1], magic) if x[0] == kind], kind
    rows = spark.createDataFrame([(1, bytearray(b"zz" + png()), "text/plain"), (2, bytearray(GIF), "image/png"), (3, None, "a/b"), (4, bytearray(b"BM"), None)], "id int, data binary, declared string")
    made = {r["id"]: r for r in media.carve(rows).collect()}
    assert (made[2]["type"], made[2]["corrected"]) == ("image/gif", True) and bytes(made[1]["carved"][0]["bytes"]) == png()
    assert (made[1]["type"], made[3]["type"], made[4]["type"]) == ("text/plain", "a/b", "application/octet-stream")


def test_sniffing_takes_linear_time():
    import time

    magic = media.automaton()
    for unit in (b"%PDF-1", b"PK\x03\x04 ", b"GIF89a!!!!!!!", b"BM RIFF    WAVE ftyp fLaC "):
        start = time.monotonic()
        assert media.sniff(unit * ((1 << 20) // len(unit)) + b"x" * 1000, magic) == []
        assert time.monotonic() - start < 30


def test_ends_of_documents_and_archives():
    import io
    import zipfile

    magic, pdf = media.automaton(), b"%PDF-1.4 a startxref 9 %%EOF b startxref 9 %%EOF"
    assert media.sniff(b"x" + pdf + b" y " + pdf, magic) == [("application/pdf", 1, len(pdf)), ("application/pdf", len(pdf) + 4, len(pdf))]
    assert media.sniff(b"%PDF-1 no end startxref %PDF-1", magic) == []
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a", "text")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("b.zip", inner.getvalue())
    whole = outer.getvalue()
    assert media.sniff(b"  " + whole, magic) == [("application/zip", 2, len(whole)), ("application/zip", 2 + whole.index(inner.getvalue()), len(inner.getvalue()))]


# substrings


def brute_substrings(texts):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - substrings.WINDOW + 1):
            g = tuple(w[i : i + substrings.WINDOW])
            if g in seen:
                gone[i : i + substrings.WINDOW] = [True] * substrings.WINDOW
            seen.add(g)
        kept = b" ".join(x for x, d in zip(w, gone, strict=True) if not d)
        out.append((len(w), sum(gone), kept.decode()))
    return out


def repeated_texts():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = [passage(n) for n in (19, 20, 21, 55, 200)]
    texts = ["", None, "a b c", "same " * 100, " ".join(["ab", "cd"] * 60)]
    for _ in range(120):
        parts = passage(rnd.randrange(60))
        for _ in range(rnd.randrange(4)):
            s = rnd.choice(shared)
            cut = rnd.randrange(len(s))
            parts += rnd.choice([s, s[:cut], s[cut:]]) + passage(rnd.randrange(3))
        texts.append(rnd.choice([" ", "\n", " \t "]).join(parts))
    return [*texts, texts[20], texts[20], "Unit sep \x1c x " * 30]


def test_substrings_match_brute_force(spark):
    texts = repeated_texts()
    rows = substrings.without_repeats(docs(spark, texts).repartition(5)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in rows] == brute_substrings(texts)
    assert any(r["n_removed"] for r in rows)


def test_substring_sql(spark, tmp_path):
    docs(spark, [t for t in repeated_texts() if t is None or "\x1c" not in t]).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = c.execute(substrings.SQL).fetchall()
    assert sorted(tuple(r) for r in substrings.op5_substrings(spark, str(tmp_path)).collect()) == sorted(theirs)


def test_substring_edges(spark):
    assert substrings.without_repeats(docs(spark, [])).collect() == []
    text = " ".join(map(str, range(40)))
    d = spark.createDataFrame([(None, text, 1), (5, text, 2), (7, text, 3)], "doc_id long, text string, kept int")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(d).collect()} == {None: 40, 5: 0, 7: 40}


@pytest.mark.parametrize("heavy", [2, substrings.HEAVY])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_substrings_of_rows_that_share_an_id(spark, monkeypatch, heavy, kind):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    x, y, z = (" ".join(f"{k}{i}" for i in range(30)) for k in "xyz")
    rows = [("1", x), (None, x), (None, y), ("5", x), ("5", z), ("5", f"{z} {y}"), (None, f"q {x}"), (None, None), (None, ""), ("6", y), ("6", y)]
    d = spark.createDataFrame(rows, "id string, text string").select(F.col("id").cast(kind).alias("doc_id"), "text")
    tags = {r["text"]: r["h"] for r in d.select("text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).collect()}
    places = sorted({(i is None, i or "0", tags[t], t or "") for i, t in rows})
    want = {(None if none else i, t): r for (none, i, _, t), r in zip(places, brute_substrings([p[3] for p in places]), strict=True)}
    made = substrings.without_repeats(d.repartition(3)).collect()
    assert sorted(str((None if r["doc_id"] is None else str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"])) for r in made) == sorted(str((i, *want[i, t or ""])) for i, t in rows)
    assert want[None, y][1] == 30 and want["5", z][1] + want["5", f"{z} {y}"][1] == 30 and want["6", y][1] in (0, 30)


def test_substrings_of_a_very_long_text(spark):
    unit = " ".join(f"a{i}" for i in range(5000))
    made = substrings.without_repeats(docs(spark, [" ".join([unit] * 30), unit, "b " + unit])).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"]) for r in made] == [(150_000, 145_000), (5000, 5000), (5001, 5000)]


# fingerprints


def brute_components(ids, prints):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= 2:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_definition():
    import xxhash

    for text in ("", " ", "One", "one two", "A b c D e f g a b c", "é Ü x " * 9):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        want = sum(1 << bit for bit in range(64) if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams))
        assert simhash.fingerprints_of([text.encode()])[0] & (1 << 64) - 1 == want
    assert simhash.fingerprints_of([None]) == [0]


def test_chains_are_the_pigeonring_condition():
    rnd = random.Random(4)
    segments = [simhash.chain_bits(i, 1) for i in range(simhash.SEGMENTS)]
    assert sum(segments) == (1 << 64) - 1 and simhash.chain_bits(13, 4) == segments[13] | segments[14] | segments[0] | segments[1]
    for _ in range(300):
        x = sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5)))
        each = [(x & s).bit_count() for s in segments]
        m, most = simhash.SEGMENTS, simhash.MAX_DIFFERENT
        by_definition = [all(sum(each[(i + j) % m] for j in range(n)) * m <= n * most for n in range(1, m + 1)) for i in range(m)]
        by_chains = [all((x & simhash.chain_bits(i, n)).bit_count() <= d for d, n in enumerate(simhash.CHAINS)) for i in range(m)]
        assert by_definition == by_chains and any(by_chains) == (x.bit_count() <= most)


def test_links_at_the_density_of_a_hundred_million(spark):
    """A third of all bits random: buckets of 10 bits instead of 30, a thousand fingerprints in for a thousand million."""
    rng = np.random.default_rng(6)
    mask = np.uint64(sum(1 << b for b in range(0, 64, 3)))
    values = np.unique(rng.integers(0, 1 << 64, 1500, dtype=np.uint64) & mask)
    d = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    near = np.bitwise_count(values[:, None] ^ values[None, :])
    pairs = {(int(a), int(b)) for a, b in np.argwhere((near <= 2) & (near > 0)) if a < b}
    met = d.select("fp", simhash._buckets(F.col("fp")).alias("k"))
    other = met.select(F.col("fp").alias("b"), F.col("k").alias("kb"))
    both = met.join(other, F.col("k") == F.col("kb")).filter("fp < b")
    ring = both.filter(simhash.viable(F.col("fp"), F.col("b"), F.col("k.i")))
    n_met, n_ring = both.count(), ring.select("fp", "b").distinct().count()
    assert n_ring == len(pairs) > 0 and n_met > 3 * n_ring
    signed = values.view(np.int64)
    edges = simhash.links(d).collect()
    assert all(np.bitwise_count(np.uint64((e["a"] ^ e["b"]) & (1 << 64) - 1)) <= 2 for e in edges)
    assert len(edges) == len(pairs) == len({frozenset((int(signed[a]), int(signed[b]))) for a, b in pairs} & {frozenset((e["a"], e["b"])) for e in edges})


@pytest.mark.parametrize("bucket", [4, simhash.BUCKET])
def test_links_of_chosen_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = set(base) | {0}
    for b in base[:20]:
        for _ in range(6):
            b ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            prints.add(b)
    crowd = rnd.getrandbits(64)  # more than a bucket's members that share segments
    prints |= {crowd ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12, 20)}
    prints |= {1, 3, 7, 15, 31}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    d = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(d)).collect()}
    want = brute_components(signed, signed)
    groups = {}
    for p in signed:
        groups.setdefault(want[p], set()).add(p)
    for members in groups.values():
        if len(members) == 1:
            assert next(iter(members)) not in roots
        else:
            assert {roots[m] for m in members} == {min(members)}


@pytest.mark.parametrize("hot", [3, 1000])
def test_near_duplicates_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "LEAST_HOT", hot)
    rnd = random.Random(3)
    words = [f"v{i}" for i in range(200)]
    texts = ["", None, "  ", "one", "one", *["mass copy of one text"] * 9, "long " * 60_000 + "end"]
    for _ in range(60):
        t = [rnd.choice(words) for _ in range(400)]
        texts.append(" ".join(t))
        for _ in range(rnd.randrange(3)):
            t[rnd.randrange(len(t))] = "edit"
            texts.append(" ".join(t).upper() if rnd.random() < 0.5 else " ".join(t))
    d = docs(spark, texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    rows = simhash.near_duplicates(d).collect()
    ids, prints = [r["doc_id"] for r in rows], [r["fp"] for r in rows]
    want = brute_components(ids, prints)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and len(rows) == len(texts)
    kept = simhash.one_of_each(d)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == d.columns


def test_similar_texts_match_brute_force(spark, monkeypatch):
    from pairfield.llm import similar

    monkeypatch.setattr(similar, "SAMPLE_ROWS", 20)
    rnd = random.Random(9)
    words, texts = [f"v{i}" for i in range(900)], ["", None, " ", "one two", "One two", "one two three"]
    footer = " ".join(rnd.choice(words) for _ in range(40))
    for _ in range(25):
        t = [rnd.choice(words) for _ in range(rnd.randrange(20, 300))]
        texts += [" ".join(t), f"{' '.join(t)} {footer}"]
        for edits in (1, len(t) // 60, len(t) // 40, len(t) // 20):
            e = t[:]
            for at in rnd.sample(range(len(t)), edits):
                e[at] = "edit"
            texts.append(" ".join(e))
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    d = docs(spark, texts)
    rows = {r["doc_id"]: r for r in similar.near_duplicates(d).collect()}
    sets, ids = [grams(t) for t in texts], sorted(rows)
    root = {i: i for i in ids}
    for _ in ids:
        before = dict(root)
        for a in ids:
            for b in range(a):
                near = bin((rows[a]["fp"] ^ rows[b]["fp"]) & (1 << 64) - 1).count("1") <= 2
                if near or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert {i: r["component_id"] for i, r in rows.items()} == root and len(rows) == len(texts)
    assert len(set(root.values())) < len({r["component_id"] for r in simhash.near_duplicates(d).collect()})
    assert similar.near_duplicates(d.limit(0)).collect() == []


def test_open_pairs_come_at_their_first_meeting(spark):
    """Not at each of the shingles that two sets share, which made some forty rows of each pair left on check_l."""
    from pairfield.llm import similar

    def rows(node, prefix, first):
        return [(s, node, 100, p, node, first, [0] * 8, prefix[: similar.FIRST]) for p, s in enumerate(prefix)]

    made = [*rows(1, [10, 20, 30, 40, 50, 60], 1), *rows(2, [11, 20, 30, 40, 50, 60], 1), *rows(3, [12, 30, 60], 1)]
    late = [*range(100, 100 + similar.FIRST), 900, 901]  # these share none of their first
    made += [*rows(4, late, 4), *rows(5, [x + 200 if x < 900 else x for x in late], 4)]
    mixed = spark.createDataFrame(made, "s long, node long, n long, p int, root long, first long, sketch array<long>, lead array<long>")
    pairs = sorted((r["a"], r["b"]) for r in similar._left(mixed, 0.8).collect())
    assert pairs == [(1, 2), (1, 3), (2, 3), (2, 3), (4, 5), (4, 5)]  # either of 2 and 3 asks


def test_fingerprint_edges(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    same = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, "q r s t u v w x")], DOCS)
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(same).collect()) == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    assert sorted(r["doc_id"] for r in simhash.one_of_each(same).collect()) == [4, 9]
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "A b c d"), (3, "q r s t u v w x")], DOCS)
    assert sorted(r["doc_id"] or -1 for r in simhash.one_of_each(nameless).collect()) == [-1, 3]


def test_long_chain_of_components(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5000, 5000)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert roots == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("few", [0, 40, components.FEW])
def test_components_match_brute_force(spark, monkeypatch, few):
    """Chains, stars, loops and random graphs, solved in memory at once, after some contractions, or never."""
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    rnd = random.Random(12)
    pairs = [(i, i + 1) for i in range(200)] + [(i, 1000) for i in range(1001, 1100)] + [(-5, 2000), (2000, -5), (7000, 7000)]
    pairs += [(rnd.randrange(3000, 3200), rnd.randrange(3000, 3200)) for _ in range(120)] + [(1 << 62, -(1 << 62))]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    while any(root[a] != root[b] for a, b in pairs if a != b):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    rows = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == root and len(rows) == len(root)
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_components_of_a_small_graph_take_few_tasks_and_leave_one_table(spark):
    """Each task costs files, and a line of the event log: with 60 partitions it took thousands, and left each round's labels."""
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before, edges = set(folder.rglob("*")), spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    partitions, context = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set(adaptive, "false")
    context.setJobGroup("small graph", "")
    try:
        found = components.components(edges)
        tracker = context.statusTracker()
        stages = {i for j in tracker.getJobIdsForGroup("small graph") for i in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset(adaptive)
    assert 0 < tasks < 300
    left = {p.parent for p in set(folder.rglob("*")) - before if p.is_file() and not p.name.startswith((".", "_"))}
    assert len(left) == 1 and {r["root"] for r in found.collect()} == {0}


# html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="masthead"><h1>Site, name, here</h1></header><nav><ul><li><a href="/a">Menu, one</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as you know, and more, of them, here.</p></div>
<aside>Side, words</aside>
<div id="wrap"><article><h1>Title &amp; more</h1><p><b>First,</b> second
 and   third &eacute;&#8212;x.<br>line<p>Next, unclosed, paragraph<ul><li>item, one<li>item two</ul>
<table><tr><td>cell a<td>cell b</table><!-- gone --><div class="advert"><p>Buy, now</p></div><form><p>Name, please</p></form></article>
<section class="comments"><p>Nice one, really, I, like, it, a, lot</p></section></div>
<footer>&copy; us</footer></body></html>"""


def test_page():
    want = "Title & more\nFirst, second and third é—x. line\nNext, unclosed, paragraph\nitem, one\nitem two\ncell a\ncell b"
    assert html.extract(PAGE) == want


def test_best_container_without_article():
    long = "A long paragraph, with commas, and words. " * 6
    page = f"<body><div><p><a href=x>{long}</a></p></div><div><div><p>{long}</p><p>{long}</p></div></div><div><p>short</p></div>"
    assert html.extract(page) == "\n".join([long.strip()] * 2)


@pytest.mark.parametrize("page,text", [("", ""), ("plain  text", "plain text"), ("<p>a</p>b", "a\nb"), ("<p>cut &am", "cut &am"), ("<script>x", ""), ("<", "<"), ("</p></div>x", "x")])
def test_small_pages(page, text):
    assert html.extract(page) == text


def test_deep_and_long_pages():
    assert html.extract("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert len(html.extract("<article>" + "<p>word, word</p>" * 20000)) == 20000 * 11 - 1


def test_html_query(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    made = html.main_texts(d).collect()
    assert len(made) == 4 and made[0] == made[1] and made[0]["n_chars"] == len(made[0]["text"]) and {r["text"] for r in made[2:]} == {""}
    assert html.main_texts(d.limit(0)).collect() == []


def test_numpy_helpers():
    ids = np.arange(1, 60, dtype=np.uint64)
    assert len(substrings.runs(ids, 20)) == 40 and len(set(substrings.runs(ids, 20).tolist())) == 40
    assert (substrings.runs(np.tile(ids[:30], 2), 20)[:11] == substrings.runs(ids[:30], 20)).all()


# suffix automata


def test_matching_statistics_match_brute_force():
    from pairfield.llm import automaton

    rnd = random.Random(8)
    for _ in range(60):
        refs = [np.array([rnd.randrange(3) for _ in range(rnd.randrange(1, 15))], np.uint64) for _ in range(3)]
        doc = np.array([rnd.randrange(4) for _ in range(30)], np.uint64)
        made = automaton.SuffixAutomaton(refs).matching(doc)
        runs_of = {tuple(r[i:j].tolist()) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [max((n for n in range(1, i + 2) if tuple(doc[i + 1 - n : i + 1].tolist()) in runs_of), default=0) for i in range(len(doc))]
        assert made.tolist() == want


def test_reference_spans(spark, monkeypatch):
    from pairfield.llm import automaton

    reference = spark.createDataFrame([("all rights are reserved here by us",), ("no warranty of any kind is given",), (None,)], "text string")
    texts = ["one two all rights are reserved here by me", None, "", "any kind  is", "no warranty of any kind is given today, no warranty of any", "rights reserved"]
    d = spark.createDataFrame([(7, t, i) for i, t in enumerate(texts)], "doc_id long, text string, a int")
    for words in (6, 1000):
        monkeypatch.setattr(automaton.shards, "__defaults__", ("text", words))
        made = automaton.without_reference(d, reference, 5)
        assert made.columns == d.columns
        assert [r["text"] for r in made.orderBy("a").collect()] == ["one two me", None, "", "any kind  is", "today, no warranty of any", "rights reserved"]
    assert automaton.without_reference(d.limit(0), reference, 5).collect() == []


LONG = "A long paragraph, with commas, and words. " * 6


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body class='has-sidebar'><div class='content no-header'><h1>T</h1><p>{LONG}</p></div><div class='sidebar-left'><p>{LONG[:90]}</p></div>", ["T", LONG.strip()]),
        (f"<body><div id=top-wrapper class=header><main><p>{LONG}</p></main></div>", [LONG.strip()]),
        (f"<body><div class=comments><p>{LONG}</p><p>{LONG}</p></div>", []),
        (f"<body><div class=sidebar-layout><div class=entry-content><p>{LONG}</p></div></div><p>Short note.</p>", [LONG.strip()]),
        (f"<body><div class=sidebar-layout><div class=x><p>{LONG}</p></div></div><h2>T</h2>", [LONG.strip()]),
        (f"<body><article class='post comments-open'><p>{LONG}</p></article>", [LONG.strip()]),
        (f"<body><div class=page><p>Short, but it is the text.</p><div class=newsletter><p>{LONG}</p><p>{LONG}</p></div></div>", ["Short, but it is the text."]),
        (f"<body><div id=c><h1>T</h1><section><h2>a</h2><p>{LONG}</p></section><section><h2>b</h2><p>{LONG}</p></section></div><h2>Related</h2><ul><li><a href=x>one</a></ul>", ["T", "a", LONG.strip(), "b", LONG.strip()]),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p><div class='share-bar'>Share, this</div><div id='commentList'><p>{LONG[:60]}</p></div><p hidden>x</p><p style='display:none'>y</p></article>", ["T", LONG.strip()]),
    ],
)
def test_what_is_around(page, want):
    assert html.extract(page) == "\n".join(want)


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><section>{f'<p>{LONG}</p>' * 10}</section><section><h2>Conclusion</h2><p>{LONG[:200]}</p></section></article>", [LONG.strip()] * 10 + ["Conclusion", LONG[:200].strip()]),
        (f"<main><div>{f'<p>{LONG}</p>' * 5}</div><p>Short last line.</p></main>", [LONG.strip()] * 5 + ["Short last line."]),
        (f"<div id=x><div>{f'<p>{LONG}</p>' * 5}</div><ul><li>one</ul><p>Last.</p><ul><li><a href=x>link</a></ul></div>", [LONG.strip()] * 5 + ["one", "Last."]),
    ],
)
def test_short_parts_beside_the_body(page, want):
    assert html.extract(page) == "\n".join(want)


@pytest.mark.parametrize("tag", ["div", "article"])
@pytest.mark.parametrize("outer", ["article", "div"])
def test_long_comment_threads(outer, tag):
    thread = f"<div class=comments>{f'<{tag} class=comment-body><p>{LONG}</p></{tag}>' * 9}</div>"
    assert html.extract(f"<body><{outer}><h1>T</h1><p>Short text.</p></{outer}>{thread}") == "T\nShort text."
    assert html.extract(f"<body><{outer}><h1>T</h1><p>Short text.</p>{thread}</{outer}>") == "T\nShort text."
    assert html.extract(f"<body><h1>T</h1>{thread}") in ("T", "")


@pytest.mark.parametrize("share", [10, 30, 60, 75, 95])
def test_comments_go_whatever_their_share(share):
    text = [f"Paragraph {i}, with commas, and some words of its own." for i in range(8)]
    size = sum(map(len, text)) * share // (100 - share)
    thread = "".join(f"<li class=comment><div class=comment-body><p>Reply {i}, I think, that is, well, so.</p></div></li>" for i in range(max(1, size // 40)))
    page = f"<body><div class=wrap><h1>T</h1>{''.join(f'<p>{t}</p>' for t in text)}</div><ol class=commentlist id=comments>{thread}</ol>"
    assert html.extract(page) == "\n".join(["T", *text])
