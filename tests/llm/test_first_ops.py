"""Operators against brute force on small fixtures: SimHash, packing, fingerprints, mixing, media."""

import hashlib
import random
import struct
import zlib
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborql.llm import _shared, components, fingerprints, media, mixing, packing, queries, simhash

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Null, empty, white space, ties, repeated rows, a long text and awkward characters.
ROWS = [(0, "a b c d e"), (1, None), (2, ""), (3, " \t\n"), (4, "A  b\nC d e"), (4, "A  b\nC d e"), (5, "word " * 30000), (6, "Ää ﬁn Ⅰ \U0001f600 x"), (7, "ää fin I \U0001f600 X"), (8, "one"), (9, "one two"), (None, "no id"), (11, "a b c d f")]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}", len(t or "")) for i, t in ROWS]
    spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)).withColumn("id", F.lit("x")).withColumn("size", F.lit(2)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["op1_simhash", "op6_packing", "op7_fingerprints", "op9_mixing", "op10_media"])
def test_empty_tables(spark, folder, name):
    assert queries.queries()[name](spark, f"{folder}/none").count() == 0


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    if not words:
        return 0
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius=2):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_query(spark, folder):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, folder).collect()}
    fps = {i: slow_fingerprint(t) for i, t in ROWS if i is not None}
    roots = slow_components(fps)
    assert {x for x in got if x[0] is not None} == {(i, f"{fps[i]:016x}", roots[i]) for i in fps}


def test_covering_masks_lose_no_pair():
    tables = simhash.masks(2)
    for bits in combinations(range(64), 2):
        flip = sum(1 << b for b in bits)
        assert any(m & flip == 0 for m in tables)


def test_links_of_crowded_and_small_buckets(spark):
    rng = random.Random(3)
    fps = set()
    for size in (1, 2, 5, 40, 200):
        at = rng.getrandbits(64)
        for _ in range(size):
            fps.add(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                at ^= 1 << b
    fps |= {0, 1, 3, 7, 15, 31, (1 << 64) - 1, (1 << 63) - 1}
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in components.components(simhash.link(df)).collect()}
    want = slow_components({simhash._signed(x): x for x in sorted(fps, key=simhash._signed)})
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert {g for g in groups(want) if len(g) > 1} == groups(got)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_packing_query(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op6_packing(spark, folder).collect()
    seen, windows = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in ROWS:
        if i == 4:
            continue
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(seen[i], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r.length
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_the_tightest(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64) for _ in range(200)]
    places, n = packing.best_fit(lengths, 64)
    rooms = []
    for i in sorted(range(200), key=lambda i: (-lengths[i], i)):
        fit = [r for r in rooms if r >= lengths[i]]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - lengths[i])
        else:
            rooms.append(64 - lengths[i])
    left = [64] * n
    for (w, o), x in zip(places, lengths, strict=True):
        left[w] -= x
    assert sorted(left) == sorted(rooms)


def test_encoder_equals_whole_encoding():
    encode = packing.Encoder(queries.tokenizer_path())
    assert encode.ranked
    for text in ["Hello  world\n\n it's 12345 café!!", "你好 x <|endoftext|> y", "a b  c", "tab\tand  spaces   ", "İstanbul ǅ ʰ"]:
        assert list(struct.unpack(f"<{len(encode(text)) // 4}I", encode(text))) == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_fingerprint_query(spark, folder):
    rows = queries.op7_fingerprints(spark, folder).collect()
    order = sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        if i == 4:
            continue
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_next == float(fingerprints.canonical(t) == fingerprints.canonical(n))
        assert got[i].near_edited == float(fingerprints.canonical(t) == fingerprints.canonical(edited))
    assert got[6].fingerprint == got[7].fingerprint and got[0].fingerprint == got[4].fingerprint != got[11].fingerprint


def test_colliding_digests_are_told_apart(spark):
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(120)], "i long, t string")
    rows = fingerprints.exact_fingerprints(df, "i", "t", bits=4).collect()
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.id % 40)
    assert len(rows) == 120 and len(by) == 40 and all(len(v) == 1 for v in by.values())
    assert {r.copies for r in rows} == {3}


def slow_targets(totals, most=3.0):
    names = sorted((x for x in totals if x is not None), key=lambda x: x.encode()) + [None] * (None in totals)
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(totals.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * totals[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = most * totals[s]
            left -= target[s]
        open_ -= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", "b", "zz", "é", None, "tiny"] if i > 3 else ["tiny"]), rng.randint(0, 60)) for i in range(3000)]
    rows += [(5000, "one", 7), (5001, "void", 0), (5002, "b", 900)]
    got = mixing.mix(spark.createDataFrame(rows, "d long, s string, n long"), "d", "s", F.col("n")).collect()
    assert sorted((r.id, r.size) for r in got) == sorted((a, c) for a, _, c in rows)
    totals = {}
    for _, s, n in rows:
        totals[s] = totals.get(s, 0) + n
    want = slow_targets(totals)
    taken = {}
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        assert r.rate == pytest.approx(r.target / r.source_size if r.source_size else 1.0)
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(60 if s != "one" else 7, 0.01 * want[s])


def test_mixing_query_handles_nulls(spark, folder):
    rows = queries.op9_mixing(spark, folder).collect()
    assert len(rows) == len(ROWS) and sum(r.size for r in rows) == sum(len((t or "").split()) for _, t in ROWS)
    again = queries.op9_mixing(spark, folder).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_media_query(spark, folder):
    rows = {r.doc_id: r for r in queries.op10_media(spark, folder).collect()}
    for i, t in ROWS:
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        file = media.audio_file(payload)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())


def test_media_tables_of_other_files(spark):
    sizes = [10, 20, 30, 5, 6]
    body = bytes(range(71))
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))), media.full(b"stts", struct.pack(">III", 1, 5, 100)), media.full(b"stss", struct.pack(">III", 2, 1, 4)), media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 3, 1, 1)), media.full(b"stsz", struct.pack(">II", 0, 5), struct.pack(">5I", *sizes)), media.full(b"co64", struct.pack(">IQQQ", 3, 8, 40, 80)))
    mdhd = media.full(b"mdhd", struct.pack(">QQIQI", 0, 0, 1000, 500, 0), version=1)
    file = media.box(b"mdat", body + bytes(100)) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    (track,) = media.tracks(file)
    starts, ends = track.keyframes()
    assert (track.codec, track.timescale, track.duration, track.units) == ("avc1", 1000, 500, 5)
    assert list(zip(starts, ends, strict=True)) == [(8, 18), (70, 75)]
    broken = [None, b"", b"abc", file[:-9], struct.pack(">I4s", 4, b"moov"), media.box(b"moov", media.box(b"trak"))]
    out = media.media_columns(spark.createDataFrame([(x, "c") for x in broken], "m binary, media_codec string"), "m").collect()
    assert [r.media_codec for r in out] == [None] * len(broken) and all(r.media_error for r in out)


def test_shared_folder_is_read_from_the_session(spark):
    assert _shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
