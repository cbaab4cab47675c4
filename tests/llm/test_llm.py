"""The ten operators against brute force, exact round trips and held-out accuracy, and their odd inputs."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvia.llm import ann, html_tree, jaccard, line_dedup, mixing, mjpeg, packing, quality, suffix_dedup, token_count
from corvia.llm.components import components
from corvia.llm.queries import ORACLE_SQL, QUERIES, vocabulary

DIR = "/root/testdata/sf0.001"
ODD = [
    (1, None, "en", None, None), (2, "", "en", "a", 0), (3, "x", None, "a", 1), (4, "one two three four", "en", "b", 18),
    (4, "one two three four", "en", "b", 18), (None, "one two three four five", "en", "b", 23), (6, "w " * 3000, "en", "c", 6000),
    (7, "é\n\n日本語 \U0001f600", "fr", "c", 9), (8, " \n\t ", "fr", "a", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=ODD):
    """Odd rows, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit(-1), "key": F.lit("k"), "id": F.lit(0), "_hits": F.lit(1), "row": F.lit(2)})


def empty(spark):
    return frame(spark).limit(0)


# --- 1


def test_avi_round_trip_and_generic_decoder():
    for n in (0, 1, 576, 577, 20000):
        payload = mjpeg.pad_payload(random.Random(n).randbytes(n))
        assert len(payload) % 576 == 0 and len(payload) >= max(n, 576)
        media = mjpeg.store(payload)
        found, about = mjpeg.clips(media)
        assert about["stored"] == payload and about["frames"] == len(payload) // 576
        assert sum(c.n_frames for c in found) == about["frames"]
    stream = mjpeg.read_riff(media)
    histograms = np.concatenate([h for _, h in mjpeg.read_frames(media, stream)])
    for i, (at, size) in enumerate(stream.frames[:5]):
        levels, plane = mjpeg.decode_jpeg(media[at : at + size])
        used = levels[:, 1:49]
        assert np.where(used > 0, used, used + 255).astype(np.uint8).tobytes() == payload[i * 576 : (i + 1) * 576]
        assert (np.bincount(plane.reshape(-1) >> 3, minlength=32) == histograms[i]).all()


def test_avi_without_index_and_broken(spark):
    media = mjpeg.store(mjpeg.pad_payload(b"x" * 3000))
    bare = media[: media.rindex(b"idx1")]
    assert mjpeg.read_riff(bare).indexed == "movi" and mjpeg.clips(bare)[1]["stored"] == mjpeg.clips(media)[1]["stored"]
    files = spark.createDataFrame([(1, bytearray(media)), (2, bytearray(b"no")), (3, None)], "id long, media binary")
    rows = mjpeg.clip_rows(files, "id", "media").collect()
    assert {r.id for r in rows if r.error} == {2, 3} and all(r.n_frames for r in rows if r.id == 1)


def test_cuts_at_a_change():
    h = np.zeros((40, 32), dtype=int)
    h[:20, 3] = h[20:, 20] = 768
    assert mjpeg.cuts(h)[0].tolist() == [20]
    assert mjpeg.cuts(h[:1])[0].tolist() == [] and mjpeg.cuts(h[:0])[0].tolist() == []


def test_op1_digests(spark):
    rows = {r.doc_id: r for r in mjpeg.stored_text_features(frame(spark)).collect()}
    for doc_id, text, *_ in ODD:
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = rows[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    assert mjpeg.stored_text_features(empty(spark)).count() == 0


# --- 2


def repeats(rows, length):
    data = [((t or "").encode()) for _, t in rows]
    starts = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (k, _), b in zip(rows, data):
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(150):
        t = np.array([rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(1, 50))])
        expected = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == expected and np.argsort(suffix_dedup.suffix_ranks(t)).tolist() == expected
        lcp = suffix_dedup.permuted_lcp(t, sa)
        for a, b in zip(sa, sa[1:]):
            m = 0
            while max(a, b) + m < len(t) and t[a + m] == t[b + m]:
                m += 1
            assert lcp[b] == m


@pytest.mark.parametrize("hot", [1024, 10])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(n))
    passage = words(80)
    rows = [(i, words(rng.randrange(5, 40)) + passage[rng.randrange(40) : len(passage) - rng.randrange(40)] + words(rng.randrange(5, 40))) for i in range(60)]
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, passage), (102, passage), (103, "é" * 150), (104, None), (105, ""), (106, "z" * 199)]
    got = sorted((tuple(r) for r in suffix_dedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == repeats(rows, 200)


def test_repeats_on_odd_rows(spark):
    got = sorted((tuple(r) for r in suffix_dedup.repeat_digests(frame(spark)).collect()), key=str)
    assert got == repeats([(r[0], r[1]) for r in ODD], 200)
    assert suffix_dedup.repeat_digests(empty(spark)).count() == 0


# --- 3


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    tested = [(r.predicted, truth[k]) for k, r in rows.items() if r.held_out and k in truth]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    assert np.mean([p == y for p, y in tested]) > 0.95


def test_quality_on_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(frame(spark), none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (4, None), (None, 1), (6, 0), (7, 1), (8, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(frame(spark), some).collect())
    assert quality.classify(empty(spark), some).count() == 0


def test_word_sums_and_pooling_equal_plain_ones(spark):
    texts = ["a b c a", "b b!! c 12 d_e", "", None, "zeta a b c d e f g " * 30, "a"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    sums = np.zeros((quality.SLOTS, quality.WIDTH + 1), dtype=np.int64)
    hashed = lambda w: quality.xxhash.xxh3_64_intdigest(w.encode())

    def index(w):
        out = np.zeros(quality.WIDTH)
        for k in range(quality.NONZERO):
            bits = hashed(w) >> (6 * k) & 63
            out[bits >> 1] += 1 if bits & 1 else -1
        return out

    def slots(w):
        return [hashed(w) >> (24 + 14 * p) & (quality.SLOTS - 1) for p in range(quality.PROBES)]

    split = [quality.TOKEN.findall(x or "") for x in texts]
    for words in split:
        for i, w in enumerate(words):
            around = sum((index(words[j]) for j in range(max(0, i - 2), min(len(words), i + 3)) if j != i), np.zeros(quality.WIDTH))
            for slot in slots(w):
                sums[slot, :-1] += around.astype(np.int64)
                sums[slot, -1] += 1
    read = quality._read(df, "doc_id", "text")
    assert (quality.sketch(read) == sums).all()
    known = quality.WordVectors.of(sums)
    total = sums[:, -1].sum() // quality.PROBES
    got = {r.key: known.features(np.frombuffer(r.codes, dtype=np.int32)) for r in read.where("codes IS NOT NULL").collect()}
    for i, words in enumerate(split):
        v, w = [], []
        for word in words:
            slot = min(slots(word), key=lambda s: sums[s, -1])
            x = sums[slot, :-1] / max(np.linalg.norm(sums[slot, :-1]), 1e-12)
            v.append(x)
            w.append(quality.RARE / (quality.RARE + sums[slot, -1] / total))
        if not words:
            assert not got[i].any()
            continue
        v, w = np.array(v), np.array(w)[:, None]
        mean = (v * w).sum(axis=0) / w.sum()
        spread = np.sqrt(np.maximum((v * v * w).sum(axis=0) / w.sum() - mean**2, 0))
        near = (v[:-1] * v[1:]).sum(axis=0) / max(len(words) - 1, 1)
        assert np.allclose(got[i], np.concatenate([mean, spread, near]), atol=2e-3)


def test_temperature_is_the_best_of_those_tried():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    net = quality.fit(x, y)
    back = np.random.default_rng(3).permutation(600)[:120]
    z = net.logits(x[back])
    plain = [np.mean(np.log1p(np.exp(-np.where(y[back] > 0, 1, -1) * z / t))) for t in np.geomspace(0.25, 8, 121)]
    assert np.isclose(net.temperature, np.geomspace(0.25, 8, 121)[int(np.argmin(plain))])


def test_good_documents_are_those_predicted_good(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    odd = docs.withColumns({c: F.lit(1) for c in ("d", "_bad", "features", "a.b", "score")})
    odd = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("word " * 600_000)}))
    kept = quality.good_documents(odd, labels)
    assert kept.columns == odd.columns
    kept = {r.doc_id for r in kept.select("doc_id").collect()} - {None}
    # The added text is in the word counts of one and not of the other, so a few rows near one half may differ.
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert len(kept ^ good) <= 0.02 * docs.count()


# --- 4


def test_neighbours_are_found_exactly_enough(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:150] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert len(got) == 30
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        hit += len({i for i, _ in found} & set(best))
        assert all(abs(s - d[i]) < 1e-12 for i, s in found)
    assert hit >= 0.9 * 300
    assert [i for i, _ in got[0]] == list(range(100, 110))
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 7, 9)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [7, 9]


def test_neighbours_over_groups_large_numbers_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODES_IN_GROUP", 1)
    monkeypatch.setattr(ann, "CODES_IN_BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES_IN_BLOCK", 3)
    monkeypatch.setattr(ann, "QUERIES_IN_GROUP", 2)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 6))
    x[5] *= 1e60
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (20, (x[20] + 3).tolist()), (1001, [1.0, None]), (1002, [float("inf")] * 6)]
    odd = {c: F.lit(1) for c in ("id", "v", "q", "block", "codes", "rank", "score", "query_id")}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(odd).repartition(5)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 30 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert len(got) == 30
    hit = 0
    for q, found in got.items():
        d = {i: np.sqrt(((np.array(v) - x[q]) ** 2).sum()) for i, v in rows[:902] if i != q and i != 20}
        best = sorted(d, key=lambda i: (d[i], i))[:5]
        hit += len({i for i, _ in found} & set(best))
        assert all(s == d[i] for i, s in found if i in d)  # double precision
    assert hit >= 0.9 * 150


# --- 5


def test_pieces_cover_documents_and_sequences(spark):
    docs = frame(spark)
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), capacity=64).collect()
    encode = packing.encoder(vocabulary("byte_bpe_50k.json"), None)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    texts = {k: t for k, t, *_ in ODD}
    for k in texts:
        ids = [*encode(texts[k] or "").tolist(), 1]
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        starts = sorted({r.start for r in mine})
        assert sum(r.length for r in mine) == len(ids) * sum(d[0] == k for d in ODD)
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert starts[0] == 0
    assert packing.pack(empty(spark), vocabulary("byte_bpe_50k.json")).count() == 0


def test_both_tokenizers_agree(spark):
    fast, slow = (packing.encoder(vocabulary("byte_bpe_50k.json"), r) for r in (vocabulary("byte_bpe_50k.tiktoken"), None))
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(60).collect()] + ["a<|endoftext|>b", "日本 12", "  \n\n x"]
    for t in texts:
        assert fast(t).tolist() == slow(t).tolist()


def test_patterns_reach_the_bound():
    rng = random.Random(5)
    demand = Counter(rng.randrange(1, 257) for _ in range(20000))
    rows, n = packing.places(dict(demand), 256)
    placed = Counter()
    for c, first, end, *_ in rows:
        placed[c] += end - first
    assert placed == demand
    bound = sum(c * k for c, k in demand.items()) / 256
    assert n <= bound * 1.02
    assert packing.places({}, 256) == ([], 0)


# --- 6


def test_boilerplate_lines(spark):
    line = "this very line is everywhere"
    rows = [(i, f"own words of number {i}\n{line}\nshort", "en", f"s{i}", 0) for i in range(12)] + [(50, f"{line} but not quite\n{line}", "en", None, 0)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(frame(spark, rows), min_sites=10).collect()}
    assert got[0] == (3, 0, rows[0][1]) and got[5] == (3, 1, "own words of number 5\nshort") and got[50] == (2, 1, f"{line} but not quite")
    kept = line_dedup.dedup_lines(frame(spark, rows[:9]), min_sites=10).where("n_removed > 0")
    assert kept.count() == 0
    odd = line_dedup.dedup_lines(frame(spark)).collect()
    assert len(odd) == len(ODD) and sorted(str(r.text) for r in odd) == sorted(str(r[1]) for r in ODD)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_boilerplate_keeps_other_columns(spark):
    line = "this very line is everywhere"
    rows = [(i, line if i == 3 else f"own words of number {i}\n{line}", "en", f"s{i}", 7) for i in range(12)] + [(99, " \n", "en", "z", 2), (98, "one " * 500_000, "en", "z", 3)]
    odd = {c: F.lit("keep") for c in ("n_removed", "n_lines", "d", "h", "_hits", "a.b", "hash", "id")}
    df = spark.createDataFrame(rows, SCHEMA).withColumns(odd)
    out = line_dedup.without_boilerplate(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert all(r.n_removed == r.n_lines == r["a.b"] == "keep" for r in got.values())
    assert 3 not in got and 99 in got and got[98].n_chars == 3 and len(got[98].text) == 2_000_000
    assert got[0].n_chars == 7 and got[5].text == "own words of number 5" and got[5].n_chars == 21
    assert line_dedup.without_boilerplate(df.limit(0)).count() == 0


# --- 7


def linked(rows, n, num, den):
    sets, up = {}, {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.setdefault(k, []).append(s)
        up[k] = k

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(k, s) for k, many in sets.items() for s in many if s]
    for i, (a, s) in enumerate(flat):
        for b, t in flat[:i]:
            if den * len(s & t) >= num * len(s | t):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: top(k) for k in up}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, n, num):
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(250):
        w = list(base[: rng.choice([120, 118, 60])])
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, " \n"), (905, rows[3][1]), (905, "other text of the same id"), (906, "other text of the same id")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100).collect()}
    assert got == linked(rows, n, num, 100)


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "ALONE", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == linked(rows, 3, 90, 100)


def test_buckets_of_many_sizes_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "ALONE", 2)
    monkeypatch.setattr(jaccard, "STEP", 1.02)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(150):
        w = base[: rng.randint(60, 130)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    long = " ".join(f"v{i % 70_000}" for i in range(300_000))
    rows += [(1000, long), (1001, long + " tail"), (1002, "x" * 3_000_000)]
    for n, num in ((5, 80), (3, 90)):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100).collect()}
        assert {k: v for k, v in got.items() if k < 1000} == linked(rows[:150], n, num, 100)
        assert (got[1000], got[1001], got[1002]) == (1000, 1000, 1002)


def test_components_on_odd_rows(spark):
    got = jaccard.jaccard_components(frame(spark)).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2, 8, None)} == {1: (0, 1), 2: (0, 2), 8: (0, 8), None: (1, None)}
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_connected_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    up = {x: x for p in pairs for x in p}
    for _ in range(400):
        for u, v in pairs:
            up[u] = up[v] = min(up[u], up[v])
    assert got == {k: v for k, v in up.items() if any(k in p and p[0] != p[1] for p in pairs)}


# --- 8


def test_targets_and_shares(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "abcde"[i % 5] if i % 11 else None, 0) for i in range(2000)] + [(9000, "w " * 900, "en", "f", 0)]
    got = mixing.mix_to_weights(frame(spark, rows)).collect()
    source = {r[0]: r[3] for r in rows}
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        size[s] += r.size
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert sum(taken.values()) == sum(size.values())  # the schedule ends where the budget does
    assert all(abs(taken[s] - target[s]) <= 64 and target[s] <= 3 * size[s] + 1e-9 for s in target)
    words = Counter()
    for r in mixing.mix_to_weights(frame(spark, rows), packet=1).collect():
        words[source[r.doc_id]] += r.taken
    assert sum(words.values()) == sum(size.values()) and all(abs(words[s] - target[s]) <= 2 for s in target)
    again = mixing.mix_to_weights(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    served = mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA)).select("source", F.size(F.split(F.trim("text"), " +")).alias("n"))
    assert {r.source: r.n for r in served.groupBy("source").agg(F.sum("n").alias("n")).collect()} == {s: n for s, n in taken.items() if n}


def plain_mix(rows, targets, packet, repeats):
    """Words taken by (doc_id, text): every packet of every queue sorted by finish time, served to the budget."""
    queues, budget, total = defaultdict(list), 0, Counter()
    for doc_id, text, _, source, _ in rows:
        n = len((text or "").split())
        budget += n
        total[source] += n
        own = "" if doc_id is None else str(doc_id)
        draw = hashlib.md5(f"{own}:{hashlib.md5(text.encode()).hexdigest() if text is not None else ''}:mix".encode()).hexdigest()
        queues[source].append((draw, doc_id or 0, n, text))
    packets = []
    for source, queue in queues.items():
        at = 0
        for again in range(repeats):
            for draw, doc_id, n, text in sorted(queue, key=lambda q: q[:3]):
                for first in range(0, n, packet):
                    at += min(packet, n - first)
                    packets.append((at / targets[source], source is None, source or "", at, min(packet, n - first), (doc_id, text)))
    taken = Counter()
    for *_, n, doc in sorted(packets, key=lambda p: p[:4]):
        taken[doc] += min(n, budget)
        budget -= min(n, budget)
    return taken


def test_mix_equals_a_plain_schedule(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(150) if rng.random() < 0.9 else None, " ".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 40, 200]))),
             "en", rng.choice("aaab") if rng.random() < 0.9 else None, 0) for _ in range(300)]
    rows += [(i, f"w{i} " * 20_000, "en", "long", 0) for i in range(2)]
    got = mixing.mix_to_weights(frame(spark, rows), packet=7)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    by_size = {r.source_size: r.target for r in got.collect()}
    targets = {s: by_size[n] for s, n in sizes.items()}
    want = plain_mix(rows, targets, 7, 3)
    found = Counter()
    for r in got.collect():
        found[r.doc_id or 0, r["size"]] += r.taken
    merged = Counter()
    for (doc_id, text), n in want.items():
        merged[doc_id, len(text.split())] += n
    assert +found == +merged and sum(found.values()) == sum(sizes.values())


def test_the_mix_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (None, "d e", "en", "y", 3), (4, "f " * 500_000, "en", None, 9)]
    odd = {c: F.lit(c) for c in ("_served", "served", "d", "a.b", "tick", "taken", "end", "upto", "bucket", "limit")}
    df = spark.createDataFrame(rows, SCHEMA).withColumns(odd).withColumnRenamed("tick", "ti`ck")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.schema["a.b"].dataType == df.schema["a.b"].dataType
    got = out.collect()
    assert all(r["_served"] == "_served" and r["a.b"] == "a.b" and r["ti`ck"] == "tick" for r in got)
    assert sum(len(r.text.split()) for r in got) == 500_008
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_mixing_odd_rows(spark):
    got = mixing.mix_to_weights(frame(spark)).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_to_weights(empty(spark)).count() == 0
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix_to_weights(frame(spark, ODD[:2])).collect())


# --- 9

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li>Menu</ul></nav><!-- <p>gone</p> --><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>ly<br>broken&nbsp;line<p>Second  one<div class="ad">Buy</div>
<form><label>Mail</label><input></form><p>Last</p><section id="comments"><p>Nice!</p></section></article>
<aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://a.b/1", PAGE), (2, None, None), (3, "::", ""), (4, "http://a.b/4", "<p>Just <i>text"), (5, "http://a.b/5", "<article><p>cut &am <a href='x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("page", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html_tree.main_text(df).collect()}
    text = "Title & more First boldly broken line Second one Last"
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), 4: ("Just text", 9), 5: ("cut &am", 7)}
    assert html_tree.main_text(df.limit(0)).count() == 0


def test_template_blocks_go_without_articles(spark):
    rows = [(i, f"http://h.x/{i}", f"<body><div><p>Same top line</p><span>x</span></div><div>{'<p>own %d</p>' % i * (1 + i % 5)}</div></body>") for i in range(20)]
    got = html_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Same top line" not in r.text and f"own {r.page_id}" in r.text for r in got)


# --- 10


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_count.unigram_vocabulary(vocabulary("piece_bpe_32k.model"))
    names = [p for p, _ in pieces]
    exact = Tokenizer(models.Unigram(pieces, unk_id=names.index("<unk>"), byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_count.SPACE, prepend_scheme="always", split=True)
    texts = ["", " ", "  a  b", "a\nb c\n", "日本語 テスト", "\U0001f600 x", "▁a▁b", "<0x41> <unk>", "x" * 300]
    texts += [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(100).collect()]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("piece_bpe_32k.model")).collect()}
    assert got == {i: len(exact.encode(t, add_special_tokens=False).ids) for i, t in rows}
    odd = token_count.count_tokens(frame(spark), vocabulary("piece_bpe_32k.model")).collect()
    assert {r.n_tokens for r in odd if r.doc_id in (1, 2)} == {0}


def test_ties_go_to_the_longest_piece():
    count = token_count.word_counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -5.0)])
    assert count("ab") == (1, 0) and count("ba") == (2, 0) and count("c") == (1, 1) and count("abc") == (1, 0)


# --- queries


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{DIR}/{name_}.parquet'")
    expected = con.sql(ORACLE_SQL[name])
    columns = sorted(expected.columns)
    rows = QUERIES[name](spark, DIR).select(*columns).collect()
    plain = lambda x: x if isinstance(x, str) or x is None else round(float(x), 6)
    at = [expected.columns.index(c) for c in columns]
    assert sorted(str([plain(x) for x in r]) for r in rows) == sorted(str([plain(r[i]) for i in at]) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, i
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
