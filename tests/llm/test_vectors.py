"""Anchors on difference covers, exact vector codes and delta rounds against plain versions, on odd input too."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvia.llm import anchor_dedup as a, delta_lloyd, integers, queries, vector_codes

DIR = "/root/testdata/sf0.001"


def plain_passages(rows, length):
    """(doc_id, text) -> for each row its words and the set of words that go; by the definition."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is None, i if i is not None else 0)
    first = {}
    for i, w in words:
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in words:
        gone, own = set(), set()
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            if first[key] < order(i) or key in own:
                gone |= set(range(p, p + length))
            own.add(key)
        out.append((i, w, gone))
    return out


def passages_of(spark, rows, length=20):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in a.passage_digests(df, length).collect())
    want = sorted(
        (i is None, i, len(w), len(g), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in g)).hexdigest())
        for i, w, g in plain_passages(rows, length)
    )
    return got, want


@pytest.mark.parametrize("period", a.COVERS)
def test_covers(period):
    assert a.is_cover(period, a.COVERS[period])


def test_equal_windows_share_an_anchor_wherever_they_stand():
    for length in (5, 8, 20, 50):
        period, residues, size = a.cover_for(length)
        assert period + size - 1 == length
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in residues and (j + d) % period in residues for d in range(period))


def test_word_hashes_know_words_alone():
    h = a.Hashes()
    one, two = h.words("ab  c\tab\x0b x ".encode()), h.words(b"ab c")
    assert len(one) == 4 and one[0] == one[2] == two[0] and one[1] == two[1] and len(set(one.tolist())) == 3
    assert len(h.words(b"")) == len(h.words(b" \n ")) == 0
    assert (h.words(b"z " * 40_000 + b"ab") == h.words(b"ab")[0])[-1]


def test_passages_equal_the_definition(spark):
    rng = np.random.default_rng(5)
    pool = [[f"w{x}" for x in rng.integers(0, 50, n)] for n in (19, 20, 21, 45, 90)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.integers(0, 5)):
            p = pool[rng.integers(0, len(pool))]
            text += p[rng.integers(0, 4) :] if rng.random() < 0.7 else [f"u{x}" for x in rng.integers(0, 9, 30)]
        rows.append((int(rng.integers(0, 40)) if i % 9 else None, " ".join(text)))
    rows += [(7, rows[3][1]), (7, rows[3][1]), (99, rows[3][1]), (100, None), (101, ""), (102, " \n"), (103, "a " * 19), (104, "a " * 21), (None, "a " * 21)]
    for length in (20, 8):
        got, want = passages_of(spark, rows, length)
        assert got == want


def test_long_texts_and_many_documents_with_one_passage(spark):
    shared = " ".join(f"s{i}" for i in range(25))
    rows = [(i, f"own{i} words{i} " * (i % 30) + shared + f" end{i}" * (i % 7)) for i in range(1500)]
    rows += [(5000, " ".join(f"x{i % 40_000}" for i in range(60_000))), (4000, " ".join(f"x{i}" for i in range(30_000, 30_050)))]
    got, want = passages_of(spark, rows)
    assert got == want


def test_passages_keep_other_columns(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")
    for name in ("row", "copy", "starts", "anchors", "tag", "a.b", "at", "first"):
        df = df.withColumn(name, F.lit(name))
    out = a.earlier_passages_removed(df).orderBy("doc_id").collect()
    assert out[1]["a.b"] == "a.b" and out[1]["row"] == "row" and out[0].kept == text and out[1].kept == "more"
    assert [(s.a, s.b) for s in out[1].spans] == [(0, 30)] and out[0].n_words == 30
    assert a.earlier_passages_removed(df.limit(0)).count() == 0


# --- vectors

SOME = "vec_id long, embedding array<double>, label int"


def plain_codes(rows, scale=256, positions=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(scale * x) for x in r[1]] for r in kept]
    w = len(whole[0]) // positions
    part = lambda v, p: tuple(v[p * w : p * w + w])
    books = [[part(v, p) for v in whole[:entries]] for p in range(positions)]
    far = lambda x, y: sum((m - n) ** 2 for m, n in zip(x, y))
    for step in range(rounds + 1):
        index = [[min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e)) for p in range(positions)] for v in whole]
        if step == rounds:
            break
        for p in range(positions):
            mine = defaultdict(list)
            for v, i in zip(whole, index):
                mine[i[p]].append(part(v, p))
            for e, parts in mine.items():
                books[p][e] = tuple(sum(c) // len(parts) for c in zip(*parts))
    errors = [sum(far(part(v, p), books[p][i[p]]) for p in range(positions)) for v, i in zip(whole, index)]
    errors = [e if e < 1 << 63 else None for e in errors]  # what a long cannot hold is null, and in no sum
    by = defaultdict(lambda: None)
    for r, e in zip(kept, errors):
        if e is not None:
            by[r[2]] = (by[r[2]] or 0) + e
    name = hashlib.sha256(",".join(str(c) for b in books for x in b for c in x).encode()).hexdigest()
    return [(r[0], "".join(f"{x:02x}" for x in i), e, by[r[2]], name) for r, i, e in zip(kept, index, errors)]


def odd_vectors(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(0, scale, width)).tolist(), int(rng.integers(0, 4)) if i % 5 else None) for i in rng.permutation(n)]
    rows += [rows[0], (rows[1][0], rows[2][1], 9), (None, rows[3][1], 1), (n + 1, [0.0] * width, None), (n + 2, [-0.001] * width, 2)]
    bad = [(n + 3, None, 1), (n + 4, [float("nan")] + [0.0] * (width - 1), 1), (n + 5, [None] * width, 1), (n + 6, [float("-inf")] * width, 1)]
    return rows + bad


@pytest.mark.parametrize("scale", [0.05, 3.0, 30_000.0, 1e9])
def test_codes_equal_plain_ones(spark, scale):
    rows = odd_vectors(200, 32, 3, scale)
    got = [tuple(r) for r in vector_codes.encode(spark.createDataFrame(rows, SOME)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain_codes(rows), key=key)


def test_screening_bounds_hold_and_ties_go_down():
    rng = np.random.default_rng(8)
    for top in (3, 1 << 12, 1 << 20, (1 << 27) - 1):
        x, c = rng.integers(-top, top, (300, 2, 4)), rng.integers(-top, top, (2, 20, 4))
        c[:, 11] = c[:, 4]
        low, high = vector_codes._intervals(x.transpose(1, 0, 2), c)
        true = np.array([[[int((e * e).sum()) - 2 * int((r * e).sum()) for e in c[p]] for r in x[:, p]] for p in range(2)], dtype=object)
        assert (low <= true).all() and (true <= high).all()
        index, d = vector_codes.nearest(x, c)
        exact = ((x[:, :, None].astype(object) - c[None].astype(object)) ** 2).sum(-1)
        assert (index == exact.argmin(-1)).all() and (d == exact.min(-1)).all() and not (index == 11).any()


def test_codes_of_few_rows_other_lengths_and_none(spark):
    df = spark.createDataFrame([(2, [1.0] * 16, 1), (1, [0.5] * 16, 1), (3, [1.0] * 8, 1), (4, [], 1)], SOME).withColumn("code", F.lit("x"))
    assert sorted((r.vec_id, r.code, r.error) for r in vector_codes.encode(df).collect()) == [(1, "00" * 16, 0), (2, "01" * 16, 0)]
    assert vector_codes.encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.encode(df.where("vec_id = 3"))


def plain_clusters(rows, width, clusters=8, rounds=10):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    name = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [whole[i] for i in sorted(range(len(kept)), key=lambda i: name(kept[i]))[:clusters]]
    far = lambda x, y: sum((m - n) ** 2 for m, n in zip(x, y))
    for step in range(rounds + 1):
        own = [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for v in whole]
        if step < rounds:
            for c in range(len(cents)):
                mine = [v for v, o in zip(whole, own) if o == c]
                if mine:
                    cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    d = [far(v, cents[o]) for v, o in zip(whole, own)]
    by = [sum(x for x, o in zip(d, own) if o == c) for c in range(len(cents))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(r[0], o, x, by[o], sum(d), names[o]) for r, o, x in zip(kept, own, d)]


@pytest.mark.parametrize(("n", "scale"), [(300, 0.1), (50, 4e4), (5, 0.1)])
def test_clusters_equal_plain_lloyd(spark, n, scale):
    rows = odd_vectors(n, 16, 4, scale)
    got = [tuple(r) for r in delta_lloyd.cluster(spark.createDataFrame(rows, SOME), width=16).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain_clusters(rows, 16), key=key)


def test_delta_round_equals_a_whole_one():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-9, 9, (500, 3)), rng.integers(-9, 9, (6, 3))
    owner, d = delta_lloyd.reassigned(x, np.full(500, -1), np.zeros(500, dtype=np.int64), c, np.ones(6, dtype=bool))
    for _ in range(20):
        changed = rng.random(6) < 0.4
        c = np.where(changed[:, None], rng.integers(-9, 9, (6, 3)), c)
        owner, d = delta_lloyd.reassigned(x, owner, d, c, changed)
        whole = delta_lloyd.distances(x, c)
        assert (owner == whole.argmin(axis=1)).all() and (d == whole.min(axis=1)).all()


def test_clusters_of_an_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame(odd_vectors(20, 64, 1), SOME).withColumns({"was": F.lit(1), "owner": F.lit("x"), "cluster": F.lit(0), "id": F.lit(0)})
    assert delta_lloyd.cluster(df).count() == 25 and delta_lloyd.cluster(df.limit(0)).count() == 0
    assert delta_lloyd.cluster(df, width=63).count() == 0


def test_floors_go_down_and_stay_exact():
    assert integers.floors([[-0.001, 0.5, 2.0]], 1024).tolist() == [[-2, 512, 2048]]
    big = integers.floors([[1e300, -3.5e9]], 256)
    assert big.tolist() == [[int(1e300) * 256, -896_000_000_000]] and not integers.narrow(big)


def test_queries_equal_plain_versions_on_whole_tables(spark):
    docs = queries.table(spark, DIR, "documents").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op11_passages(spark, DIR).collect())
    want = [(i, len(w), len(g), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in g)).hexdigest()) for i, w, g in plain_passages([tuple(d) for d in docs], 20)]
    assert got == sorted(want)
    vectors = [tuple(r) for r in queries.table(spark, DIR, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in queries.op13_delta_lloyd(spark, DIR).collect()) == sorted(plain_clusters(vectors, 64))
