"""Quality classifier on random-indexing word vectors.

Word vectors. Every word has a sparse ternary index vector, made from its hash: no table, no vocabulary.
One pass over all documents adds, to the context vector of each word, the index vectors of the words
around it. Context vectors are kept as a count-min sketch keeps counts: a word adds to one slot for each
of PROBES hashes and is read from the slot that fewest words were added to, so a word that is not rare is
seldom disturbed, however many words there are, and the sketch has a size that does not depend on the
corpus. Sums are integers, the same in whatever order tasks end; they are added up in two steps, in blocks
of slots. The same pass writes the slots of each document's words, in order, so texts are taken apart once.

Documents. A document is the mean of its words' unit vectors, weighted by rarity (a / (a + frequency)), their
spread, and the mean of the products of neighbours, component by component: pooled word vectors and
nothing else. A network of two layers, in numpy, is fitted to a sample of about `max_labelled` labelled
documents (the only bound; those whose hash is under a threshold set from their number), stopping on a part
held back from the fit, on which a temperature is then chosen that calibrates its probabilities.

Defined results: null and empty texts have zero features and get the network's score for them; a
document labelled several times has the rounded mean of its labels; of rows with one id and several texts
that are labelled, the one with the least features teaches; null labels or ids teach nothing;
with labels of one kind only, or none, every score is the share of good labels (0.5 without any); rows
that repeat are scored each; empty input gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from corvia.llm.arrow import ROWS, map_rows
from corvia.llm.store import discard, materialise

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
WIDTH, NONZERO, WINDOW = 32, 4, 2
SLOTS, PROBES, BLOCK = 1 << 14, 2, 256
FEATURES = 3 * WIDTH
RARE = 1e-3
#: Tokens handled at once.
CHUNK = 40_000


class Words:
    """Words to numbers, in order of appearance, remembered up to a bound; 0 stands for no word.

    A text is cut at white space first, and what stands between is taken apart only once; strings of no end are not kept.
    """

    def __init__(self, most: int = 500_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes, self.codes = array("Q", [0]), array("i", [0])
        self.parts: dict[str, int] = {}
        self.first, self.count, self.flat = array("q"), array("q"), array("i")

    def _add(self, part: str) -> None:
        words = [part] if part.isalpha() else TOKEN.findall(part)
        self.parts[part] = len(self.first)
        self.first.append(len(self.flat))
        self.count.append(len(words))
        for w in words:
            number = self.known.get(w)
            if number is None:
                number = self.known[w] = len(self.hashes)
                h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                self.hashes.append(h)
                self.codes.append(h >> 6 * NONZERO & (1 << 14 * PROBES) - 1)
            self.flat.append(number)

    def codes_of(self, ids: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.codes, dtype=np.int32)[ids]

    def full(self) -> bool:
        return len(self.parts) > self.most or len(self.flat) > 4 * self.most

    def of(self, text: str | None) -> np.ndarray:
        found = text.split() if text else []
        if not found:
            return np.zeros(0, dtype=np.int32)
        for part in set(found).difference(self.parts):
            self._add(part)
        at = np.fromiter(map(self.parts.__getitem__, found), dtype=np.int64, count=len(found))
        n = np.frombuffer(self.count, dtype=np.int64)[at]
        ends = np.cumsum(n)
        places = np.repeat(np.frombuffer(self.first, dtype=np.int64)[at] - (ends - n), n) + np.arange(ends[-1])
        return np.frombuffer(self.flat, dtype=np.int32)[places] if len(self.flat) else np.zeros(0, dtype=np.int32)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Rows of few entries 1 or -1 (places that meet add up), from 6 bits of the hash each."""
    out = np.zeros((len(hashes), WIDTH), dtype=np.float32)
    rows = np.arange(len(hashes))
    for k in range(NONZERO):
        bits = (hashes >> np.uint64(6 * k)).astype(np.int64) & 63
        np.add.at(out, (rows, bits >> 1), np.where(bits & 1, 1, -1).astype(np.float32))
    return out


def slots_of(codes: np.ndarray) -> np.ndarray:
    """PROBES rows of slots, 14 bits of the hash each: those after the bits of the index vector."""
    return np.stack([codes >> 14 * p & (SLOTS - 1) for p in range(PROBES)])


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts x, its distinct values, and where each begins in that order."""
    order = np.argsort(x)
    ordered = x[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(x) else np.zeros(0, dtype=np.int64)
    return order, ordered[starts], starts


def context_sums(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids but 0, and for each the sum of the vectors up to WINDOW places around it; 0s keep texts apart.

    The last column counts how often the word was there.
    """
    x = vectors[ids]
    around = np.zeros((len(ids), WIDTH), dtype=np.float32)
    for gap in range(1, WINDOW + 1):
        around[gap:] += x[:-gap]
        around[:-gap] += x[gap:]
    order, words, starts = _grouped(ids)
    sums = np.empty((len(words), WIDTH + 1), dtype=np.int64)
    sums[:, :WIDTH] = np.add.reduceat(around[order], starts, axis=0) if len(ids) else 0
    sums[:, WIDTH] = np.diff(np.append(starts, len(ids)))
    return (words[1:], sums[1:]) if len(words) and words[0] == 0 else (words, sums)


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of two kinds: key (any column, also a whole row) and codes of each document; block, salt and sums of each task's part of the sketch."""
    names = ["key", "codes", "block", "salt", "sums"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), np.zeros((SLOTS, WIDTH + 1), dtype=np.int64)
        vectors, made = np.zeros((1, WIDTH), dtype=np.float32), 1
        rim = np.zeros(WINDOW, dtype=np.int32)
        held, n, any_row = [], 0, False

        def flush():
            nonlocal vectors, made
            known = len(words.hashes)
            if known > len(vectors):
                vectors = np.concatenate([vectors, np.zeros((max(known, 2 * len(vectors)) - len(vectors), WIDTH), dtype=np.float32)])
            vectors[made:known] = index_vectors(np.array(words.hashes[made:], dtype=np.uint64))
            made = known
            ids, found = context_sums(np.concatenate(held), vectors)
            for slots in slots_of(np.array(words.codes, dtype=np.int32)[ids]):
                order, used, starts = _grouped(slots)  # words that share a slot are added up first
                if len(used):
                    sums[used] += np.add.reduceat(found[order], starts, axis=0)
            if words.full():
                words.forget()
                made = 1

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                blobs = []
                for x in part.column(1).to_pylist():
                    any_row = True
                    ids = words.of(x)
                    blobs.append(words.codes_of(ids).tobytes())
                    held += [ids, rim]
                    n += len(ids)
                    if n >= CHUNK:
                        flush()
                        held, n = [], 0
                none = pa.nulls(len(blobs), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary()), none, none, pa.nulls(len(blobs), pa.binary())], names=names)
        if n:
            flush()
        if any_row:
            blocks = sums.reshape(SLOTS // BLOCK, -1)
            used = np.flatnonzero(np.abs(blocks).sum(axis=1))
            salt = int(xxhash.xxh3_64_intdigest(sums.tobytes()) % 16)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(used), kind_of_key), pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()),
                    pa.array([salt] * len(used), pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary()),
                ],
                names=names,
            )

    kind_of_key = to_arrow_type(docs.schema[key].dataType)
    schema = StructType([StructField("key", docs.schema[key].dataType)] + _parse_datatype_string("codes binary, block int, salt int, sums binary").fields)
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(gather, schema)


def sketch(read: DataFrame) -> np.ndarray:
    """The sketch of all context vectors: SLOTS rows of WIDTH sums and a count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                part = np.frombuffer(blob.as_buffer(), dtype=np.int64)
                total[block] = total[block] + part if block in total else part.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
            names=["block", "salt", "sums"],
        )

    schema = "block int, salt int, sums binary"
    parts = read.where("block IS NOT NULL").select("block", "salt", "sums")
    parts = parts.repartition(SLOTS // BLOCK, "block", "salt").mapInArrow(add, schema)
    rows = parts.repartition(SLOTS // BLOCK, "block").mapInArrow(add, schema).collect()  # SLOTS rows of numbers at most
    out = np.zeros((SLOTS // BLOCK, BLOCK * (WIDTH + 1)), dtype=np.int64)
    for r in rows:
        out[r["block"]] += np.frombuffer(r["sums"], dtype=np.int64)
    return out.reshape(SLOTS, WIDTH + 1)


@dataclass
class WordVectors:
    """What a sketch says of words, by slot: unit vectors, counts and weights by rarity."""

    units: np.ndarray
    counts: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray) -> WordVectors:
        vectors = sums[:, :WIDTH].astype(np.float64)
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        counts = sums[:, WIDTH]
        total = max(1, int(counts.sum()) // PROBES)
        return cls((vectors / np.where(norm > 0, norm, 1)).astype(np.float32), counts, (RARE / (RARE + counts / total)).astype(np.float32))

    def features(self, codes: np.ndarray) -> np.ndarray:
        """What a document is to the network, from the codes of its words: FEATURES numbers."""
        total, square, near, weight = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH), 0.0
        for at in range(0, len(codes), CHUNK):
            slots = slots_of(codes[at : at + CHUNK + 1])  # one more, for the product across the cut
            best = slots[0]
            for other in slots[1:]:
                best = np.where(self.counts[other] < self.counts[best], other, best)
            v, w = self.units[best], self.weights[best[:CHUNK]]
            own = v[:CHUNK]
            weight += float(w.sum(dtype=np.float64))
            total += w @ own
            square += w @ (own * own)
            near += np.einsum("ij,ij->j", v[:-1], v[1:])
        mean = total / max(weight, 1e-30)
        spread = np.sqrt(np.maximum(square / max(weight, 1e-30) - mean**2, 0))
        return np.concatenate([mean, spread, near / max(len(codes) - 1, 1)]).astype(np.float32)


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    base: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(((x - self.shift) / self.scale) @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -700, 700)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 120, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on minibatches; the epoch with the least loss on a held-back fifth is kept, then the temperature."""
    if len(y) == 0 or y.min() == y.max():
        return Network(np.zeros(1), np.ones(1), [], 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, train = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
    shift, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    net = Network(shift, scale, layers, 1.0)
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    best, kept, worse = np.inf, [p.copy() for p in layers], 0
    for _ in range(epochs):
        mixed = rng.permutation(train)
        for at in range(0, len(mixed), 256):
            rows = mixed[at : at + 256]
            u = (x[rows] - shift) / scale
            h = np.tanh(u @ layers[0] + layers[1])
            z = h @ layers[2] + layers[3]
            g = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y[rows]) / len(rows)
            gh = np.outer(g, layers[2]) * (1 - h**2)
            step += 1
            for i, d in enumerate((u.T @ gh + decay * layers[0], gh.sum(axis=0), h.T @ g + decay * layers[2], g.sum())):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d**2
                layers[i] = layers[i] - 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        net.layers = layers
        loss = _loss(net.logits(x[back]), y[back])
        if loss < best - 1e-5:
            best, kept, worse = loss, [np.array(p) for p in layers], 0
        else:
            worse += 1
            if worse >= 15:
                break
    net.layers = kept
    z = net.logits(x[back])
    net.temperature = float(min(np.geomspace(0.25, 8, 121), key=lambda t: _loss(z / t, y[back])))
    return net


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    return np.array(rows, dtype=np.float64).reshape(-1, FEATURES)


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def labelled(labels: DataFrame, label: str, held_out: int | None, max_labelled: int) -> DataFrame:
    """doc_id, y of about max_labelled labelled documents that may teach: those of the least hashes."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        known = known.where(_remainder() != held_out)
    known = known.groupBy("doc_id").agg(F.round(F.avg(label)).alias("y"))
    share = max_labelled / max(known.count(), 1)
    if share >= 1:
        return known
    return known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) < int(share * (1 << 40)))


def fit_on(codes: DataFrame, known: WordVectors, few: DataFrame) -> Network:
    """key, codes and doc_id, y of few documents -> the network."""
    met = codes.join(few.withColumnRenamed("doc_id", "key"), "key").select("key", "codes", "y")

    def make():
        def work(keys, blobs, ys):
            yield {"key": keys, "y": ys, "features": [known.features(np.frombuffer(b, dtype=np.int32)).tobytes() for b in blobs]}

        return work

    kind = codes.schema["key"].dataType.simpleString()
    pooled = map_rows(met, f"key {kind}, y double, features binary", make)
    sample = pooled.groupBy("key").agg(F.min(F.struct("features", "y")).alias("r")).select("r.*")
    rows = sorted(sample.collect(), key=lambda r: (r["features"], r["y"]))  # max_labelled rows or so
    return fit(_matrix([np.frombuffer(r["features"], dtype=np.float32) for r in rows]), np.array([r["y"] for r in rows], dtype=np.float64))


def _learned(
    docs: DataFrame, key: str, text: str, id_: str, labels: DataFrame, label: str, max_labelled: int, held_out: int | None
) -> tuple[DataFrame, WordVectors, Network]:
    """key and codes of each document, the word vectors and the network; id_ is where the key has the document's id."""
    read = materialise(_read(docs, key, text), "word-codes")
    codes = read.where("codes IS NOT NULL").select("key", "codes")
    known = WordVectors.of(sketch(read))
    return codes, known, fit_on(codes.select(F.col(id_).alias("key"), "codes"), known, labelled(labels, label, held_out, max_labelled))


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 8_000, held_out: int | None = 1
) -> DataFrame:
    """doc_id, text and doc_id, label -> doc_id, held_out, score, predicted.

    Labels of rows whose crc32(doc_id as text) leaves the remainder held_out by 3 are not learned from.
    """
    codes, known, net = _learned(docs, "doc_id", "text", "key", labels, label, max_labelled, held_out)

    def make():
        def work(keys, blobs):
            scores = net.scores(_matrix([known.features(np.frombuffer(b, dtype=np.int32)) for b in blobs]))
            yield {"doc_id": keys, "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_rows(codes, f"doc_id {kind}, score double, predicted int", make)
    return scored.select(
        "doc_id", F.coalesce(_remainder() == (1 if held_out is None else held_out), F.lit(False)).alias("held_out"), "score", "predicted"
    )


def good_documents(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 8_000, held_out: int | None = 1
) -> DataFrame:
    """docs without the rows that the classifier rejects, judged by their texts alone; all columns as they are."""
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    named = docs.select(F.struct(digest.alias("text"), "doc_id").alias("d"), "text")
    codes, known, net = _learned(named, "d", "text", "key.doc_id", labels, label, max_labelled, held_out)

    @F.pandas_udf("boolean")
    def good(blobs: pd.Series) -> pd.Series:
        return pd.Series(net.scores(_matrix([known.features(np.frombuffer(b, dtype=np.int32)) for b in blobs])) >= 0.5, dtype=bool)

    # A text's verdict goes back to its rows by digest, so texts are taken apart once and their codes can go.
    kept = materialise(codes.select(F.col("key.text").alias("t"), good("codes").alias("good")).where("good").select("t").distinct(), "good-texts")
    discard(codes)
    return docs.join(kept.hint("merge"), digest == F.col("t"), "left_semi")
