"""Word passages that stand earlier in the corpus, found by anchors on a difference cover.

A window is `length` consecutive words of one document. A window stands earlier if its words also start in a
document of smaller doc_id, or earlier in the same document; each word that such a window covers goes. Windows are
judged on the input, so the first of all copies of a passage stays whole.

Anchors. A difference cover of a period v is a set of residues such that for any two places i and j some shift
d < v brings both into the set. Only the short windows ("anchors") at those residues are hashed: two equal windows
of length words then share an equal anchor at the same shift, if an anchor has length - v + 1 words. An anchor
whose hash stands once in the corpus witnesses nothing. Here v = 13 has four residues, so under a third of all
places are hashed for windows of 20 words, and of these the few that stand twice are carried on.

Extension. Round an anchor that stands elsewhere, each window that can hold it is the anchor and the words on
either side; those windows alone get a digest of 128 bits. Windows alike meet in an aggregation that keeps the
smallest doc_id, not in pairs: a passage that a third of all documents show costs a row for each task. Texts that
are alike as a whole are known by digest, and one row of each kind goes through all this.

Defined results: null and empty texts, and texts of fewer than `length` words, lose nothing. A null doc_id comes
after all others. Rows with one doc_id are documents of their own of which none is earlier: they do not take words
from each other, only from themselves and from larger ids. An empty table gives no rows. Other columns pass through
earlier_passages_removed(), whatever their names but for `spans` and `kept`, which are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from corvia.llm.arrow import map_rows
from corvia.llm.store import discard, materialise

#: About the rows of an output batch.
MANY = 200_000
#: Perfect difference covers by period: every difference, once.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(length: int) -> tuple[int, tuple[int, ...], int]:
    """Period, residues and words of an anchor: the sparsest cover that leaves an anchor two fifths of the window."""
    period = max(v for v in COVERS if v == 1 or 5 * (length - v + 1) >= 2 * length)
    return period, COVERS[period], length - period + 1


def is_cover(period: int, residues: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in residues for b in residues} == set(range(period))


class Hashes:
    """Hashes of words and of runs of words, vectorised over a text: differences of running sums of powers, modulo 2^64."""

    def __init__(self):
        rng = np.random.default_rng(11)
        self.byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bases = [int(b) * 8 + 3 for b in rng.integers(1 << 58, 1 << 60, 3, dtype=np.uint64)]
        self.powers = [(np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))] * 3

    def _powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers[which][0]) < n:
            size = max(n, 1 << 14)
            base = self.bases[which]
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                x = np.full(size, b, dtype=np.uint64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            self.powers[which] = both[0], both[1]
        up, down = self.powers[which]
        return up[:n], down[:n]

    def _between(self, which: int, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self._powers(which, len(values) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:-1])])
        return mixed((sums[end] - sums[start]) * down[start])

    def words(self, data: bytes) -> np.ndarray:
        """A hash of each word of a text."""
        raw = np.frombuffer(data, dtype=np.uint8)
        inside = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return self._between(0, self.byte[raw], edges[::2], edges[1::2])

    def runs(self, which: int, words: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        return self._between(which, words, start, start + length)


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def anchor_places(n_words: int, length: int) -> np.ndarray:
    """The places of a text's anchors; none where no window fits."""
    period, residues, size = cover_for(length)
    if n_words < length:
        return np.empty(0, dtype=np.int64)
    at = np.arange(n_words - size + 1)
    return at[np.isin(at % period, residues)]


def windows_round(places: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """The starts of all windows that hold an anchor at one of these places, within the shifts of the period."""
    period, _, _ = cover_for(length)
    rise = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(rise, np.maximum(places - period + 1, 0), 1)
    np.add.at(rise, np.minimum(places, n_words - length) + 1, -1)
    return np.flatnonzero(np.cumsum(rise[: n_words - length + 1]) > 0)


# --- the whole corpus


def _row(docs: DataFrame) -> Column:
    """128 bits of a row; rows alike in id and text are one."""
    id_, text = F.col("doc_id").cast("string"), F.col("text")
    return F.unhex(F.md5(F.concat_ws("\0", id_.isNull().cast("string"), F.coalesce(id_, F.lit("")), F.coalesce(text, F.lit("")))))


def _is_later(id_: str, first: str) -> Column:
    return F.coalesce(F.col(id_) > F.col(first), F.col(id_).isNull() & F.col(first).isNotNull())


def _rows(docs: DataFrame) -> DataFrame:
    """row, copy: whether the whole text also stands under a smaller doc_id."""
    keys = docs.select(_row(docs).alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text"), "doc_id")
    first = keys.groupBy("text").agg(F.min("doc_id").alias("first"))
    return keys.join(first.hint("merge"), "text").groupBy("row").agg(F.max(_is_later("doc_id", "first")).alias("copy"))


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """row, text -> tag (64 bits of the row), anchor, again: its anchors, each once, and whether it stands there twice."""

    def make():
        hashes = Hashes()
        size = cover_for(length)[2]

        def work(tags, values):
            out: list[tuple] = []
            held = 0
            for t, text in zip(tags, values, strict=True):
                words = hashes.words((text or "").encode("utf-8", "surrogatepass"))
                at = anchor_places(len(words), length)
                if len(at):
                    h, n = np.unique(hashes.runs(1, words, at, size), return_counts=True)
                    out.append((np.full(len(h), t, dtype=np.int64), h.view(np.int64), n > 1))
                    held += len(h)
                if held > MANY:
                    yield _joined(out, "tag", "anchor", "again")
                    out, held = [], 0
            if out:
                yield _joined(out, "tag", "anchor", "again")

        return work

    return map_rows(texts.select(F.xxhash64("row").alias("tag"), "text"), "tag long, anchor long, again boolean", make)


def _joined(parts: list[tuple], *names: str) -> dict:
    """Columns from the pieces of several documents; what is no array stands for one value a document."""
    n = [max(len(x) for x in p if isinstance(x, np.ndarray)) for p in parts]
    return {
        name: np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for x, k in zip(c, n, strict=True) for _ in range(k)]
        for name, c in zip(names, zip(*parts, strict=True), strict=True)
    }


def _extended(texts: DataFrame, length: int) -> DataFrame:
    """row, doc_id, text, anchors that stand elsewhere -> row, doc_id, at, hi, lo, again: windows that hold one, their
    digests, and whether the same window starts earlier in the row."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ("row", "doc_id", "at", "hi", "lo", "again")

    def make():
        hashes = Hashes()
        size = cover_for(length)[2]

        def work(rows, ids, values, lists):
            out: list[tuple] = []
            held = 0
            for r, i, text, wanted in zip(rows, ids, values, lists, strict=True):
                words = hashes.words(text.encode("utf-8", "surrogatepass"))
                places = anchor_places(len(words), length)
                live = np.isin(hashes.runs(1, words, places, size), np.array(wanted, dtype=np.int64).view(np.uint64))
                start = windows_round(places[live], len(words), length)
                if not len(start):
                    continue
                one, two = hashes.runs(1, words, start, length), hashes.runs(2, words, start, length)
                order = np.lexsort((start, two, one))
                again = np.zeros(len(start), dtype=bool)
                again[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
                out.append((r, i, start, one.view(np.int64), two.view(np.int64), again))
                held += len(start)
                if held > MANY:
                    yield _joined(out, *names)
                    out, held = [], 0
            if out:
                yield _joined(out, *names)

        return work

    return map_rows(texts.select("row", "doc_id", "text", "anchors"), f"row binary, doc_id {kind}, at int, hi long, lo long, again boolean", make)


def _marks(docs: DataFrame, length: int) -> DataFrame:
    """row, copy, starts: of each row that loses words, whether all of its windows go, else the starts of those that do."""
    texts = docs.select(_row(docs).alias("row"), "doc_id", "text")
    rows = materialise(_rows(docs), "rows")
    anchors = materialise(_anchors(texts.join(rows.where("NOT copy").select("row").hint("merge"), "row"), length), "anchors")
    counted = anchors.groupBy("anchor").agg(F.min("tag").alias("a"), F.max("tag").alias("b"), F.max("again").alias("again"))
    live = materialise(counted.where("a < b OR again").select("anchor"), "live-anchors")
    wanted = anchors.join(live.hint("merge"), "anchor").groupBy("tag").agg(F.collect_set("anchor").alias("anchors"))  # of one text
    wanted = materialise(wanted, "anchors-of-texts")
    discard(anchors, live)
    held = texts.withColumn("tag", F.xxhash64("row")).join(wanted.hint("merge"), "tag")
    windows = materialise(_extended(held, length), "windows")
    fresh = windows.where("NOT again")
    kinds = fresh.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("loose"))
    kinds = materialise(kinds.where("first < last OR loose AND first IS NOT NULL").select("hi", "lo", "first"), "window-kinds")
    later = fresh.join(kinds.hint("merge"), ["hi", "lo"]).where(_is_later("doc_id", "first")).select("row", "at")
    later = later.unionByName(windows.where("again").select("row", "at"))
    found = later.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("starts"))  # of one text, however many rows have it
    nothing = F.array().cast("array<int>")
    marks = found.select("row", F.lit(False).alias("copy"), "starts").unionByName(rows.where("copy").select("row", "copy", nothing.alias("starts")))
    marks = materialise(marks, "marks")
    discard(rows, wanted, windows, kinds)
    return marks


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Sorted starts of windows -> maximal [from, to) of words that they cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first, last = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length
    return list(zip(first.tolist(), last.tolist(), strict=True))


def earlier_passages_removed(docs: DataFrame, length: int = 20) -> DataFrame:
    """docs with spans (maximal [from, to) of words that go), n_words, and kept: the other words, by single spaces."""
    marks = _marks(docs.select("doc_id", "text"), length)
    # The document is one column beside the join's own, so names cannot clash.
    joined = docs.select(_row(docs).alias("row"), F.struct("*").alias("d")).join(marks.hint("merge"), "row", "left")
    own = [c for c in docs.columns if c not in ("n_words", "spans", "kept")]
    more = _parse_datatype_string("n_words long, spans array<struct<a:int,b:int>>, kept string")
    schema = StructType([docs.schema[c] for c in own] + more.fields)

    def make():
        def work(*columns):
            *others, copies, lists = columns
            count, gone, kept = [], [], []
            for text, copy, starts in zip(others[own.index("text")], copies, lists, strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                spans = [(0, n)] if copy and n >= length else spans_of(np.array(starts or (), dtype=np.int64), length)
                edges = [0, *(x for s in spans for x in s), n]
                count.append(n)
                gone.append([{"a": a, "b": b} for a, b in spans])
                kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]).decode("utf-8", "surrogatepass"))
            yield dict(zip(own, others, strict=True)) | {"n_words": count, "spans": gone, "kept": kept}

        return work

    return map_rows(joined.select(*(F.col(f"d.`{c}`").alias(f"c{i}") for i, c in enumerate(own)), "copy", "starts"), schema, make)


def passage_digests(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    out = earlier_passages_removed(docs.select("doc_id", "text"), length)
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["b"] - s["a"]).cast("long")
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
