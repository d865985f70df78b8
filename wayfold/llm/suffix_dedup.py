"""Suffix-array dedup: every byte that a string of `size` bytes with an earlier start covers is removed.

Texts are UTF-8 bytes in blocks; a text of more than `piece_bytes` is cut into pieces, each with the bytes that
its last windows reach over, and put together again at the end. Of the k-grams in each window of `size` bytes the
one with the least hash (the leftmost of equals) is the window's anchor: equal windows have equal anchors at equal
offsets, so what repeats can be found from anchors, of which there is about one in (size - k) / 2 bytes.

1. A block asks, for each distinct anchor k-gram, the partition of its hash: who holds it first, and do all its
   occurrences have the same context (the text of all windows that it anchors)? If they do, all but the first
   are repeats, and nothing more is sent for them.
2. Only for anchors with several contexts, their windows themselves are asked for.

The partitions keep a logarithmic family of sparse suffix arrays, ordered by prints: a block's sorted suffixes (by
the print of their first `size` bytes, or of their k-gram) come in as a new array, which is merged with levels of
its size as long as there is one; equal entries meet in a merge and the earlier start stays. The whole family
is then scanned against each block's array to answer it. An array sorted by prints finds the same matches of
`size` bytes as one in lexicographic order.

Two prints must agree before a byte goes: 64 bits of the k-gram and 64 of the context, or 64 of the window and 32 of
its anchor. Windows that agree in the first and differ in the second all stay.

A passage or line that a third of all documents hold is one entry of each block, and its edges, where contexts
differ, are spread by the prints of their windows. All intermediate data are written tables.

Order: documents by doc_id, then starts. Rows that repeat a doc_id are in the order of blocks and rows, the
later a copy of the earlier. A null doc_id comes after all others. A null text is an empty one. Texts of less
than `size` bytes lose nothing. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship, table, written
from .hashing import U, mix, pack, unpack
from .katz import _dealt, _zip

SIZE, K = 100, 32
BLOCK_BYTES = 2 << 20
#: A longer text is cut into pieces of so many bytes, each with the bytes that its last windows reach over.
PIECE_BYTES = 1 << 20
PART_BYTES = 16 << 20
#: Window starts that are hashed at once: some 100 bytes of memory for each.
SEGMENT = 1 << 17
#: Texts travel three times and are compressed once.
TEXT_LEVEL = 6
LAST = np.int64(2**63 - 1)
BASE = 0x9E3779B97F4A7C15 | 1
_BITS = 32
_TABLE = mix(np.arange(1, 257).astype(U))


@lru_cache(maxsize=1)
def _all_powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, U(BASE)), np.full(1 << bits, U(pow(BASE, -1, 1 << 64)))
    up[0], down[0] = 1, 1
    return np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64, the last table kept."""
    up, down = _all_powers(max(20, n.bit_length()))
    return up[:n], down[:n]


class Hashes:
    """Hashes of substrings of a text."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.r_[U(0), np.cumsum(_TABLE[data] * up[:-1], dtype=U)]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(v) - w + 1
    pad = np.r_[v, np.full(-len(v) % w, ~U(0))].reshape(-1, w)
    before = np.minimum.accumulate(pad, 1).ravel()
    after = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


class Runs:
    """The anchors of a block: where each is, its windows' first and last starts, its k-gram's hash and its context's.

    A run ends where a segment does; what follows is a run of the same anchor with another context."""

    def __init__(self, data: bytes, sizes: np.ndarray, size: int, k: int, segment: int = SEGMENT):
        self.raw, self.size, self.k, self.segment = np.frombuffer(data, np.uint8), size, k, segment
        ends = np.cumsum(sizes)
        got = [self._segment(x, ends) for x in range(0, max(0, len(self.raw) - size + 1), segment)]
        none = np.zeros(0, np.int64)
        self.at, self.lo, self.hi = (np.concatenate([none, *(g[i] for g in got)]) for i in range(3))
        self.keys, self.contexts = (np.concatenate([none.astype(U), *(g[i] for g in got)]) for i in (3, 4))

    def _segment(self, begin: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        size, k = self.size, self.k
        raw = self.raw[begin : begin + self.segment + size - 1]
        starts = np.arange(begin, begin + len(raw) - size + 1)
        p = np.flatnonzero(ends[np.searchsorted(ends, starts, "right")] - starts >= size)
        if not len(p):
            return (p, p, p, p.astype(U), p.astype(U))
        hashes = Hashes(raw)
        grams = hashes.of(np.arange(len(raw) - k + 1), np.arange(k, len(raw) + 1))
        low = (U(1) << U(_BITS)) - U(1)
        least = _least((grams & ~low) | np.arange(len(grams)).astype(U), size - k + 1)
        anchor = (least[p] & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        at, lo, hi = anchor[first], p[first], p[np.r_[first[1:] - 1, len(p) - 1]]
        shape = (at - lo).astype(U) << U(32) | (hi - lo).astype(U)
        # an anchor is the least of its neighbours: mixed again, its hash is spread over all partitions
        return at + begin, lo + begin, hi + begin, mix(grams[at] + U(1)), mix(hashes.of(lo, hi + size) ^ mix(shape + U(1)))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of the windows of some anchors (in ascending order)."""
        n = self.hi[which] - self.lo[which] + 1
        begin = np.repeat(self.lo[which] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        prints = np.empty(len(begin), U)
        cuts = np.searchsorted(begin, np.arange(0, len(self.raw) + self.segment, self.segment))
        for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if x < y:
                base = i * self.segment
                prints[x:y] = Hashes(self.raw[base : base + self.segment + self.size - 1]).of(begin[x:y] - base, begin[x:y] - base + self.size)
        return begin, prints


class Family:
    """A logarithmic family of sorted arrays: keys, the earliest holder (document, then block), least and greatest context."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        keys, doc, block, low, high = (np.concatenate(x) for x in zip(a, b, strict=True))
        by = np.lexsort((block, doc, keys))
        keys, doc, block, low, high = keys[by], doc[by], block[by], low[by], high[by]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        if not len(first):
            return keys, doc, block, low, high
        return keys[first], doc[first], block[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)

    def add(self, run: tuple[np.ndarray, ...]) -> None:
        while self.levels and len(self.levels[-1][0]) <= 2 * len(run[0]):
            run = self.merged(self.levels.pop(), run)
        self.levels.append(run)

    def scan(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """For sorted keys that the family has: the earliest document and block, the least and greatest context."""
        doc, block = np.full(len(keys), LAST), np.full(len(keys), LAST)
        low, high = np.full(len(keys), ~U(0)), np.zeros(len(keys), U)
        for k, d, b, lo, hi in self.levels:
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            hit = k[at] == keys
            at = at[hit]
            better = (d[at] < doc[hit]) | (d[at] == doc[hit]) & (b[at] < block[hit])
            doc[hit], block[hit] = np.where(better, d[at], doc[hit]), np.where(better, b[at], block[hit])
            low[hit], high[hit] = np.minimum(low[hit], lo[at]), np.maximum(high[hit], hi[at])
        return doc, block, low, high


BLOCK = "block bigint, bytes bigint, ids binary, null binary, rows binary, offsets binary, mine binary, sizes binary, text binary"
#: A piece's row, its first byte and how many bytes are its own.
LISTS = ("ids", "null", "rows", "offsets", "mine", "sizes")


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES, size: int = SIZE) -> DataFrame:
    """A written table of blocks of pieces, in the order of doc_id and of the pieces of a text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        blocks_, seen, pieces, held = 0, 0, [], 0

        def block() -> pa.RecordBatch:
            pieces.sort(key=lambda r: r[0])
            columns = {n: np.array([int(p[i]) for p in pieces], np.int64) for i, n in enumerate(LISTS[:-1])}
            columns["sizes"] = np.array([len(p[-1]) for p in pieces], np.int64)
            blobs = [pack(columns[n], False) for n in LISTS] + [_zip(b"".join(p[-1] for p in pieces), TEXT_LEVEL)]
            names = [x.split()[0] for x in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([base + blocks_]), pa.array([int(columns["mine"].sum())]), *[pa.array([x], pa.binary()) for x in blobs]], names=names)

        for b in batches:
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                doc, data = doc.as_py(), (text.as_py() or "").encode("utf-8", "surrogatepass")
                seen += 1
                for at in range(0, max(1, len(data)), piece_bytes):
                    piece, own = data[at : at + piece_bytes + size - 1], min(piece_bytes, len(data) - at)
                    if pieces and held + len(piece) > block_bytes:
                        yield block()
                        pieces, held, blocks_ = [], 0, blocks_ + 1
                    pieces.append((int(LAST) if doc is None else doc, doc is None, base + seen, at, own, piece))
                    held += len(piece) + 48
        if pieces:
            yield block()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK), "blocks")


class Block:
    def __init__(self, row: dict, size: int, k: int):
        import zstandard

        for n in LISTS:
            setattr(self, n, unpack(row[n], False).view(np.int64))
        self.data = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=int(self.sizes.sum()) + 1) if self.sizes.sum() else b""
        self.runs = Runs(self.data, self.sizes, size, k)
        self.ends = np.cumsum(self.sizes)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, at, "right")]


ASK = "part int, block bigint, keys binary, docs binary, low binary, high binary"


def _questions(block: int, keys: np.ndarray, docs: np.ndarray, low: np.ndarray, high: np.ndarray, deal: int) -> list[tuple]:
    """Rows of ASK for distinct sorted keys."""
    return [(p, block, pack(keys[x:y]), pack(docs[x:y], False), pack(low[x:y], False), pack(high[x:y] ^ low[x:y], False)) for p, x, y in _dealt(keys, deal)]


def _answered(questions: DataFrame) -> DataFrame:
    """For each question's keys, two bits: this block holds the first; the contexts differ."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        family, asked = Family(), []
        for r in g.sort_values("block").itertuples(index=False):
            keys, low = unpack(r.keys), unpack(r.low, False)
            family.add((keys, unpack(r.docs, False).view(np.int64), np.full(len(keys), r.block, np.int64), low, unpack(r.high, False) ^ low))
            asked.append((int(r.part), int(r.block), keys))
        out = []
        for part, block, keys in asked:
            _, first, low, high = family.scan(keys)
            out.append((part, block, len(keys), np.packbits(first == block).tobytes(), np.packbits(low != high).tobytes()))
        return pd.DataFrame(out, columns=["part", "block", "n", "own", "several"])

    return questions.groupBy("part").applyInPandas(run, "part int, block bigint, n int, own binary, several binary")


def _bits(g: pd.DataFrame, name: str) -> np.ndarray:
    """A block's answers in the order of its keys."""
    got = [np.unpackbits(np.frombuffer(b, np.uint8))[: int(n)] for b, n in zip(g[name], g["n"], strict=True)]
    return np.concatenate(got).astype(bool) if got else np.zeros(0, bool)


def _with_answers(rows: DataFrame, answers: DataFrame, *kinds: int) -> DataFrame:
    """Blocks and their answers in one group for each block. kind 0: the block."""
    blank = lambda schema: [F.lit(None).cast(t).alias(n) for n, t in schema]
    own, got = [(n, t) for n, t in rows.dtypes if n != "block"], [(n, t) for n, t in answers.dtypes if n not in ("block", "kind")]
    left = rows.select(F.lit(0).alias("kind"), "block", *[n for n, _ in own], *blank(got))
    return left.unionByName(answers.select("kind", "block", *blank(own), *[n for n, _ in got]))


def _anchors(b: Block) -> tuple[np.ndarray, ...]:
    """Distinct keys, their first run, each run's key."""
    # runs are in the order of documents and starts, so the first of equal keys is the earliest
    distinct, first, back = np.unique(b.runs.keys, return_index=True, return_inverse=True)
    return distinct, first, back.ravel()


def _bounds(of: np.ndarray, back: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value of each of n keys."""
    low, high = np.full(n, ~U(0)), np.zeros(n, U)
    np.minimum.at(low, back, of)
    np.maximum.at(high, back, of)
    return low, high


def _windows(b: Block, back: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct windows of the runs whose contexts differ, their first place, all starts, each one's window and its anchor's hash."""
    which = np.flatnonzero(several[back]) if len(back) else np.zeros(0, np.int64)
    begin, prints = b.runs.windows(which)
    lane = np.repeat(b.runs.keys[which] >> U(32), b.runs.hi[which] - b.runs.lo[which] + 1)
    distinct, first, again = np.unique(prints, return_index=True, return_inverse=True)
    return distinct, first, begin, again.ravel(), lane


def removed(b: Block, repeats: np.ndarray, size: int) -> np.ndarray:
    """Which bytes are covered by windows that start at `repeats`."""
    edge = np.zeros(len(b.data) + 1, np.int32)
    np.add.at(edge, repeats, 1)
    np.add.at(edge, repeats + size, -1)
    return np.cumsum(edge, dtype=np.int32)[:-1] > 0


SPANS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
_NAMES = [x.split()[0] for x in SPANS.split(", ")]


def _row(doc, mask: np.ndarray, raw: np.ndarray, with_text: bool) -> tuple:
    """A row of SPANS for a whole text."""
    kept = raw[~mask].tobytes()
    spans = int(np.count_nonzero(mask & ~np.r_[False, mask[:-1]])) if len(mask) else 0
    return (doc, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text)


def deduped(docs: DataFrame, size: int = SIZE, k: int = K, block_bytes: int = BLOCK_BYTES, with_text: bool = False, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A row of SPANS for every row of docs; with_text adds `kept`, the remaining bytes."""
    spark = docs.sparkSession
    rows = blocks(docs, block_bytes, piece_bytes, size)
    deal = int(max(partitions(spark), (rows.agg(F.sum("bytes").alias("n")).first()["n"] or 0) // PART_BYTES + 1))
    names = ["part", "block", "keys", "docs", "low", "high"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row, size, k)
                keys, at, back = _anchors(b)
                asked = _questions(row["block"], keys, b.doc(b.runs.at[at]), *_bounds(b.runs.contexts, back, len(keys)), deal)
                types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in asked], t) for j, t in enumerate(types)], names=names)

    def second(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["kind", "part"])
        row = g[g["kind"] == 0].iloc[0].to_dict()
        b, several = Block(row, size, k), _bits(g[g["kind"] == 1], "several")
        _, _, back = _anchors(b)
        prints, at, begin, again, lane = _windows(b, back, several)
        return pd.DataFrame(_questions(int(row["block"]), prints, b.doc(begin[at]), *_bounds(lane, again, len(prints)), deal), columns=names)

    def last(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["kind", "part"])
        b = Block(g[g["kind"] == 0].iloc[0].to_dict(), size, k)
        anchors, windows = g[g["kind"] == 1], g[g["kind"] == 2]
        own, several = _bits(anchors, "own"), _bits(anchors, "several")
        _, at, back = _anchors(b)
        is_first = np.zeros(len(back), bool)
        is_first[at] = own
        same = np.flatnonzero(~several[back] & ~is_first) if len(back) else np.zeros(0, np.int64)
        n = b.runs.hi[same] - b.runs.lo[same] + 1
        begin = np.repeat(b.runs.lo[same] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        _, place, starts, again, _ = _windows(b, back, several)
        held = np.zeros(len(starts), bool)
        held[place] = _bits(windows, "own")
        # windows with equal prints and unequal anchors are not equal: all of them stay
        unlike = _bits(windows, "several")
        held |= unlike[again] if len(again) else held
        gone = removed(b, np.r_[begin, starts[~held]].astype(np.int64), size)
        out, to = [], 0
        raw = np.frombuffer(b.data, np.uint8)
        for doc, null, row, offset, mine, n in zip(*(getattr(b, x).tolist() for x in LISTS), strict=True):
            at_, to = to, to + n
            mask, text, doc = gone[at_:to], raw[at_:to], None if null else doc
            if offset == 0 and mine == n:
                out.append((*_row(doc, mask, text, True)[: 5 + with_text], *[None] * (not with_text), -1, 0, None))
            else:
                out.append((doc, mine, 0, 0, None, text[:mine].tobytes(), row, offset, np.packbits(mask).tobytes()))
        return pd.DataFrame(out, columns=[*_NAMES, "kept", "row", "offset", "gone"]).astype({"doc_id": "Int64"})

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("offset")
        raw = np.frombuffer(b"".join(g["kept"]), np.uint8)
        mask = np.zeros(len(raw), bool)
        for at, bits in zip(g["offset"], g["gone"], strict=True):
            piece = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(raw) - at].astype(bool)
            mask[at : at + len(piece)] |= piece
        doc = g["doc_id"].iloc[0]
        return pd.DataFrame([_row(None if pd.isna(doc) else int(doc), mask, raw, with_text)], columns=[*_NAMES, *["kept"] * with_text]).astype({"doc_id": "Int64"})

    anchors = written(_answered(rows.mapInArrow(first, ASK)), "anchors").withColumn("kind", F.lit(1))
    asked = _with_answers(rows, anchors).groupBy("block").applyInPandas(second, ASK)
    windows = written(_answered(asked), "windows").withColumn("kind", F.lit(2))
    both = _with_answers(rows, anchors.unionByName(windows))
    got = written(both.groupBy("block").applyInPandas(last, SPANS + ", kept binary, row bigint, offset bigint, gone binary"), "spans")
    out = [*_NAMES, *["kept"] * with_text]
    long = got.where("row >= 0").groupBy("row").applyInPandas(whole, SPANS + ", kept binary" * with_text)
    return got.where("row < 0").select(*out).unionByName(long.select(*out))


def query(spark, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
