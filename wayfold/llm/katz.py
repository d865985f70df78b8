"""LM scoring: a Katz bigram model with Good-Turing discounts and exactly normalised backoff weights.

Model. A text is its words and one end token; the first token's history is a start mark. A bigram's
discounted count is d(r) r, kept in thousandths: d is Turing's estimate (r + 1) n[r+1] / (r n[r]) for small r
where that lies between 0 and 1, and (1 + 1/r)^(b+1) elsewhere, b being the slope of log n[r] over log r. Single
tokens are discounted the same way and what is left is the probability of an unknown token. A history's
backoff weight is what its discounted bigrams leave, divided by what their second tokens leave of the
single-token distribution. All sums are of integers, so a history's probabilities add up to 1 exactly as
computed and do not depend on the order of rows.

Evaluation, per token: the bigram's discounted share if it was seen, else the history's weight times the
token's own probability; a history that was not seen has weight 1.

Execution. Texts are cut into blocks of about `block_tokens`. A block asks for each distinct key once: sorted
64-bit hashes with the block's training counts go to the partition of the key, compressed; the partition adds
them up (that is the model's table of the key range) and answers each block in the order it asked. A bigram that
every document holds is one row of each block, so nothing is skewed. Of the blocks that hold a training
bigram one owns it and adds it to its history's sums; these take the same way. Blocks, counts, sums
and weights are written tables partitioned by key range. Keys are 64-bit hashes of words and pairs.

Nulls: a null text is an empty one: one token, the end. A null doc_id counts as not held out and is scored.
Rows that repeat a doc_id are rows of their own. If nothing may be learned from, every token is unknown with
probability 1. Extra columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship, table, written
from .hashing import U, WordHashes, mix, pack, split_words, unpack

BLOCK_TOKENS = 1_500_000
KEYS_PER_PARTITION = 4_000_000
MOST = 6
UNIT = 1000
END, START = U(0x51F15EED00000001), U(0x51F15EED00000002)
FOLDS, HELD_OUT = 7, 2


def held_out(doc) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % FOLDS == HELD_OUT


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A written table of blocks: ids, flags (1: null id, 2: held out) and lengths of documents, the sorted
    distinct word hashes and each token's place among them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, n = WordHashes(), TaskContext.get().partitionId() << 32, 0
        rows: list = []
        size = 0

        def block():
            vocab, at = np.unique(np.concatenate([x for _, x in rows]), return_inverse=True)
            ids = np.array([d or 0 for d, _ in rows], np.int64)
            flags = np.array([(d is None) + 2 * held_out(d) for d, _ in rows])
            blobs = [pack(ids, False), pack(flags, False), pack(np.array([len(x) for _, x in rows]), False), pack(vocab), pack(at.ravel(), False)]
            return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([len(at.ravel())]), *[pa.array([x], pa.binary()) for x in blobs]], names=["block", "tokens", "ids", "flags", "sizes", "vocab", "at"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                rows.append((doc, np.append(hashes.of(split_words(text.as_py())), END)))
                size += len(rows[-1][1])
                if size >= block_tokens:
                    yield block()
                    rows, size, n = [], 0, n + 1
        if rows:
            yield block()

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block bigint, tokens bigint, ids binary, flags binary, sizes binary, vocab binary, at binary")
    return written(out, "blocks")


class Block:
    """A block's tokens, histories and distinct bigrams."""

    def __init__(self, row: dict):
        self.ids, flags = unpack(row["ids"], False).view(np.int64), unpack(row["flags"], False)
        self.null, self.held = (flags & U(1)) > 0, (flags & U(2)) > 0
        self.sizes = unpack(row["sizes"], False).astype(np.int64)
        self.vocab, self.at = unpack(row["vocab"]), unpack(row["at"], False).astype(np.int64)
        ends = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.train = ~np.repeat(self.held, self.sizes)
        #: Histories: places in vocab, and one past it for the start mark.
        self.history = np.r_[0, self.at[:-1]]
        self.history[np.r_[0, ends[:-1]]] = len(self.vocab)
        all_words = mix(np.append(self.vocab, START))
        with np.errstate(over="ignore"):
            keys = mix(all_words[self.history] * U(0x9E3779B97F4A7C15) + all_words[self.at])
        self.keys, self.first, self.pair = np.unique(keys, return_index=True, return_inverse=True)
        self.pair = self.pair.ravel()

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the distinct bigrams and of the vocabulary."""
        return np.bincount(self.pair[self.train], minlength=len(self.keys)), np.bincount(self.at[self.train], minlength=len(self.vocab))


def _dealt(keys: np.ndarray, deal: int) -> list[tuple[int, int, int]]:
    """part, from, to of sorted keys: parts are ranges of the upper 32 bits."""
    part = ((keys >> U(32)) * U(deal)) >> U(32)
    cuts = np.searchsorted(part, np.arange(deal + 1).astype(U))
    return [(p, int(cuts[p]), int(cuts[p + 1])) for p in range(deal) if cuts[p] < cuts[p + 1]]


WORDS, PAIRS = 1, 2
ASK = "kind int, part int, block bigint, keys binary, counts binary"
ANSWER = "kind int, part int, block bigint, counts binary, own binary, seen array<bigint>"


def asked(rows: DataFrame, deal: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                pairs, words = b.counts()
                for kind, keys, counts in ((PAIRS, b.keys, pairs), (WORDS, b.vocab, words)):
                    got = [(p, pack(keys[x:y]), pack(counts[x:y], False)) for p, x, y in _dealt(keys, deal)]
                    n = len(got)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * n, pa.int32()), pa.array([p for p, _, _ in got], pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array([k for _, k, _ in got], pa.binary()), pa.array([c for _, _, c in got], pa.binary())],
                        names=["kind", "part", "block", "keys", "counts"],
                    )

    return rows.mapInArrow(run, ASK)


def answered(questions: DataFrame) -> DataFrame:
    """Each block's keys' total counts and which of them it owns; with block -1 the counts of counts 1 to MOST,
    the distinct keys, their total and, as pairs, how many keys have each greater count."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        keys, counts = [unpack(x) for x in g["keys"]], [unpack(x, False).astype(np.int64) for x in g["counts"]]
        n = np.cumsum([0, *map(len, keys)])
        every, mine = np.concatenate(keys), np.concatenate(counts)
        _, back = np.unique(every, return_inverse=True)
        back = back.ravel()
        total = np.zeros(back.max() + 1, np.int64)
        np.add.at(total, back, mine)
        held = np.flatnonzero(mine)
        owner = np.zeros(len(every), bool)
        owner[held[np.unique(back[held], return_index=True)[1]]] = True
        values, times = np.unique(total[total > 0], return_counts=True)
        spans = [slice(n[i], n[i + 1]) for i in range(len(keys))]
        kind, part = int(g["kind"].iloc[0]), int(g["part"].iloc[0])
        rows = [(kind, part, int(b), pack(total[back[s]], False), np.packbits(owner[s]).tobytes(), None) for b, s in zip(g["block"], spans, strict=True)]
        rows.append((kind, part, -1, None, None, np.stack([values, times], 1).ravel().tolist()))
        return pd.DataFrame(rows, columns=["kind", "part", "block", "counts", "own", "seen"])

    return questions.groupBy("kind", "part").applyInPandas(run, ANSWER)


class Discounts:
    """Discounted counts, in 1/UNIT, from the counts of counts n[1], n[2], .. of one order."""

    def __init__(self, n: dict[int, int]):
        points = [(math.log(r), math.log(n[r])) for r in range(1, MOST + 1) if n.get(r)]
        slope = -2.0
        if len(points) > 1:
            x, y = np.array(points).T
            slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
        self.slope, self.low = min(slope, -1.05), [0]
        for r in range(1, MOST):
            turing = (r + 1) * n.get(r + 1, 0) / n[r] if n.get(r) else 0.0
            good = turing if 0.02 * r < turing < r and turing > self.low[-1] / UNIT else r * (1 + 1 / r) ** (self.slope + 1)
            self.low.append(max(1, min(round(UNIT * good), UNIT * r - 1)))

    def of(self, counts: np.ndarray) -> np.ndarray:
        r = np.maximum(counts, 1).astype(float)
        smooth = np.minimum(np.rint(UNIT * r * (1 + 1 / r) ** (self.slope + 1)), UNIT * r - 1).astype(np.int64)
        low = np.array(self.low)[np.minimum(counts, MOST - 1)]
        return np.where(counts < MOST, low, smooth)


class Model:
    """What is the same for all: discounts, training tokens and types, the unknown token's share."""

    def __init__(self, answers: DataFrame):
        at = F.explode(F.expr("transform(sequence(0, size(seen) - 1, 2), i -> struct(seen[i] AS r, seen[i + 1] AS n))"))
        counts = written(answers.where("block = -1 AND size(seen) > 0").select("kind", at.alias("x")).groupBy("kind", "x.r").agg(F.sum("x.n").alias("n")), "counts")
        low = {k: {r["r"]: r["n"] for r in counts.where((F.col("kind") == k) & (F.col("r") <= MOST)).collect()} for k in (WORDS, PAIRS)}
        self.words, self.pairs = Discounts(low[WORDS]), Discounts(low[PAIRS])
        sums = counts.where(F.col("kind") == WORDS).agg(F.sum(F.col("r") * F.col("n")).alias("N"), F.sum("n").alias("V")).first()
        self.N, self.V = int(sums["N"] or 0), int(sums["V"] or 0)
        words = self.words

        def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"q": words.of(b["r"].to_numpy()) * b["n"].to_numpy()})

        q = counts.where(F.col("kind") == WORDS).select("r", "n").mapInPandas(shares, "q bigint").agg(F.sum("q").alias("q")).first()
        self.unknown = 1 - int(q["q"] or 0) / (UNIT * self.N) if self.N else 1.0

    def single(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of tokens by their counts."""
        return np.where(c > 0, self.words.of(c) / (UNIT * max(self.N, 1)), self.unknown)


def _gathered(g: pd.DataFrame, kind: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's answers of one kind, in the order of its keys."""
    g = g[g["kind"] == kind].sort_values("part")
    counts, own = [unpack(x, False).astype(np.int64) for x in g["counts"]], g["own"]
    owner = [np.unpackbits(np.frombuffer(o, np.uint8))[: len(c)] for c, o in zip(counts, own, strict=True)]
    if not counts:
        return np.zeros(size, np.int64), np.zeros(size, bool)
    return np.concatenate(counts), np.concatenate(owner).astype(bool)


MIDDLE = "kind int, part int, block bigint, keys binary, c binary, q binary, s binary, docs binary"
DOCS, SUMS, WEIGHTS = 0, 1, 2


def evaluated(rows: DataFrame, answers: DataFrame, model: Model, deal: int) -> DataFrame:
    """For each block, one row of its documents' known parts and the places that need a weight (DOCS), and rows
    of its histories' sums (SUMS)."""
    import pickle

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = g[g["kind"] == DOCS].iloc[0].to_dict()
        b = Block(own)
        pairs, mine = _gathered(g, PAIRS, len(b.keys))
        words, _ = _gathered(g, WORDS, len(b.vocab))
        end = int(np.searchsorted(b.vocab, END))
        before = np.append(words, words[end])
        c = words[b.at]
        c_pair, c_before = pairs[b.pair], before[b.history]
        seen = c_pair > 0
        single = model.single(c)
        p = np.where(seen, model.pairs.of(c_pair) / (UNIT * np.maximum(c_before, 1)), single)
        docs = len(b.ids)
        total = lambda w: np.bincount(b.doc, w, docs)
        base = total(np.log10((c + 1) / (model.N + model.V + 1)))
        known = np.bincount(b.doc[c > 0], minlength=docs)
        need = ~seen & (c_before > 0)
        # sums of the histories, from the pairs this block owns
        owned = np.flatnonzero(mine)
        h, w = b.history[b.first[owned]], b.at[b.first[owned]]
        n = len(b.vocab) + 1
        q, s = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(q, h, model.pairs.of(pairs[owned]))
        np.add.at(s, h, model.words.of(words[w]))
        wanted = np.zeros(n, bool)
        wanted[b.history[need]] = True
        used = wanted | (q > 0)
        hashes = np.append(b.vocab, START)
        by = np.flatnonzero(used)[np.argsort(hashes[used])]
        place = np.full(n, -1)
        place[by] = np.arange(len(by))
        keep = (b.ids, b.null, b.held, b.sizes, known, base, total(np.log10(p)), b.doc[need].astype(np.int32), place[b.history[need]].astype(np.int32))
        block = int(own["block"])
        out = [(DOCS, -1, block, None, None, None, None, _zip(pickle.dumps(keep, 5)))]
        for part, x, y in _dealt(hashes[by], deal):
            k = by[x:y]
            out.append((SUMS, part, block, pack(hashes[k]), pack(before[k], False), pack(q[k], False), pack(s[k], False), np.packbits(wanted[k]).tobytes()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in MIDDLE.split(", ")])

    blank = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    blobs = ("ids", "flags", "sizes", "vocab", "at")
    left = rows.select(F.lit(DOCS).alias("kind"), F.lit(-1).alias("part"), "block", *blobs, *blank("counts", "own"))
    right = answers.where("block >= 0").select("kind", "part", "block", *blank(*blobs), "counts", "own")
    return left.unionByName(right).groupBy("block").applyInPandas(run, MIDDLE)


def _zip(b: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(b)


def weights(middle: DataFrame, model: Model) -> DataFrame:
    """For each block, the backoff weights it wants, in the order it asked."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(x) for x in g["keys"]]
        n = np.cumsum([0, *map(len, keys)])
        _, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        back = back.ravel()
        add = lambda name: np.concatenate([unpack(x, False).astype(np.int64) for x in g[name]])
        c, q, s = add("c")[first], np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        np.add.at(q, back, add("q"))
        np.add.at(s, back, add("s"))
        alpha = (1 - q / (UNIT * np.maximum(c, 1))) / (1 - s / (UNIT * max(model.N, 1)))
        part = int(g["part"].iloc[0])
        rows = [(WEIGHTS, part, int(b), None, alpha[back[n[i] : n[i + 1]]].tobytes()) for i, b in enumerate(g["block"])]
        return pd.DataFrame(rows, columns=["kind", "part", "block", "docs", "q"])

    sums = middle.where(F.col("kind") == SUMS).select("part", "block", "keys", "c", "q", "s")
    return sums.groupBy("part").applyInPandas(run, "kind int, part int, block bigint, docs binary, q binary")


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scored(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row of SCORED for every row of docs (doc_id, text); learns from those that held_out() leaves in."""
    import pickle

    import zstandard

    spark = docs.sparkSession
    rows = blocks(docs, block_tokens)
    tokens = rows.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    deal = max(partitions(spark), tokens // KEYS_PER_PARTITION + 1)
    answers = written(answered(asked(rows, deal)), "answers")
    model = Model(answers)
    middle = written(evaluated(rows, answers, model, deal), "middle")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = g[g["kind"] == DOCS].iloc[0]
        ids, null, held, sizes, known, base, score, doc, place = pickle.loads(zstandard.ZstdDecompressor().decompress(own["docs"]))
        got = g[g["kind"] == WEIGHTS].sort_values("part")
        alpha = np.concatenate([np.frombuffer(x, float) for x in got["q"]]) if len(got) else np.zeros(0)
        if len(place):
            score = score + np.bincount(doc, np.log10(alpha[place]), len(ids))
        return pd.DataFrame({
            "doc_id": pd.Series(ids, dtype="Int64").mask(null), "held_out": held, "n_tokens": sizes, "n_known": known,
            "train_tokens": model.N, "base_score": base, "score": score,
        })

    left = middle.where(F.col("kind") == DOCS).select("kind", "part", "block", "docs", "q")
    return left.unionByName(weights(middle, model)).groupBy("block").applyInPandas(run, SCORED)


def query(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
