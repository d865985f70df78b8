"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding: NFKC, lower case, accents off Latin base letters used as look-alikes only where the table below
says so, Cyrillic and Greek look-alikes to Latin, and digits or signs inside a word to the letters they
stand for. Text is then words with one blank between; patterns are whole words (` word `) or beginnings
of words (` stem`), so one automaton finds both. Exception phrases are patterns too: what lies inside one
does not count.

The lexicon is learned from labelled rows: a bounded sample of `train_rows` documents (the bound is this
parameter), whose features are counted by Spark. Every feature that stands in toxic texts often enough, by the
sample's own share of toxic texts, and far more often than in clean ones is an entry; all entries go to every
worker, and their number is bounded by the sample. A text's
score is a logistic function of the summed weights and of their sum for each hundred words, whose
coefficients are fitted on the same sample. Every document is scored on its whole text.

Nulls: a null text is an empty one and has no match; its score is that of a text without one. A null
doc_id is scored, never learned from. Without labelled rows the lexicon is empty and all scores are 0.
Repeated rows are scored one by one; of a labelled doc_id with several texts the greatest one is learned from. No
other column is looked at.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

TRAIN_ROWS = 20_000
#: An entry's toxic texts would all be toxic by chance with a probability of less than this, and at least so many times as often as clean.
CHANCE = 1e-4
RATIO = 8
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: Fixed look-alikes: Cyrillic and Greek letters, then digits and signs, each with its Latin letter.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "ı": "i", "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a listed word is no insult.
EXCEPTIONS = ("not an idiot", "not a loser", "circus clown", "class clown", "trash can", "trash bin", "trash bag")

_look = str.maketrans(HOMOGLYPHS)
_digit = str.maketrans(DIGITS)
_word = re.compile(r"[^\s.,;:?\"()\[\]{}|*#%&<>/\\…–—]+")
_letter = re.compile(r"[^\W\d_]")


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    out = []
    for w in _word.findall(unicodedata.normalize("NFKC", text).lower().translate(_look)):
        w = w.strip("!'$@-_")
        if w and not w.isalpha() and _letter.search(w):
            w = w.translate(_digit)
        if w:
            out.append(w)
    return out


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Intercept and the coefficients of log(1 + sum) and log(1 + sum for each hundred words).
    fit: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        entries: dict[str, tuple[int, float]] = {f" {s}": (len(s) + 1, w) for s, w in self.stems.items()}
        entries |= {f" {x} ": (len(x) + 2, w) for x, w in self.words.items()}
        entries |= {f" {x} ": (len(x) + 2, 0.0) for x in self.exceptions}
        for k, v in entries.items():
            a.add_word(k, v)
        if entries:
            a.make_automaton()
        return a if entries else None

    def matched(self, automaton, words: list[str]) -> float:
        """The sum, over places where a word begins, of the heaviest match there that no exception covers."""
        if automaton is None or not words:
            return 0.0
        from bisect import bisect_right

        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (size, w) in automaton.iter(f" {' '.join(words)} "):
            at = end - size + 1
            if w == 0.0:
                free.append((at, end))
            elif w > best.get(at, 0.0):
                best[at] = w
        if not free:
            return sum(best.values())
        free.sort()
        starts, reach, most = [a for a, _ in free], [], 0
        for _, b in free:
            most = max(most, b)
            reach.append(most)
        covered = lambda at: (i := bisect_right(starts, at)) > 0 and at < reach[i - 1]
        return sum(w for at, w in best.items() if not covered(at))

    def score(self, automaton, text: str | None) -> tuple[float, float]:
        words = fold(text or "")
        total = self.matched(automaton, words)
        x, y = math.log1p(total), math.log1p(100 * total / max(len(words), 20))
        z = self.fit[0] + self.fit[1] * x + self.fit[2] * y
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), total


def features(words: Iterable[str]) -> set[str]:
    found = set(words)
    return found | {f"{w[:n]}*" for w in found if w.isalpha() for n in STEMS if len(w) > n}


def _counted(train: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many texts of each label. train: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, label = [], []
            for text, toxic in zip(b.column("text"), b.column("toxic"), strict=True):
                f = features(fold(text.as_py() or ""))
                names += f
                label += [toxic.as_py()] * len(f)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(label, pa.int32())], names=["feature", "toxic"])

    each = train.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "feature string, toxic int")
    return each.groupBy("feature").agg(F.sum("toxic").cast("long").alias("toxic"), F.sum(1 - F.col("toxic")).cast("long").alias("clean"))


def _logistic(rows: list[tuple[float, float, int]], steps: int = 60) -> tuple[float, float, float]:
    """Coefficients by ridge-regularised Newton steps."""
    import numpy as np

    if not rows or len({r[2] for r in rows}) < 2:
        return (-50.0, 0.0, 0.0)
    x = np.array([[1.0, a, b] for a, b, _ in rows])
    y = np.array([r[2] for r in rows], float)
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, chance: float = CHANCE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """docs: doc_id, text. labels: doc_id, toxic; all of them may be learned from."""
    ship(docs.sparkSession)
    key = F.crc32(F.col("doc_id").cast("string"))
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(key, "doc_id").limit(train_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    total = chosen.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = float(total["t"] or 0), float(total["n"] - (total["t"] or 0))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    least = math.ceil(math.log(chance) / math.log(toxic / (toxic + clean))) if toxic and clean else 1
    heavy = _counted(train).where((F.col("toxic") >= max(3, least)) & (F.col("toxic") >= RATIO * F.col("clean"))).withColumn("w", weight).where("w >= 3")
    out = Lexicon(exceptions=exceptions)
    for r in heavy.collect():
        (out.stems if r["feature"].endswith("*") else out.words)[r["feature"].removesuffix("*")] = round(r["w"], 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = out.automaton()
        for b in batches:
            x, y = [], []
            for t in b.column("text"):
                words = fold(t.as_py() or "")
                total = out.matched(a, words)
                x.append(math.log1p(total))
                y.append(math.log1p(100 * total / max(len(words), 20)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64()), b.column("toxic").cast(pa.int32())], names=["x", "y", "toxic"])

    fitted = train.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "x double, y double, toxic int")
    out.fit = _logistic(sorted((r["x"], r["y"], r["toxic"]) for r in fitted.collect()))
    return out


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, weight (the sum of the matches' weights) of every row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            got = [lexicon.score(a, t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= threshold) for s, _ in got], pa.int32()), pa.array([w for _, w in got], pa.float64())],
                names=["doc_id", "score", "predicted", "weight"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int, weight double")


FOLDS, HELD_OUT = 4, 2


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold_of = lambda c: F.crc32(c.cast("string")) % FOLDS
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id")) != HELD_OUT)
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
