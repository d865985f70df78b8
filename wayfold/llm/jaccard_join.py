"""N-gram Jaccard join: exact links of shingle sets through prefix trees, and their components.

Which documents meet. Sets A and B with |A & B| >= t |A | B| differ in at most (|A| + |B|)(1 - t)/(1 + t)
shingles. Shingles are dealt by hash to one part more than that, so at least one part of both is the same:
its hash is a signature. Sizes fall in classes whose bounds grow by 1/t, and a set signs for its own class and
the next one, so linked sets sign with equal parts. A part without shingles says nothing; a set with empty
parts therefore signs again with more parts, until non-empty ones must agree; how many more, step by step, depends on
the class only, so two linked sets share every step up to the first at which one of them stops. This loses no link and,
unlike single shingles, is not shared by unrelated documents, however frequent their words.

Signatures travel sorted and compressed, and the documents under one signature are only tied to the least of
them. Those ties form groups; identical sets enter a group once. A group larger than `chunk` sets is dealt to
chunks, and each pair of chunks is one task, so a task holds at most two chunks. Sets travel there twice (by
document, then by group), as compressed words: a third of the bytes of shingles, which are made in the task.

How a group is joined. Its shingles get one order, frequent ones first, and its sets go into a radix trie.
A set is looked up by walking the trie while the shingles it fails to share are counted: the walk leaves a
subtree as soon as no set below, given its remaining length, could still be close enough. A subtree whose
sets are all connected to the searching one already is left as well; each new link joins two components. So
a group of near copies costs about one link a set, not all pairs. Each task returns a spanning forest; its
links are exact, none between different components is missing, and components() merges the forests.

Shingles are compared by 64-bit hashes.

Nulls: a null or wordless text has an empty set, which is linked with nothing. A null doc_id has a null
component. Rows that repeat a doc_id are one node, with each of its texts' links. Very long texts are taken
whole. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, ship, small, table, written
from .components import components
from .hashing import U, WordHashes, mix, pack, shingles, split_words, unpack

#: Links need 100 * intersection >= T * union.
T, N = 90, 3
CHUNK = 4_000
SIGNATURES_PER_PARTITION = 2_000_000
#: Bits that a signature keeps within its part. Parts grow in number and not in size, so at any scale two different
#: signatures of a part agree in them about twice; that ties two sets more, which the tries compare like all others.
KEY_BITS = 40
BROADCAST_IDS = 500_000
#: Of the compression of words on their way to the groups.
LEVEL = 3


def size_class(n: int, t: int = T) -> tuple[int, int, int]:
    """The class of a size: number, greatest size in it, greatest size in the next one."""
    k, lo = 0, 1
    while (hi := lo * 100 // t) < n:
        k, lo = k + 1, hi + 1
    return k, hi, (hi + 1) * 100 // t


def signatures(s: np.ndarray, t: int = T) -> np.ndarray:
    """The signatures of a set of shingles."""
    k, *tops = size_class(len(s), t)
    out = []
    for of, top in zip((k, k + 1), tops, strict=True):
        least = 2 * top * (100 - t) // (100 + t) + 1
        # the empty parts that the least set of both classes leaves, on average; all sets of a class take the same levels
        level = int(least * math.exp(-top * t * t / 10_000 / least))
        while True:
            parts, salt = least + level, U((of * 4096 + level) * 2654435761 + 1)
            where = (mix(s ^ mix(salt)) >> U(32)) % U(parts)
            order = np.argsort(where, kind="stable")
            at = where[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(mix(s[order] + salt), first)
                out.append(mix(sums ^ mix(at[first] * U(0x9E3779B97F4A7C15) + salt)))
            if parts - len(first) <= level:
                break
            level += 1 + level // 4
    return np.concatenate(out)


class Node:
    """A node of a burst trie: a label that all sets below share, then children and buckets."""

    __slots__ = ("buckets", "children", "label", "most")

    def __init__(self, label: np.ndarray, most: int):
        #: most: the size of the greatest set below.
        self.label, self.most, self.children, self.buckets = label, most, [], []


class Bucket:
    """Up to `BUCKET` sets with one path above them. What is left of each set is a row of bits."""

    __slots__ = ("bits", "columns", "members", "most", "one", "sizes")

    def __init__(self, members: np.ndarray, tails: list[np.ndarray], sizes: np.ndarray):
        self.members, self.sizes, self.most, self.one = members, sizes, int(sizes.max()), len(members) == 1
        lengths = [len(x) for x in tails]
        self.columns, back = np.unique(np.concatenate(tails), return_inverse=True)
        width = -(-max(len(self.columns), 1) // 64)
        self.bits = np.zeros((len(tails), width), U)
        np.bitwise_or.at(self.bits, (np.repeat(np.arange(len(tails)), lengths), back.ravel() // 64), U(1) << (back.ravel() % 64).astype(U))

    def shared(self, tail: np.ndarray) -> np.ndarray:
        """How many elements of the tail each row has."""
        if not len(tail) or not len(self.columns):
            return np.zeros(len(self.members), np.int64)
        at = np.searchsorted(self.columns, tail)
        at = at[(at < len(self.columns)) & (self.columns[np.minimum(at, len(self.columns) - 1)] == tail)]
        row = np.zeros(self.bits.shape[1], U)
        np.bitwise_or.at(row, at // 64, U(1) << (at % 64).astype(U))
        used = np.flatnonzero(row)
        return np.bitwise_count(self.bits[:, used] & row[used]).sum(1, dtype=np.int64)


#: More sets than this with a common prefix get nodes of their own.
BUCKET = 256


class Join:
    """A spanning forest of the links between sets. sets: sorted ranks in one order; sizes: of the whole sets."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, t: int = T):
        self.sets, self.sizes, self.t, self.up, self.links = sets, sizes, t, list(range(len(sets))), []
        by = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.root = self._built(by)

    def _bucket(self, members: list[int], depth: int) -> Bucket:
        return Bucket(np.array(members), [self.sets[i][depth:] for i in members], self.sizes[members])

    def _built(self, by: list[int]) -> Node:
        """The trie of sets in lexicographic order. Only prefixes of more than BUCKET sets get nodes of their own."""
        root = Node(np.empty(0, np.int64), int(self.sizes.max()))
        todo = [(root, by, 0)]
        while todo:
            node, members, depth = todo.pop()
            rest: list[int] = []
            if len(members) > BUCKET:
                at = 0
                while at < len(members):
                    s, end = self.sets[members[at]], at + 1
                    if depth < len(s):
                        while end < len(members) and len(x := self.sets[members[end]]) > depth and x[depth] == s[depth]:
                            end += 1
                    if end - at > BUCKET:
                        last = self.sets[members[end - 1]]
                        n = min(len(s), len(last)) - depth
                        differ = np.flatnonzero(s[depth : depth + n] != last[depth : depth + n])
                        common = int(differ[0]) if len(differ) else n
                        child = Node(s[depth : depth + common], int(self.sizes[members[at:end]].max()))
                        node.children.append(child)
                        todo.append((child, members[at:end], depth + common))
                    else:
                        rest += members[at:end]
                    at = end
            else:
                rest = members
            node.buckets += [self._bucket(rest[x : x + BUCKET], depth) for x in range(0, len(rest), BUCKET)]
        return root

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def search(self, i: int) -> None:
        """Links set i with every set that is close enough and not connected with it yet."""
        s, t, a = self.sets[i], self.t, int(self.sizes[i])
        alone = a - len(s)
        stack = [(self.root, 0, 0, alone)]
        while stack:
            node, at, shared, missed = stack.pop()
            label = node.label
            if len(label):
                to = int(np.searchsorted(s, label[-1], "right"))
                part = s[at:to]
                common = len(np.intersect1d(label, part, assume_unique=True)) if len(part) else 0
                shared, missed, at = shared + common, missed + len(label) + len(part) - 2 * common, to
            # even if all that is left of both is shared
            if missed * (100 + t) > (a + node.most) * (100 - t):
                continue
            stack += [(c, at, shared, missed) for c in node.children if c.most * 100 >= t * a]
            for b in node.buckets:
                if b.most * 100 < t * a or b.one and self.find(int(b.members[0])) == self.find(i):
                    continue
                both = shared + b.shared(s[at:])
                close = b.members[100 * both >= t * (a + b.sizes - both)]
                for j in close.tolist():
                    self.link(i, j)
                if len(close) and not b.one:
                    root = self.find(i)
                    b.one = all(self.find(j) == root for j in b.members.tolist())

    def run(self) -> list[tuple[int, int]]:
        for i in range(len(self.sets)):
            self.search(i)
        return self.links


def ordered(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets as sorted ranks in one order, shingles that more sets have first; those of a single set are left out."""
    _, back, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((np.arange(len(n)), -n))] = np.arange(len(n))
    several, back = n > 1, back.ravel()
    return [np.sort(rank[x[several[x]]]) for x in np.split(back, np.cumsum([len(s) for s in sets])[:-1])]


def forest(ids: np.ndarray, sets: list[np.ndarray], t: int = T) -> list[tuple[int, int]]:
    """Links (a, b) of ids: a spanning forest of the graph of all links among the sets."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    return [(int(ids[i]), int(ids[j])) for i, j in Join(ordered(sets), sizes, t).run()]


def _set_id(print_: bytes) -> int:
    return int.from_bytes(print_[:8], "little", signed=True)


def signed(docs: DataFrame, t: int = T, n: int = N) -> DataFrame:
    """A written table of two kinds of rows: part -1 for each document (doc_id, n_shingles, set_hash, set_id), and
    else packed signatures with the ids of their sets (half of the hash): copies sign as one."""
    ship(docs.sparkSession)
    deal = max(partitions(docs.sparkSession), docs.count() * 128 // SIGNATURES_PER_PARTITION + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        names = ["part", "doc_id", "n_shingles", "set_hash", "set_id", "keys", "ids"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

        def rows(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=names)

        for b in batches:
            ids, sizes, prints, keys, owners, done = b.column("doc_id").to_pylist(), [], [], [], [], set()
            for doc, text in zip(ids, b.column("text"), strict=True):
                s = shingles(split_words(text.as_py()), hashes, n)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s) and doc is not None and prints[-1] not in done:
                    done.add(prints[-1])
                    keys.append(signatures(s, t))
                    owners.append(np.full(len(keys[-1]), _set_id(prints[-1]), np.int64))
            none = [None] * len(ids)
            yield rows([-1] * len(ids), ids, sizes, prints, [x and _set_id(x) for x in prints], none, none)
            if keys:
                k, o = np.concatenate(keys), np.concatenate(owners)
                part, k = k % U(deal), (k // U(deal)) & U((1 << KEY_BITS) - 1)
                # by owner, whose differences are mostly 0: a quarter fewer bytes than by key
                by = np.lexsort((k, o, part))
                k, o, part = k[by], o[by], part[by]
                cuts = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(k)]
                got = [(int(part[x]), pack(k[x:y], False), pack(o[x:y])) for x, y in zip(cuts, cuts[1:], strict=False)]
                none = [None] * len(got)
                yield rows([p for p, _, _ in got], none, none, none, none, [x for _, x, _ in got], [x for _, _, x in got])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, doc_id bigint, n_shingles bigint, set_hash binary, set_id bigint, keys binary, ids binary")
    return written(out, "signed")


def ties(table: DataFrame) -> DataFrame:
    """a, b: each set with the least one under each of its signatures, where they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for b in batches:
            keys += [unpack(x.as_py(), False) for x in b.column("keys")]
            ids += [unpack(x.as_py()).view(np.int64) for x in b.column("ids")]
        if not keys:
            return
        k, o = np.concatenate(keys), np.concatenate(ids)
        by = np.lexsort((o, k))
        k, o = k[by], o[by]
        first = np.r_[True, k[1:] != k[:-1]]
        least = o[np.flatnonzero(first)][np.cumsum(first) - 1]
        pairs = np.unique(np.stack([o, least], 1)[o != least], axis=0)
        for x in range(0, len(pairs), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[x : x + 100_000, 0]), pa.array(pairs[x : x + 100_000, 1])], names=["a", "b"])

    # a partition's signatures are sorted in memory: there are as many partitions as parts, whose size is bounded
    parts = (table.agg(F.max("part").alias("n")).first()["n"] or 0) + 1
    blobs = table.where("part >= 0").select("part", "keys", "ids").repartition(max(parts, partitions(table.sparkSession)), "part")
    return blobs.mapInArrow(run, "a bigint, b bigint").distinct()


def packed_words(text: str | None) -> bytes:
    """The words that split_words() finds, compressed."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(b" ".join(split_words(text)))


def unpacked_words(b: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(b).split()


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, words of every row: what travels to the groups. Shingles, 8 bytes a word that nothing compresses, are made there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([packed_words(x.as_py()) for x in b.column("text")], pa.binary())], names=["doc_id", "words"])

    return docs.mapInArrow(run, "doc_id bigint, words binary")


def links(docs: DataFrame, signed_rows: DataFrame, t: int = T, n: int = N, chunk: int = CHUNK) -> DataFrame:
    """a, b: links that connect what all links connect. Identical sets are tied to the least of their documents."""
    own = signed_rows.where("part = -1 AND doc_id IS NOT NULL AND set_hash IS NOT NULL").select("doc_id", "set_hash", "set_id")
    reps = written(own.groupBy("set_hash", "set_id").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "reps")
    copied = reps.where("rep < last").select("set_hash", "rep")
    same = own.join(copied, "set_hash").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    tied = written(ties(signed_rows), "ties")
    members = tied.select(F.col("b").alias("g"), F.col("a").alias("set_id")).unionByName(tied.select(F.col("b").alias("g"), F.col("b").alias("set_id")).distinct())
    groups = written(members.join(reps.select("set_id", F.col("rep").alias("doc_id")), "set_id").select("g", "doc_id"), "groups")
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    members = groups.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(members, BROADCAST_IDS), "doc_id", "left_semi")
    cut = F.ceil(F.col("size") / chunk).cast("int")
    dealt = groups.join(sizes, "g").select("g", "doc_id", cut.alias("k"), F.pmod(F.xxhash64("doc_id"), cut).cast("int").alias("c"))
    to = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j")))
    rows = dealt.select("g", "doc_id", F.explode(to).alias("to")).select("g", "to.i", "to.j", "doc_id").join(_words(texts), "doc_id")
    hashes = WordHashes()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        found = forest(g["doc_id"].to_numpy(), [shingles(unpacked_words(x), hashes, n) for x in g["words"]], t)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("g", "i", "j").applyInPandas(run, "a bigint, b bigint").unionByName(same)


def near(docs: DataFrame, t: int = T, n: int = N, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    rows = signed(docs, t, n)
    found = components(links(docs, rows, t, n, chunk))
    own = rows.where("part = -1").select("doc_id", "n_shingles")
    return own.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(docs: DataFrame, t: int = T, n: int = N, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs that no other document of their component precedes; of repeated rows all stay or go.

    Empty documents and null ids are linked with nothing and stay."""
    away = components(links(docs, signed(docs, t, n), t, n, chunk)).where("node <> component").select(F.col("node").alias(gone := fresh(docs, "_away")))
    return docs.join(small(away, BROADCAST_IDS), F.col("doc_id") == F.col(gone), "left_anti")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(a[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, a, unnest(generate_series(1, greatest(len(a) - 2, 1))) AS i FROM w WHERE len(a) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * k >= 90 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON d.doc_id = node GROUP BY d.doc_id
"""
