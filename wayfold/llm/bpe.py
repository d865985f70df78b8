"""BPE encoding and decoding by forced-boundary splitting.

A pre-token is cut wherever two neighbouring symbols never stand next to each other inside any
vocabulary token: no merge can cross such a cut, so the fragments encode independently and their ids
concatenate to the ids of the whole. The last symbol of a pre-token carries the end-of-word mark and
counts as a symbol of its own. Fragments recur far more often than texts do, so their ids are kept in a
bounded memo of each worker.

A text is first cut at the added special tokens, then normalised and pre-tokenised as the vocabulary
file says; every text is processed whole, and long ones in one piece. Decoding joins the tokens of the
ids with blanks, special tokens included.

Nulls: a null text is an empty one: no ids, an empty decoded text. Rows that repeat a doc_id are encoded
one by one. Other columns are kept.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, table

MEMO = 200_000
#: Rows whose ids and texts are held at once.
ROWS = 500


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """Encodes and decodes with one vocabulary file. path: a tokenizers JSON file with a BPE model."""

    def __init__(self, path: str, memo: int = MEMO):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        whole = Tokenizer.from_file(path)
        self.normal, self.pre = whole.normalizer, whole.pre_tokenizer
        #: The last fragment of a pre-token is encoded with the end-of-word mark, the others without.
        self.last = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.end)
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.pairs = self._pairs(model["vocab"])
        self.memo, self.most = {}, memo

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _pairs(self, vocab: dict[str, int]) -> set[tuple[str, str]]:
        """The neighbours that some token has inside."""
        found: set[tuple[str, str]] = set()
        for t in vocab:
            s = self._symbols(t)
            found.update(zip(s, s[1:], strict=False))
        return found

    def fragments(self, word: str) -> list[str]:
        """The pieces of a pre-token between forced boundaries."""
        s = [*word[:-1], word[-1] + self.end]
        out, begin = [], 0
        for i in range(1, len(s)):
            if (s[i - 1], s[i]) not in self.pairs:
                out.append(word[begin:i])
                begin = i
        return [*out, word[begin:]]

    def word(self, word: str) -> list[int]:
        *inner, last = self.fragments(word)
        ids = [t.id for f in inner for t in self.inner.tokenize(f)]
        return ids + [t.id for t in self.last.tokenize(last)]

    def chunk(self, chunk: str) -> array:
        """The ids of a piece of normalised text without a blank: no pre-token reaches over one."""
        return array("I", [i for w, _ in self.pre.pre_tokenize_str(chunk) for i in self.word(w)])

    def encode(self, text: str) -> array:
        ids = array("I")
        memo, get = self.memo, self.memo.get
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            for w in self.normal.normalize_str(piece).split(" ") if piece else ():
                if (known := get(w)) is None:
                    if len(memo) >= self.most:
                        memo.clear()
                    known = memo[w] = self.chunk(w) if w else array("I")
                ids += known
        return ids

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _little(ids: array) -> array:
    if sys.byteorder == "big":
        ids = ids[:]
        ids.byteswap()
    return ids


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""
    path = path or default_path()
    ship(docs.sparkSession)
    own = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    more = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    schema = T.StructType([*own.schema.fields, *T.StructType.fromDDL(more).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in (b.slice(x, ROWS) for b in batches for x in range(0, b.num_rows, ROWS)):
            n, id_hash, text_hash, all_ids, texts = [], [], [], [], []
            for text in batch.column("text"):
                ids = c.encode(text.as_py() or "")
                decoded = c.decode(ids)
                n.append(len(ids))
                id_hash.append(hashlib.sha256(_little(ids).tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, np.uint32).astype(np.int32))
                    texts.append(decoded)
            new = [pa.array(n, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
            new += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if with_ids else []
            names = [f.name for f in schema.fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return own.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
