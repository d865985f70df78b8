"""Benchmark decontamination with a distributed positional inverted index.

1. Test items become windows of `width` words (a shorter item is one window). The corpus frequency of
   their terms ranks each window's terms.
2. The index stores postings (term, doc_id, position) of the corpus for the probe terms only: the
   rarest term of each window and the next rarest one.
3. The two lists of a window are shifted by the terms' offsets and intersected on (document, start):
   rarest first. What is left is compared with the document's own words, so a match is an exact phrase.

Test windows are broadcast only up to `BROADCAST_WINDOWS`; beyond it Spark joins them by a shuffle.
Postings, candidates and hits are spread by document, so a passage or term that a third of all
documents hold is spread too. No list of one term is ever gathered in one place: what is collected
for a document is bounded by that document's length.

Nulls: a null text has no words. A null doc_id is counted and never hit; null item_ids are left out of
the items. Rows that repeat a doc_id with the same text get the same result; if the texts differ,
each is compared with the candidates of both, and only its own phrases count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_lower, fresh, let, small, table, words, written

WIDTH = 8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 200_000


def terms(text: Column) -> Column:
    return words(ascii_lower(text), NOT_WORD)


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """win, terms, items: each distinct window with the sorted ids of the items that hold it."""
    starts = lambda a: F.sequence(F.lit(1), F.greatest(F.size(a) - width + 1, F.lit(1)))
    cut = let(terms(F.col("text")), lambda a: F.when(F.size(a) > 0, F.transform(starts(a), lambda i: F.slice(a, i, width))).otherwise(F.array().cast("array<array<string>>")))
    each = items.where("item_id IS NOT NULL").select("item_id", F.explode_outer(cut).alias("terms")).where("terms IS NOT NULL")
    return each.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("win", F.xxhash64("terms"))


def frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, n: how often the corpus has each term of the vocabulary (0 is left out)."""
    return docs.select(F.explode_outer(terms(F.col("text"))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, doc_id, pos of the corpus' tokens that are in the vocabulary."""
    each = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode_outer(terms(F.col("text"))).alias("pos", "term"))
    return each.join(vocabulary, "term", "left_semi")


def probes(wins: DataFrame, freq: DataFrame) -> DataFrame:
    """win, size, rank (1: the rarest), term, at: the two rarest distinct terms of each window with their first offset.

    A window with a term that the corpus lacks has no probes: it can't match."""
    each = wins.select("win", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
    first = each.groupBy("win", "size", "term").agg(F.min("at").alias("at")).join(freq, "term", "left")
    mine = W.partitionBy("win")
    ranked = first.withColumn("rank", F.row_number().over(mine.orderBy("n", "term"))).withColumn("missing", F.max(F.col("n").isNull()).over(mine))
    return ranked.where("NOT missing AND rank <= 2").select("win", "size", "rank", "term", "at")


def candidates(index: DataFrame, probe: DataFrame) -> DataFrame:
    """doc_id, win, start: where the shifted lists of a window's probe terms meet."""
    need = probe.groupBy("win").agg(F.max("rank").alias("need"))
    shifted = index.join(small(probe.join(need, "win"), BROADCAST_WINDOWS), "term").select("doc_id", "win", "need", "rank", (F.col("pos") - F.col("at")).alias("start"))
    met = shifted.where("start >= 0").groupBy("doc_id", "win", "start", "need").agg(F.countDistinct("rank").alias("n"))
    return met.where("n = need").select("doc_id", "win", "start")


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with `leaks` (fresh(): with underscores where docs has such a column), a struct: n_words, n_hit, items (sorted ids of the items with occurring windows), spans."""
    wins = written(windows(items, width), "windows")
    vocabulary = wins.select(F.explode("terms").alias("term")).distinct()
    freq = frequencies(docs, small(vocabulary, BROADCAST_WINDOWS))
    probe = written(probes(wins, freq), "probes")
    index = written(postings(docs, small(probe.select("term").distinct(), BROADCAST_WINDOWS)), "postings")
    found = candidates(index, probe).join(small(wins, BROADCAST_WINDOWS), "win")
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "terms", "items")).alias(seen := fresh(docs, "_leak_found")))
    joined = docs.join(found.withColumnRenamed("doc_id", of := fresh(docs, "_leak_id")), F.col("doc_id") == F.col(of), "left")

    def verified(ws: Column) -> Column:
        real = F.filter(F.coalesce(seen, F.array().cast(found.schema[seen].dataType)), lambda c: F.slice(ws, c["start"] + 1, F.size(c["terms"])) == c["terms"])
        spans = lambda c: F.sequence(c["start"], c["start"] + F.size(c["terms"]) - 1)
        return let(real, lambda r: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.size(F.array_distinct(F.flatten(F.transform(r, spans)))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(r, lambda c: c["items"])))).alias("items"),
            F.array_sort(F.transform(r, lambda c: F.struct(c["start"].alias("start"), F.size(c["terms"]).alias("size")))).alias("spans"),
        ))

    own = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*own, let(terms(F.col("text")), verified).alias(fresh(docs, "leaks")))


def proximity(docs: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """query_id, doc_id, start, end: the places where all distinct terms of a query lie within `slop` words.

    queries: query_id, text. A place begins at an occurrence of a query's term and ends at the last of the
    first following occurrences of its other terms. Rows without words match nothing."""
    asked = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    each = asked.select("query_id", F.size("terms").alias("need"), F.explode("terms").alias("term"))
    index = postings(docs, each.select("term").distinct())
    seen = index.join(small(each, BROADCAST_WINDOWS), "term")
    near = W.partitionBy("query_id", "doc_id").orderBy("pos").rangeBetween(0, slop - 1)
    placed = seen.select("query_id", "need", "doc_id", "pos", "term", F.collect_list(F.struct("term", "pos")).over(near).alias("ahead"))
    n = F.size(F.array_distinct(F.transform("ahead", lambda x: x["term"])))
    firsts = F.transform(F.array_distinct(F.transform("ahead", lambda x: x["term"])), lambda t: F.array_min(F.transform(F.filter("ahead", lambda x: x["term"] == t), lambda x: x["pos"])))
    return placed.where(n == F.col("need")).select("query_id", "doc_id", F.col("pos").alias("start"), F.array_max(firsts).alias("end"))


MOST_ITEMS = 2


def digest(leaks: Column) -> list[Column]:
    ids = F.array_join(F.array_sort(F.transform(leaks["items"], lambda x: x.cast("string"))), ",")
    n = F.size(leaks["items"]).cast("long")
    return [leaks["n_words"].alias("n_words"), leaks["n_hit"].alias("n_hit"), n.alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n >= MOST_ITEMS).alias("contaminated")]


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *digest(F.col("leaks")))


SQL = """
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS a FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS a FROM benchmark
), bwin AS (
  SELECT DISTINCT item_id, least(len(a), 8) AS n, array_to_string(a[i : i + 7], ' ') AS w
  FROM (SELECT item_id, a, unnest(generate_series(1, greatest(len(a) - 7, 1))) AS i FROM bw WHERE len(a) > 0)
), sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (
  SELECT doc_id, n, i, array_to_string(a[i : i + n - 1], ' ') AS w
  FROM (SELECT doc_id, a, n, unnest(generate_series(1, len(a) - n + 1)) AS i FROM dw, sizes WHERE len(a) >= n)
), hits AS (SELECT DISTINCT doc_id, dwin.n, i, item_id FROM dwin JOIN bwin ON dwin.n = bwin.n AND dwin.w = bwin.w),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN covered ON dw.doc_id = covered.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, most_items: int = MOST_ITEMS) -> DataFrame:
    """The rows of docs without a whole window of `width` words of any item, and with less than most_items items.

    A single item of fewer words is no proof: its few words may stand in any text."""
    x = F.col(fresh(docs, "leaks"))
    leaked = F.exists(x["spans"], lambda s: s["size"] >= width) | (F.size(x["items"]) >= most_items)
    return matches(docs, items, width).where(~leaked).select(*[F.col(f"`{c}`") for c in docs.columns])
