"""Line dedup: lines that spread over many sites are boilerplate and are cut.

A line is keyed by two hashes of its text without outer white space; lines without a word are no
lines. Each task reduces its lines to distinct (line, site) pairs, which are dealt by both, so a line found
everywhere comes to no more rows than it has sites. Only lines that occur at two sites or more (a min/max of
the site's hash) get a HyperLogLog sketch of their sites; sketches merge by aggregation. Lines whose estimate is within `band` of the
threshold are counted exactly; the rest are far enough from it for the sketch to decide.

A document in which boilerplate makes up more than `max_share` of the characters of its lines is a
copy of a page rather than a page with boilerplate: it is left to document-level deduplication.

Nulls: a null text has no lines and stays null; a null source is a site of its own. Rows that repeat
a doc_id are judged one by one, each by the share of its own lines; a doc_id with several texts loses
a line only where the text at hand has that line. A row with a null doc_id counts for the spread and is not cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, small, table, written

MIN_SITES = 10
LG_K = 12
#: Of the threshold: about six standard errors of a sketch with 2^12 registers.
BAND = 0.1
MAX_SHARE = 0.5
#: Boilerplate lines are broadcast up to this number, 16 bytes each; beyond it they are joined by a shuffle.
BROADCAST_LINES = 500_000
TRIM = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _core(line: Column) -> Column:
    return F.btrim(line, F.lit(TRIM))


def _key(core: Column) -> tuple[Column, Column]:
    return F.xxhash64(core), F.hash(core)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, site, h1, h2, size of every line with a word."""
    site = F.coalesce(F.xxhash64("source"), F.lit(0)).alias("site")
    lines = docs.select("doc_id", site, F.explode_outer(F.transform(_lines(F.col("text")), _core)).alias("line")).where("line <> ''")
    h1, h2 = _key(F.col("line"))
    return lines.select("doc_id", "site", h1.alias("h1"), h2.alias("h2"), F.char_length("line").alias("size"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """h1, h2 of the lines that occur at min_sites sites or more."""
    key = ["h1", "h2"]
    rows = rows.select(*key, "site").distinct()
    spread = rows.groupBy(*key).agg(F.min("site").alias("lo"), F.max("site").alias("hi")).where("lo < hi").select(*key)
    shared = rows.select(*key, "site").join(spread, key, "left_semi")
    sketch = shared.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("n"))
    most = max(1, int(min_sites * band) + 1)
    near = sketch.where(F.abs(F.col("n") - min_sites) <= most).select(*key)
    exact = shared.join(near, key, "left_semi").groupBy(*key).agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return sketch.where(F.col("n") > min_sites + most).select(*key).unionByName(exact.select(*key))


def cuts(docs: DataFrame, min_sites: int = MIN_SITES, max_share: float = MAX_SHARE, band: float = BAND) -> DataFrame:
    """doc_id and the hashes (array of struct h1, h2) of the lines to cut, for the documents that have any."""
    rows = occurrences(docs).where("doc_id IS NOT NULL")
    wide = written(boilerplate(occurrences(docs), min_sites, band), "boilerplate")
    hits = rows.join(small(wide, BROADCAST_LINES), ["h1", "h2"], "left_semi")
    return hits.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("cut"))


def deduped(docs: DataFrame, min_sites: int = MIN_SITES, max_share: float = MAX_SHARE, band: float = BAND) -> DataFrame:
    """docs with `line_dedup` (fresh(): with underscores where docs has such a column), a struct: kept_text, n_lines,
    n_removed (of lines with a word)."""
    of, gone = fresh(docs, "_line_doc_id"), fresh(docs, "_line_cut")
    found = cuts(docs, min_sites, max_share, band).select(F.col("doc_id").alias(of), F.col("cut").alias(gone))
    joined = docs.join(found, F.col("doc_id") == F.col(of), "left")

    def cut(lines: Column) -> Column:
        h = lambda x: F.struct(*[k.alias(n) for k, n in zip(_key(_core(x)), ("h1", "h2"), strict=True)])
        hit = lambda x: F.coalesce((_core(x) != "") & F.array_contains(F.col(gone), h(x)), F.lit(False))
        total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x["size"])

        def judged(a: Column) -> Column:
            few = total(F.filter(a, lambda x: x["hit"])) <= max_share * total(a)
            kept = F.when(few, F.filter(a, lambda x: ~x["hit"])).otherwise(a)
            return let(kept, lambda k: F.struct(
                F.when(F.col("text").isNotNull(), F.array_join(F.transform(k, lambda x: x["line"]), "\n")).alias("kept_text"),
                F.size(F.filter(a, lambda x: x["size"] > 0)).cast("long").alias("n_lines"),
                (F.size(a) - F.size(k)).cast("long").alias("n_removed"),
            ))

        each = F.transform(lines, lambda x: F.struct(x.alias("line"), F.char_length(_core(x)).alias("size"), hit(x).alias("hit")))
        return let(each, judged)

    own = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*own, let(_lines(F.col("text")), cut).alias(fresh(docs, "line_dedup")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out, x = deduped(docs), F.col("line_dedup")
    return out.select("doc_id", x["n_lines"].alias("n_lines"), x["n_removed"].alias("n_removed"), F.sha2(F.coalesce(x["kept_text"], F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH raw AS (
  SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), lines AS (
  SELECT doc_id, source, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM raw
), cores AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, l, i, trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS c FROM lines
), wide AS (
  SELECT c FROM cores WHERE c <> '' GROUP BY c HAVING count(DISTINCT site) >= 10
), sized AS (
  SELECT doc_id, sum(length(c)) AS size, sum(CASE WHEN c IN (SELECT c FROM wide) THEN length(c) ELSE 0 END) AS cut
  FROM cores WHERE c <> '' GROUP BY doc_id
), kept AS (
  SELECT cores.doc_id, l, i, c,
    c <> '' AND c IN (SELECT c FROM wide) AND coalesce(cut <= 0.5 * size, false) AS gone
  FROM cores LEFT JOIN sized ON cores.doc_id = sized.doc_id
)
SELECT doc_id, count(*) FILTER (c <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """docs with the boilerplate cut from their texts, and n_chars, if there, counted again. No document goes."""
    out, x = deduped(docs, **options), F.col(fresh(docs, "line_dedup"))
    changed = x["n_removed"] > 0
    new = {"text": F.when(changed, x["kept_text"]).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length(x["kept_text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
