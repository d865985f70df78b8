"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Tokens are runs of ASCII punctuation and runs of anything else but white space.
Unigrams and bigrams are hashed to a fixed number of buckets. A bucket's weight
is log(p_target / p_raw) of two smoothed multinomials, in millionths and rounded,
so that every sum is exact and the verdict does not depend on the order of rows.
A document's score is the mean weight of its n-grams; it is kept if that reaches a
fixed threshold and no base rule rejects it.

Nothing is sampled: the trusted target is every labelled row of quality 1, the raw
multinomial counts all documents. The target's ids are broadcast up to a counted bound
(`broadcast_rows`); beyond it documents are shuffled to them. The weights are one array
of `buckets` numbers whatever the size of the corpus, so they go to the executors as a
scalar subquery.

Nulls: a null text is an empty one: no words, no n-grams, base_failed. Rows that
repeat a doc_id are judged one by one. A null doc_id is judged, and never in the
target. Without a labelled target the ratio is 0 and only the base rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, small, table, words
from .sql import crc32

BUCKETS = 1 << 16
BROADCAST_ROWS = 500_000
SMOOTH = 1.0
#: Millionths of a nat for each n-gram.
THRESHOLD = -500_000
SYMBOLS = "#*$%&|<>"
#: ASCII punctuation runs, or runs of neither punctuation nor white space.
TOKEN = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
#: The same language for Spark, with every character of a class by itself: Java looks those up in one table, and calls a function for each range.
_PUNCTUATION = "".join(rf"\x{c:02X}" for a, b in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)) for c in range(a, b + 1))
LISTED_TOKEN = rf"[{_PUNCTUATION}]+|[^\x09\x0A\x0B\x0C\x0D\x20{_PUNCTUATION}]+"
_INDEX_BITS = 24


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def buckets(text: Column, n: int = BUCKETS) -> Column:
    """The buckets of all unigrams, then all bigrams. n: a power of 2."""
    cut = lambda c: c.bitwiseAND(n - 1).cast("int")

    def grams(codes: Column) -> Column:
        pairs = F.transform(codes, lambda c, i: cut(c * 31 + F.coalesce(F.get(codes, i + 1), F.lit(0))))
        return F.concat(F.transform(codes, cut), F.slice(pairs, 1, F.greatest(F.size(codes) - 1, F.lit(0))))

    return let(F.transform(F.regexp_extract_all(text, F.lit(LISTED_TOKEN), F.lit(0)), F.crc32), grams)


def weights(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row with the array of the n buckets' weights."""
    target = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("t_id")).distinct()
    flagged = docs.select("doc_id", "text").join(small(target, broadcast_rows), F.col("doc_id") == F.col("t_id"), "left")
    grams = flagged.select(F.col("t_id").isNotNull().cast("long").alias("t"), F.explode_outer(buckets(_text(), n)).alias("b"))
    counted = grams.where("b IS NOT NULL").groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(n).join(counted, F.col("id") == F.col("b"), "left")
    cells = F.struct("id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    one = every.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("R"), F.coalesce(F.sum("target"), F.lit(0)).alias("T"), F.array_sort(F.collect_list(cells)).alias("x"))
    log = lambda part, whole: F.log((part + SMOOTH) / (F.col(whole) + SMOOTH * n))
    ratio = lambda x: F.round((log(x["target"], "T") - log(x["raw"], "R")) * 1e6).cast("int")
    return one.select(F.transform("x", lambda x: F.when(F.col("T") == 0, F.lit(0)).otherwise(ratio(x))).alias("w"))


def repeat_words(ws: Column) -> Column:
    """How many of the words lie in 3-word windows that the text has twice or more.

    The windows' hashes are sorted within the row, packed with their index into one
    number each; windows that agree in the kept bits are compared again by all 64.
    """
    top = (1 << _INDEX_BITS) - 1
    high = lambda x: F.shiftright(x, _INDEX_BITS)
    twin = lambda key, a: lambda x, i: F.coalesce(key(F.get(a, i - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(a, i + 1)) == key(x), F.lit(False))

    def exact(h: Column, near: Column) -> Column:
        pairs = F.sort_array(F.transform(near, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i"))))
        same = let(pairs, lambda a: F.filter(a, twin(lambda s: s["h"], a)))
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(~top).bitwiseOR(i.cast("bigint"))))
        near = let(packed, lambda a: F.transform(F.filter(a, twin(high, a)), lambda x: x.bitwiseAND(top).cast("int")))
        near = F.when(F.size(h) > top, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(near)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(near, lambda at: exact(h, at)))

    hashed = F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return let(F.slice(hashed, 1, F.greatest(F.size(ws) - 2, F.lit(0))), count)


def measures(text: Column, w: Column, threshold: int = THRESHOLD, n: int = BUCKETS) -> Column:
    """A struct of the base columns, n_grams, llr (the sum of weights, in millionths) and kept."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c, name: c.cast("long").alias(name)
    base = let(words(text), lambda ws: F.struct(long(F.size(ws), "n_words"), long(repeat_words(ws), "n_repeat_words")))
    ratio = let(buckets(text, n), lambda b: F.struct(long(F.size(b), "n_grams"), F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + F.get(w, x)).alias("llr")))
    dup = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))

    def whole(x: Column) -> Column:
        b, r = x["b"], x["r"]
        failed = (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
        return F.struct(
            b["n_words"].alias("n_words"),
            long(F.char_length(F.translate(text, " \t\n\x0b\f\r", "")), "word_chars"),
            long(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")), "n_symbols"),
            long(dup, "n_dup_lines"),
            b["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (r["llr"] >= threshold * r["n_grams"])).alias("kept"),
            r["n_grams"].alias("n_grams"),
            r["llr"].alias("llr"),
        )

    return let(F.struct(base.alias("b"), ratio.alias("r")), whole)


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "llr")


def judged(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, broadcast_rows: int = BROADCAST_ROWS, threshold: int = THRESHOLD) -> DataFrame:
    """docs with `quality` (fresh(): with underscores where docs has such a column), the struct of measures()."""
    own, w = [F.col(f"`{c}`") for c in docs.columns], fresh(docs, "_w")
    out = docs.withColumn(w, weights(docs, labels, n, broadcast_rows).scalar())
    return out.select(*own, measures(_text(), F.col(w), threshold, n).alias(fresh(docs, "quality")))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, unchanged."""
    return judged(docs, labels, **options).where(F.col(fresh(docs, "quality"))["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, table(spark, sf_dir, "labels")).select("doc_id", *[F.col("quality")[c].alias(c) for c in RESULT])


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM docs),
win AS (SELECT r, i, array_to_string(a[i : i + 2], ' ') AS g FROM (SELECT r, a, unnest(generate_series(1, len(a) - 2)) AS i FROM w WHERE len(a) > 2)),
twice AS (SELECT r, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (r, g)) GROUP BY r),
dup AS (SELECT r, len(l) - len(list_distinct(l)) AS n FROM (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs)),
tok AS (SELECT doc_id, r, regexp_extract_all(t, '{TOKEN}') AS k FROM docs),
code AS (SELECT k, {{crc}} AS c FROM (SELECT DISTINCT unnest(k) AS k FROM tok)),
each AS (SELECT doc_id, r, i, c FROM (SELECT doc_id, r, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM tok) JOIN code USING (k)),
gram AS (
  SELECT doc_id, r, c & {BUCKETS - 1} AS b FROM each
  UNION ALL SELECT doc_id, r, (c * 31 + n) & {BUCKETS - 1} FROM (SELECT doc_id, r, c, lead(c) OVER (PARTITION BY r ORDER BY i) AS n FROM each) WHERE n IS NOT NULL
),
target AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
cnt AS (SELECT b, count(*) AS raw, count(target.doc_id) AS tgt FROM gram LEFT JOIN target USING (doc_id) GROUP BY b),
tot AS (SELECT sum(raw) AS R, sum(tgt) AS T FROM cnt),
wt AS (SELECT b, CAST(round((ln((tgt + {SMOOTH}) / (T + {SMOOTH * BUCKETS})) - ln((raw + {SMOOTH}) / (R + {SMOOTH * BUCKETS}))) * 1e6) AS BIGINT) AS v FROM cnt, tot),
llr AS (SELECT r, count(*) AS n, sum(v) AS s FROM gram JOIN wt USING (b) GROUP BY r),
base AS (
  SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(length(array_to_string(a, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(dup.n AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(llr.n, 0) AS BIGINT) AS n_grams, CAST(coalesce(llr.s, 0) AS BIGINT) AS llr
  FROM docs JOIN w USING (r) JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN llr USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND llr >= {THRESHOLD} * n_grams AS kept
FROM base
""".replace("{crc}", crc32("k"))
