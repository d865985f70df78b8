"""The whole pipeline against a plain version: loops over Python lists, one function for each stage."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
from tokenizers import Tokenizer
from wayfold.llm import bpe, decontaminate, quality_rules
from wayfold.llm.common import new_path

SPACES = " \t\n\x0b\f\r"
#: The columns of documents, then extra ones with names that the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality int, line_dedup string, leaks string, _away bigint, _w bigint, start int"
EXTRA = (7, "x", "y", 8, 9, 10)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def grams(text):
    codes = [zlib.crc32(x.encode()) for x in re.findall(quality_rules.TOKEN, text or "")]
    n = quality_rules.BUCKETS - 1
    return [c & n for c in codes] + [(a * 31 + b) & n for a, b in zip(codes, codes[1:])]


def plain_rules(rows, target):
    raw, good = Counter(), Counter()
    for r in rows:
        raw.update(grams(r[1]))
        good.update(grams(r[1]) if r[0] in target else [])
    n, whole, part = quality_rules.BUCKETS, sum(raw.values()), sum(good.values())
    weight = lambda b: round(1e6 * (math.log((good[b] + 1) / (part + n)) - math.log((raw[b] + 1) / (whole + n)))) if part else 0
    kept = []
    for r in rows:
        ws = split(r[1])
        seen = Counter(zip(ws, ws[1:], ws[2:]))
        again = {j for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if seen[w] > 1 for j in (i, i + 1, i + 2)}
        b = grams(r[1])
        if len(ws) >= 50 and 100 * len(again) <= 50 * len(ws) and sum(map(weight, b)) >= quality_rules.THRESHOLD * len(b):
            kept.append(r)
    return kept


def plain_lines(rows):
    sites = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if core := line.strip(SPACES):
                sites.setdefault(core, set()).add(r[3])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        cut = [x for x in lines if r[0] is not None and len(sites.get(x.strip(SPACES), ())) >= 10]
        if cut and sum(len(x.strip(SPACES)) for x in cut) <= 0.5 * sum(len(x.strip(SPACES)) for x in lines):
            text = "\n".join(x for x in lines if x not in cut)
            r = (r[0], text, *r[2:4], len(text), *r[5:])
        out.append(r)
    return out


def plain_copies(rows):
    def shingled(text):
        ws = [w.lower() for w in split(text)]
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = [(r[0], shingled(r[1])) for r in rows if r[0] is not None]
    least = {i: i for i, _ in sets}
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    while any(least[i] != least[j] for i, j in links):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return [r for r in rows if r[0] is None or least[r[0]] == r[0]]


def plain_leaks(rows, items):
    cut = lambda t: [w for w in re.split(decontaminate.NOT_WORD, (t or "").lower()) if w]
    windows = {}
    for i, t in items:
        ws = cut(t)
        for k in range(max(1, len(ws) - 7) if ws and i is not None else 0):
            windows.setdefault(tuple(ws[k : k + 8]), set()).add(i)
    sizes, kept = {len(w) for w in windows}, []
    for r in rows:
        ws = cut(r[1]) if r[0] is not None else []
        found = [w for n in sizes for k in range(len(ws) - n + 1) if (w := tuple(ws[k : k + n])) in windows]
        if not any(len(w) == 8 for w in found) and len(set().union(*[windows[w] for w in found])) < 2:
            kept.append(r)
    return kept


def plain_tokens(rows):
    tokenizer, out = Tokenizer.from_file(bpe.default_path()), []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x).hexdigest()
        text = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((r[0], len(ids), ids, sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(text.encode())))
    return out


def corpus():
    """Clean documents of several sorts, junk, near and exact copies, shared lines, leaks, repeats, nulls, empties and a very long text."""
    r = random.Random(11)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(600)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    clean = ["\n".join(line(r.randint(8, 14)) for _ in range(r.randint(6, 16))) for _ in range(60)]
    edited = lambda t, n: " ".join("Edited" if i in at else w for i, w in enumerate(ws)) if (ws := t.split(" ")) and (at := set(r.sample(range(len(ws)), n))) else t
    leaks = [line(12), line(9), line(20)]
    texts = list(clean)
    texts += [clean[i] + "\n Common footer of many sites \n" for i in range(20, 34)]
    texts += [clean[3], clean[3].upper(), edited(clean[4], 1), edited(clean[5], 2), edited(clean[6], 8), edited(edited(clean[4], 1), 1)]
    texts += [clean[40] + " " + leaks[0], leaks[1].upper() + ", " + clean[41], clean[42] + " zazu " + clean[43] + " zizi", clean[44] + " zazu"]
    texts += ["$$ || %% ## " * 60, "qx jv " * 80, "\n".join("xqj%d zv%d" % (i, i) for i in range(60)), "short text", "", " \n\t", None, "\n".join(line(12) for _ in range(1500))]
    rows = [(i, t, "en", None if i % 17 == 5 else f"s{i % 13}", len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    # the same row again, another text under the same doc_id, no doc_id
    rows += [rows[7], (8, clean[9] + " " + line(30), "en", "s1", 1, *EXTRA), (None, clean[10], "en", "s2", 1, *EXTRA), (None, clean[11] + " " + leaks[2], None, None, None, *EXTRA)]
    return rows, [(0, leaks[0]), (1, leaks[1]), (2, leaks[2]), (3, "zazu"), (4, "zizi"), (5, None), (6, ""), (None, clean[50])]


def put(spark, rows, labels, items):
    path = new_path(spark, "plain").removeprefix("file://")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def same(got, want):
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_every_stage_and_the_whole_equal_the_plain_version(spark):
    rows, items = corpus()
    long = max(rows, key=lambda r: len(r[1] or ""))[0]
    labels = [(i, 1, 0) for i in [*range(74), long, long]] + [(75, 0, 1), (None, 1, 0)]
    path = put(spark, rows, labels, items)
    target = {i for i, good, _ in labels if good and i is not None}
    plain = [lambda x: plain_rules(x, target), plain_lines, plain_copies, lambda x: plain_leaks(x, items)]
    docs, want, sizes = spark.read.parquet(f"{path}/documents.parquet"), rows, [len(rows)]
    for (name, stage), rule in zip(corpus_pipeline.STAGES, plain, strict=False):
        before, want = want, rule(want)
        got = stage(spark, docs, path)
        assert got.columns == docs.columns, name
        same(got.collect(), want)
        # each stage has something to do here
        assert sorted(map(str, before)) != sorted(map(str, want)), name
        docs = corpus_pipeline.written(got, name)
        sizes.append(len(want))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 40
    same([(*r[:2], list(r[2]), *r[3:]) for r in corpus_pipeline.run(spark, path).collect()], plain_tokens(want))


def test_empty_tables(spark):
    rows, items = corpus()
    path = put(spark, [], [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
    # no label and no benchmark item: only the base rules, lines and copies decide
    path = put(spark, rows[:20], [], [])
    want = plain_tokens(plain_copies(plain_lines(plain_rules(rows[:20], set()))))
    same([(*r[:2], list(r[2]), *r[3:]) for r in corpus_pipeline.run(spark, path).collect()], want)
