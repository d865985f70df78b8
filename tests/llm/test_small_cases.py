"""Every operator on small tables: brute force, nulls, empties, repeats, ties, extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayfold.llm import bpe, decontaminate, jaccard_join, katz, line_dedup, quality_rules, suffix_dedup, toxicity, url_filter, warc
from wayfold.llm.common import new_path

DOCS = "doc_id bigint, text string, source string, start int, found string"


def corpus(seed=1, n=60):
    """Rows with copies, near copies, shared passages, nulls, empties, repeats and clashing extra columns."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(40)
    rows = []
    for i in range(n):
        kind = i % 6
        t = text(r.randint(0, 200))
        if kind == 1 and rows:
            t = r.choice(rows)[1]
        elif kind == 2 and rows:
            ws = (r.choice(rows)[1] or "").split(" ")
            ws[len(ws) // 2 : len(ws) // 2 + 1] = ["edited"]
            t = " ".join(ws)
        elif kind == 3:
            t = text(20) + "\n" + passage + "\n" + text(30)
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Word"), (n + 4, "word"), (n + 5, "aaaa" * 200), (n + 6, text(6000)), (5, rows[5][1])]
    return [(i, t, f"s{(i or 0) % 13}" if i != 3 else None, i, "x") for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().lower().split()


def shingled(t):
    w = words(t)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_quality_rules(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "a") for i in range(30)] + [(None, 1, "b")], "doc_id bigint, quality int, text string")
    got = quality_rules.judged(docs, labels, n=256).select("doc_id", "text", "quality.*").collect()
    assert len(got) == len(rows)
    tokens = lambda t: __import__("re").findall(quality_rules.TOKEN, t or "")

    def buckets(t):
        c = [zlib.crc32(x.encode()) for x in tokens(t)]
        return [x & 255 for x in c] + [(a * 31 + b) & 255 for a, b in zip(c, c[1:])]

    target = {i for i in range(30) if i % 3 > 0}
    raw, good = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(buckets(t))
        good.update(buckets(t) if i in target else [])
    R, T = sum(raw.values()), sum(good.values())
    w = [round(1e6 * (math.log((good[b] + 1) / (T + 256)) - math.log((raw[b] + 1) / (R + 256)))) for b in range(256)]
    for x in got:
        t = x["text"] or ""
        ws = [y for y in __import__("re").split(r"[\x20\x09-\x0D]+", t) if y]
        seen = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        hit = {j for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [y for y in t.split("\n") if y.strip(" \t\n\x0b\f\r")]
        assert (x["n_words"], x["word_chars"], x["n_repeat_words"], x["n_dup_lines"]) == (len(ws), sum(map(len, ws)), len(hit), len(lines) - len(set(lines)))
        assert x["n_symbols"] == sum(t.count(c) for c in quality_rules.SYMBOLS)
        assert x["base_failed"] == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws))
        b = buckets(t)
        assert abs(x["llr"] - sum(w[y] for y in b)) <= len(b) and x["n_grams"] == len(b)
        assert x["kept"] == (not x["base_failed"] and x["llr"] >= quality_rules.THRESHOLD * len(b))
    assert quality_rules.judged(empty, labels).count() == 0
    assert quality_rules.kept(docs, labels.where("false")).columns == docs.columns


def test_tokens_are_found_without_ranges_and_are_the_same(spark):
    tokens = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # every character of the first planes in three neighbourhoods, and runs of mixed ones
    r = random.Random(3)
    texts = [f"{c}a{c}.{c}{c} " for c in map(chr, [*range(0xD800), *range(0xE000, 0x10200), 0x1F600, 0x10FFFF])]
    texts += ["".join(r.choice("aZ09é_-.,!~{} \t\n\x0b\x7f\x85\u2003]^[\\&") for _ in range(60)) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(tokens(F.col("text"), quality_rules.TOKEN).alias("a"), tokens(F.col("text"), quality_rules.LISTED_TOKEN).alias("b"))
    assert df.where("a <> b").count() == 0 and df.where("size(b) > 1").count() > 2000

    # Java calls a function for each range of a class; with all characters listed it looks them up
    plan = spark.range(1).select(quality_rules.buckets(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert r"\x21\x22" in plan and r"\x21-\x2F" not in plan


def test_every_trusted_label_is_counted(spark):
    docs = spark.range(20_100).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    # a target equal to the corpus has no weight
    assert set(quality_rules.weights(docs, labels, n=256).first()["w"]) == {0}
    for bound in (20_100, 20_099):
        assert set(quality_rules.weights(docs, labels, n=256, broadcast_rows=bound).first()["w"]) == {0}


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a", "x y z", "a b c d a b c x b c d"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(quality_rules.repeat_words(F.split("text", " "))).collect()] == [6, 4, 0, 10]


def test_katz(spark, docs, rows, empty):
    got = katz.scored(docs, block_tokens=700).collect()
    tok = [(i, katz.held_out(i), [*words(t), None]) for i, t, *_ in rows]
    c1, c2 = Counter(), Counter()
    for _, held, w in tok:
        if not held:
            c1.update(w)
            c2.update(zip([0, *w], w))
    import numpy as np

    N, V = sum(c1.values()), len(c1)
    d1, d2 = katz.Discounts(Counter(c1.values())), katz.Discounts(Counter(c2.values()))
    cut = lambda d, n: int(d.of(np.array([n]))[0]) / katz.UNIT
    unknown = 1 - sum(cut(d1, n) for n in c1.values()) / N
    single = lambda w: cut(d1, c1[w]) / N if w in c1 else unknown
    hist, left, rest = Counter(), Counter(), Counter()
    for (h, w), n in c2.items():
        hist[h] += n
        left[h] += cut(d2, n)
        rest[h] += single(w)
    alpha = {h: (1 - left[h] / hist[h]) / (1 - rest[h]) for h in hist}
    p = lambda h, w: cut(d2, c2[h, w]) / hist[h] if (h, w) in c2 else alpha.get(h, 1) * single(w)
    for h in list(hist)[:20]:
        assert abs(sum(p(h, w) for w in c1) + alpha[h] * unknown - 1) < 1e-9
    want = sorted((i, held, len(w), sum(x in c1 for x in w), N, sum(math.log10((c1[x] + 1) / (N + V + 1)) for x in w), sum(math.log10(p(a, b)) for a, b in zip([0, *w], w))) for i, held, w in tok)
    for a, b in zip(sorted(tuple(r) for r in got), want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert katz.scored(empty).count() == 0


def test_url_filter(spark):
    urls = ["http://A.example.com/en/7?x", "https://www.example.com/en/8/", "x.net/de/", None, "https://a.net/de/9", "http://z.example.net/de/88#q", "http://bad.info/p/?a", "https://www.bad.info/p", "ftp://fine.info/p2", "http://notorg/es/", "http://b.org/es/x", "://", "http://?x"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(6, urls[6], "r")], "page_id bigint, url string, rule string")
    listed = spark.createDataFrame([("http://bad.info/p",), (None,), ("nothing",)], "url string")
    for blocks in (1 << 18, 0):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, listed, broadcast_blocks=blocks).collect()}
        assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
        assert got[1] == ("www.example.com", "/en/8/", "com/en/", "block")
        assert got[2] == got[3] == got[11] == got[12] == ("", "", None, "allow")
        assert got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("example.net/de/8", "block")
        assert got[6][2:] == got[7][2:] == (None, "block") and got[8][2:] == (None, "allow")
        assert got[9][2:] == (None, "allow") and got[10][2:] == ("org/es/", "block")
    assert url_filter.judge(pages, listed.where("false")).where("verdict = 'block'").count() == 3
    assert url_filter.judge(pages.where("false"), listed).count() == 0


def test_bloom_has_no_false_negatives_and_the_join_no_false_positives(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.format_string("http://h.info/%d", "id").alias("url"))
    listed = pages.where("page_id % 3 = 0").select("url")
    got = url_filter.judge(pages, listed, bits_per_url=4)
    assert got.where("(verdict = 'block') <> (page_id % 3 = 0)").count() == 0
    assert got.where("maybe_listed AND page_id % 3 <> 0").count() > 0


def test_url_filter_with_a_list_on_supplied_pages(spark):
    path = "/root/testdata/sf0.1/pages.parquet"
    if not __import__("os").path.exists(path):
        pytest.skip("no tables here")
    pages = spark.read.parquet(path).select("page_id", "url")
    host, _ = url_filter.host_and_path(F.col("url"))
    listed = {r["page_id"] for r in pages.where(host.rlike(url_filter.LISTED_HOST)).collect()}
    got = url_filter.judge(pages, pages.where(F.col("page_id").isin(sorted(listed))).select("url")).collect()
    assert listed and listed <= {r["page_id"] for r in got if r["maybe_listed"]}
    unruled = [r for r in got if r["rule"] is None]
    assert {r["page_id"] for r in unruled if r["verdict"] == "block"} == listed & {r["page_id"] for r in unruled} != set()


def test_bpe(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    odd = ["İstanbul ǅ ﬁ é é x y 12345 don't I'LL", "a<|endoftext|>b <|startoftext|>", "日本語 😀😀", "\x00\x1fb", "ΑΣ Σ", "qzqz ##@@ wj" * 50, "x" * 2000]
    more = spark.createDataFrame([(1000 + i, x, "s", 0, "x") for i, x in enumerate(odd)], DOCS)
    for r in bpe.encoded(docs.unionByName(more).withColumn("ids", F.lit(1))).collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False) and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert bpe.encoded(empty).count() == 0


def test_forced_boundaries_cut_nothing_that_merges():
    c = bpe.Codec(bpe.default_path())
    word = c.pre.pre_tokenize_str("straßenbahnüberführungsgesellschaft")[0][0]
    assert len(c.fragments(word)) > 1 and "".join(c.fragments(word)) == word
    assert c.word(word) == [t.id for t in c.last.tokenize(word)]


@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_suffix_dedup(spark, docs, rows, empty, piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup.Runs.__init__, "__defaults__", (512,))
    got = suffix_dedup.deduped(docs, size=40, k=12, block_bytes=3000, with_text=True, piece_bytes=piece).collect()
    seen, want = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 39):
            if b[p : p + 40] in seen:
                gone[p : p + 40] = b"\1" * 40
            seen.add(b[p : p + 40])
        want.append((i, len(b), sum(gone), sum(g and not h for g, h in zip(gone, b"\0" + gone)), bytes(x for x, g in zip(b, gone) if not g)))
    for a, b in zip(sorted(tuple(r)[:4] + (bytes(r["kept"]),) for r in got), sorted(want), strict=True):
        assert a == b
    assert suffix_dedup.deduped(empty).count() == 0


def test_runs_do_not_depend_on_segments_but_for_their_cuts():
    import numpy as np

    data = bytes(np.random.default_rng(3).integers(97, 100, 5000).astype(np.uint8))
    sizes = np.array([3000, 30, 1970])
    starts = lambda r: sorted(p for x, y in zip(r.lo, r.hi) for p in range(x, y + 1))
    one, many = suffix_dedup.Runs(data, sizes, 40, 12), suffix_dedup.Runs(data, sizes, 40, 12, 64)
    assert starts(one) == starts(many) == [*range(2961), *range(3030, 4961)]
    begin, prints = many.windows(np.arange(len(many.at)))
    assert (begin == one.windows(np.arange(len(one.at)))[0]).all() and len(set(prints)) == len({data[p : p + 40] for p in begin})


def test_a_very_long_text_is_deduped_in_pieces(spark):
    import numpy as np

    r = np.random.default_rng(4)
    own = "".join(map(chr, r.integers(97, 123, 5_000_000)))
    docs = spark.createDataFrame([(1, own + own[1_000_000:1_500_000] + "!"), (2, "x" + own[4_000_000:] + "?")], "doc_id bigint, text string")
    got = {x["doc_id"]: tuple(x)[1:4] for x in suffix_dedup.deduped(docs).collect()}
    assert got == {1: (5_500_001, 500_000, 1), 2: (1_000_002, 1_000_000, 1)}


def test_family_merges_geometrically():
    import numpy as np

    f = suffix_dedup.Family()
    for b in range(64):
        k = np.unique(np.random.default_rng(b).integers(0, 500, 50)).astype(np.uint64)
        f.add((k, np.full(len(k), 100 - b), np.full(len(k), b), k, k))
    assert len(f.levels) <= 4
    doc, *_ = f.scan(np.arange(500, dtype=np.uint64))
    assert doc.min() == 37


def test_toxicity(spark, empty):
    r = random.Random(4)
    plain = [f"w{i}x" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        ws = [r.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            ws[7] = r.choice(["grumblo", "GRUMBLO", "vexostra", "vexolino", "vexobar", "Vexozzz"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int").where("doc_id < 300")
    lexicon = toxicity.learn(docs, known)
    unseen = [(900, "w1x gruмbl0 w2x"), (901, "w1x vexonew w2x"), (902, None), (903, ""), (904, "w1x w2x"), (None, "grumblo")]
    got = {x["doc_id"]: x for x in toxicity.scored(docs.unionByName(spark.createDataFrame(unseen, docs.schema)), lexicon).collect()}
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(300, 400))
    assert got[900]["predicted"] == got[901]["predicted"] == got[None]["predicted"] == 1
    assert got[902]["predicted"] == got[903]["predicted"] == got[904]["predicted"] == 0
    assert toxicity.scored(docs, toxicity.learn(docs, known.where("false"))).where("score > 0.01").count() == 0
    assert toxicity.scored(empty, lexicon).count() == 0


def plain_score(lexicon, words):
    """The lexicon's sum by looking every word up: an independent scorer."""
    free = {i for e in lexicon.exceptions for i in range(len(words)) if words[i : i + len(e.split())] == e.split() for i in range(i, i + len(e.split()))}
    best = lambda w: max([lexicon.words.get(w, 0.0), *(v for s, v in lexicon.stems.items() if w.startswith(s))])
    return sum(best(w) for i, w in enumerate(words) if i not in free)


def test_toxicity_against_an_independent_scorer(spark):
    r = random.Random(8)
    names = [f"w{i}" for i in range(30)] + ["grumblo", "grumblost", "vexo", "trash", "can", "circus", "clown", "not", "an", "idiot"]
    lexicon = toxicity.Lexicon({"grumblo": 4.0, "clown": 3.0, "idiot": 5.0, "trash": 2.0, "can": 0.5}, {"grum": 1.5, "vexo": 2.5, "tras": 1.0}, fit=(-3.0, 1.0, 0.5))
    rows = [(i, " ".join(r.choice(names) for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 50, 300, 20_000] * 3)] + [(5, "clown clown"), (5, "clown clown")]
    docs = spark.createDataFrame([(*x, 1.0, "lang") for x in rows], "doc_id bigint, text string, score double, weight string")
    got = sorted((x["doc_id"], x["weight"], x["score"]) for x in toxicity.scored(docs, lexicon).collect())
    want = []
    for i, t in rows:
        w = t.split()
        s = plain_score(lexicon, w)
        z = -3.0 + math.log1p(s) + 0.5 * math.log1p(100 * s / max(len(w), 20))
        want.append((i, s, 1 / (1 + math.exp(-z))))
    for a, b in zip(got, sorted(want), strict=True):
        assert a == pytest.approx(b)


def test_the_lexicon_has_no_cap(spark):
    rows = [(i, " ".join(f"bad{k}x" for k in range(5000)) if i < 20 else "fine words here") for i in range(100)]
    known = spark.createDataFrame([(i, int(i < 20)) for i in range(100)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string")
    assert len(toxicity.learn(docs, known).words) == 5000


def test_exception_phrases():
    x = toxicity.Lexicon({"clown": 5.0}, {}, ("circus clown",))
    a = x.automaton()
    assert x.matched(a, ["a", "circus", "clown"]) == 0 and x.matched(a, ["a", "clown"]) == 5.0
    assert toxicity.fold("St0p, CLоWN! 2024") == ["stop", "clown", "2024"]


def test_warc(spark):
    rows = [(1, "http://a/1", "same" * 50), (3, "http://a/3", "same" * 50), (2, None, "same" * 50), (4, "u\r\nx", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 60), (9, "u", "é" * 60), (None, "u", "same" * 50), (1, "again", "same" * 50)]
    pages = spark.createDataFrame([(*x, "z") for x in rows], "page_id bigint, url string, html string, payload string").repartition(3)
    path = new_path(spark, "archive")
    warc.write(pages, path, roll_mb=1)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    want = sorted((str(p), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if p in (2, 3, 9, None) else "response", {2: 1, 3: 1, 9: 8, None: 1}.get(p)) for p, _, h in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    texts = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert texts[8] == ("é" * 60).encode() and texts[6] == b""
    digests = warc.read(spark, path, "digest").where("record_type = 'response' AND page_id > 4")
    assert sorted(r["page_id"] for r in digests.collect()) == [5, 6, 7, 8]
    assert warc.read(spark, path, "none").where("NOT record_type = 'response' OR page_id IN (4, 5)").where("page_id IS NOT NULL").count() == 5
    nothing = new_path(spark, "nothing")
    warc.write(pages.where("false"), nothing)
    assert warc.read(spark, nothing).count() == 0


def test_unwanted_payloads_are_not_decoded():
    import io

    data = b"".join(warc.record({"page_id": i, "target_uri": "u", "record_type": "response", "refers_to": None, "payload_digest": "d", "payload_bytes": 3, "payload": b"abc"}) for i in range(3))
    broken = data.replace(b"\x1f\x8b", b"\x00\x00")
    from pyspark.sql.datasource import EqualTo

    none = list(warc.records(io.BytesIO(broken), [EqualTo(("record_type",), "request")], "full"))
    assert none == [] and len(list(warc.records(io.BytesIO(broken), [], "none"))) == 3
    assert [r["payload"] for r in warc.records(io.BytesIO(data), [EqualTo(("page_id",), 1)], "full")] == [b"abc"]


@pytest.mark.parametrize("chunk", [4000, 3])
def test_jaccard_join(docs, rows, empty, chunk):
    got = jaccard_join.near(docs, chunk=chunk).collect()
    sets = [(i, shingled(t)) for i, t, *_ in rows]
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    assert sorted(tuple(r) for r in got) == sorted((i, len(s), find(i)) for i, s in sets)
    assert jaccard_join.near(empty).count() == 0
    left = jaccard_join.one_of_each(docs, chunk=chunk)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {find(i) for i in up}


def test_jaccard_join_shuffles_far_fewer_bytes_than_its_shingles_have(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    texts = []
    for i in range(150):
        # pairs of near copies: every set goes to a group
        ws = [r.choice(vocabulary) for _ in range(1000)] if i % 2 == 0 else [*ws[:500], "edited", *ws[501:]]
        texts.append((i, " ".join(ws)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(x := stages.apply(i)).stageId(): x.shuffleWriteBytes() for i in range(stages.size())}

    table, key = jaccard_join.written(docs, "documents"), "spark.sql.autoBroadcastJoinThreshold"
    broadcast = spark.conf.get(key)
    spark.conf.set(key, "-1")
    signed_rows, before = jaccard_join.signed(table), shuffled()
    try:
        links = jaccard_join.links(table, signed_rows).collect()
    finally:
        spark.conf.set(key, broadcast)
    assert {(max(x), min(x)) for x in links} == {(i + 1, i) for i in range(0, 150, 2)}
    # shingles as they are: 1.14 MB in the largest shuffle
    assert max(n for k, n in shuffled().items() if k not in before) < 0.6 * 8 * sum(len(shingled(t)) for _, t in texts)


def test_words_on_their_way_to_the_groups(rows):
    for _, text, *_ in [*rows, (0, "\x00A\x0bB\x1c\x85\u2003É\tz")]:
        assert jaccard_join.unpacked_words(jaccard_join.packed_words(text)) == jaccard_join.split_words(text)


@pytest.mark.parametrize("seed", range(4))
def test_tries_of_large_groups_link_what_brute_force_links(seed, monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard_join, "BUCKET", 8 << 2 * seed)

    r = np.random.default_rng(seed)
    core = r.choice(1 << 40, 60, replace=False)
    sets = []
    for i in range(700):
        own = np.random.default_rng(1000 + i % 12).choice(1 << 40, 40, replace=False)
        keep = r.random(100) > 0.03
        sets.append(np.unique(np.r_[np.r_[core, own][keep], r.choice(1 << 40, r.integers(0, 4), replace=False)]).astype(np.uint64))
    sizes = np.array([len(s) for s in sets])
    join = jaccard_join.Join(jaccard_join.ordered(sets), sizes)
    nodes, stack = 0, [join.root]
    while stack:
        n = stack.pop()
        nodes, stack = nodes + 1, stack + n.children
    assert nodes > (10 if seed == 0 else 1)
    links = join.run()

    def roots(pairs):
        up = list(range(len(sets)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            up[y] = x
        return [find(i) for i in range(len(sets))]

    asset = [set(s.tolist()) for s in sets]
    close = lambda a, b: 100 * (k := len(asset[a] & asset[b])) >= 90 * (len(asset[a]) + len(asset[b]) - k)
    assert all(close(a, b) for a, b in links) and len(links) < len(sets)
    assert roots(links) == roots([(a, b) for a in range(len(sets)) for b in range(a) if close(a, b)])


def test_components(spark):
    from wayfold.llm.components import components

    links = [(5, 3), (3, 9), (9, 9), (7, 8), (8, 7), (20, 21), (21, 22), (22, 23), (23, 24), (40, 41), *[(100 + i, 99) for i in range(300)], *[(500 + i, 501 + i) for i in range(60)], (None, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {5: 3, 3: 3, 9: 3, 7: 7, 8: 7, 40: 40, 41: 40} | {i: 20 for i in range(20, 25)} | {100 + i: 99 for i in range(300)} | {99: 99} | {i: 500 for i in range(500, 561)}
    assert got == want


def test_line_dedup(spark, empty):
    body = "\n".join(f"own line number {{}} {k}" for k in range(6))
    rows = [(i, body.replace("{}", str(i)) + ("\n Shared footer \n" if i < 12 else f"\nrare footer {i % 3}"), f"s{i % 12}" if i else None, 0, "x") for i in range(30)]
    rows += [(100 + i, "Shared footer\ncopied text", f"s{i}", 0, "x") for i in range(11)] + [(200, None, "s1", 0, "x"), (201, "", "s1", 0, "x"), (202, "Shared footer\n" + body, None, 0, "x"), (None, "Shared footer\n" + body, "s1", 0, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["line_dedup"] for r in line_dedup.deduped(docs, min_sites=10).collect()}
    assert all(got[i]["n_removed"] == 1 and "Shared" not in got[i]["kept_text"] for i in range(12))
    assert all(got[i]["n_removed"] == 0 and "rare footer" in got[i]["kept_text"] for i in range(12, 30))
    assert all(got[100 + i]["n_removed"] == 0 for i in range(11)) and got[202]["n_removed"] == 1
    assert got[200]["kept_text"] is None and got[201]["kept_text"] == "" and got[None]["n_removed"] == 0
    clean = line_dedup.cleaned(docs, min_sites=10)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    for sites in (9, 10, 11, 12, 13, 14):
        rows_ = line_dedup.occurrences(docs)
        exact = {tuple(r)[:2] for r in rows_.groupBy("h1", "h2").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= sites).collect()}
        assert {tuple(r) for r in line_dedup.boilerplate(rows_, sites).collect()} == exact
    assert line_dedup.deduped(empty).count() == 0


def test_boilerplate_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    want = sorted(map(str, line_dedup.deduped(docs, min_sites=3).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(str, line_dedup.deduped(docs, min_sites=3).collect())) == want


def test_repeated_rows_are_cut_as_one_alone_would_be(spark):
    text = lambda i, k: "Shared footer line\n" + "\n".join(f"own text {i} {j}" for j in range(k))
    rows = [(i, text(i, 5), f"s{i}") for i in range(12)] + [(0, text(0, 5), "s0")] * 2 + [(1, text(1, 1), "s1")]
    got = line_dedup.deduped(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), min_sites=10).collect()
    # a footer of 18 characters: under half of the text beside five own lines, over half beside one
    assert len(got) == 15 and all(r["line_dedup"]["n_removed"] == int(r["text"].count("own") == 5) for r in got)


def test_decontaminate(spark, docs, rows, empty):
    some = [" ".join(words(t)[k : k + 12][j].decode() for j in range(12)) for k, (_, t, *_) in enumerate(rows[:20]) if len(words(t)) > 40]
    items = [(i, x.upper() if i % 2 else x) for i, x in enumerate(some)] + [(90, "Word"), (91, None), (92, ""), (93, "never seen zzzz"), (None, some[0]), (94, some[0]), (94, some[0])]
    bench = spark.createDataFrame([(*x, "d") for x in items], "item_id bigint, text string, doc_id string")
    split = lambda t: [w for w in __import__("re").split(decontaminate.NOT_WORD, "".join(c.lower() if c < "\x7f" else c for c in t or "")) if w]
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 7) if w and i is not None else 0):
            wins.setdefault(tuple(w[k : k + 8]), set()).add(i)
    got = decontaminate.matches(docs, bench).select("doc_id", "text", "leaks.*").collect()
    assert len(got) == len(rows)
    for r in got:
        w = split(r["text"])
        hit, found = set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in wins}:
                if (x := tuple(w[k : k + size])) in wins and len(x) == size:
                    hit |= set(range(k, k + size))
                    found |= wins[x]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found)), r["doc_id"]
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(docs, bench.where("false")).where("leaks.n_hit > 0").count() == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a x x x b"), (3, None), (4, "b a")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(7, "A b"), (8, ""), (9, "zz")], "query_id int, text string")
    got = {tuple(r) for r in decontaminate.proximity(docs, asked, 3).collect()}
    assert got == {(7, 1, 0, 2), (7, 4, 0, 1)}
