"""The pipeline's stages on a small set of tables, against the operators' own brute-force rules."""

import random

import numpy as np

import corpus_pipeline
from wayfold.llm.common import new_path
from wayfold.llm.jaccard_join import signatures


def test_stages(spark):
    path = new_path(spark, "sf").removeprefix("file://")
    line = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k * 10, k * 10 + 10))
    text = lambda i: "\n".join(line(i, k) for k in range(8))
    leak = " ".join(f"leak{j}" for j in range(10))
    rows = [(i, text(i), "en", f"s{i % 12}") for i in range(24)]
    rows += [(100, text(3), "en", "s1"), (101, text(4) + " more", "en", "s2"), (102, text(50) + " " + leak, "en", "s3"), (103, "too short", "en", "s4"), (104, None, "en", "s5"), (105, "again " * 90, "en", "s6")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(24)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(range(24)) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in got.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "bpe"]


def test_near_copies_are_of_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(100)]
    edited = lambda *at: " ".join("edited" + w if i in at else w for i, w in enumerate(base))
    texts = {1: " ".join(base), 2: edited(30, 70), 3: edited(20, 50, 80), 4: None, 5: ""}

    def jaccard(i, n):
        a, b = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (texts[1].split(), texts[i].split()))
        return len(a & b) / len(a | b)

    assert jaccard(2, 5) > 0.8 > jaccard(3, 5) and jaccard(2, 3) < 0.9
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline._copies(spark, docs, "").collect()} == {1, 3, 4, 5}


def test_signatures_at_four_fifths_are_few_and_lose_no_link():
    draw = np.random.default_rng(5)
    assert len(signatures(np.unique(draw.integers(0, 1 << 63, 5000).astype(np.uint64)), 80)) < 4 * 5000
    r = random.Random(6)
    for size in [*range(1, 40), 90, 300, 1000] * 5:
        a = set(draw.integers(0, 1 << 63, size).tolist())
        gone, new = r.randint(0, size // 9), r.randint(0, size // 9)
        b = set(sorted(a)[gone:]) | set(draw.integers(0, 1 << 63, new).tolist())
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = (set(signatures(np.array(sorted(s), np.uint64), 80).tolist()) for s in (a, b))
            assert x & y
