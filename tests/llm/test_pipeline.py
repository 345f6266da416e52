"""The pipeline's stages, each against the plain form of its operator on a small table."""

from __future__ import annotations

import random

import corpus_pipeline
from ballotbook.llm import decontamination, lines, minhash, quality


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    bench = [(k, text(20)) for k in range(4)]
    rows, labels = [], []
    for k in range(200):
        bad = k % 5 == 0
        t = " ".join(f"{w}$$$" for w in text(50).split()) if bad else "\n".join(text(25) + "." for _ in range(3))
        if k % 50 == 3:
            t += "\n" + bench[k // 50][1]
        rows.append((k, t, "en", f"s{k % 4}", len(t)))
        labels.append((k, int(not bad), 0))
    near = rows[7][1].split(" ")
    near[3] = "changed"
    rows.append((300, " ".join(near).replace("\n", " "), "en", "s1", 10))
    rows.append((301, None, "en", None, None))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    marks, items = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    ids = lambda frame: sorted(r[0] for r in frame.select("doc_id").collect())
    plain = {
        "quality": lambda x: ids(x.join(quality.score_quality(x, marks).filter("predicted = 1").select("doc_id"), "doc_id", "left_semi")),
        "lines": lambda x: sorted((r[0], r[1]) for r in lines.dedup_lines(x).select("doc_id", "text").collect() if r[1]),
        "near_duplicates": lambda x: ids(minhash.near_duplicates(x).filter("kept")),
        "decontamination": lambda x: ids(decontamination.contamination(x, items).filter("not contaminated")),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        out = spark.read.parquet(f"{d}/{name}")
        found = sorted((r[0], r[1]) for r in out.select("doc_id", "text").collect() if r[1]) if name == "lines" else ids(out)
        assert found == plain[name](docs)
        docs = out
    left = set(ids(docs))
    assert [k for k in left if k < 200 and (k % 5 == 0 or k % 50 == 3)] == [] and len(left) >= 150
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in packed} == left


def test_stages_on_odd_rows(spark, docs_of, odd_texts, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "the same few words here again")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = docs_of([*odd_texts, (7, odd_texts[6][1])])
    stages = dict(corpus_pipeline.STAGES)
    by = lambda x: sorted((r["doc_id"] or 0 for r in x.collect()))
    # Without labels every score is below the threshold.
    none = stages["quality"](spark, docs, d)
    assert none.columns == docs.columns and by(none) == []
    out = stages["lines"](spark, docs, d).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 1, 2, 3, 4, 5, 6, 7, 7, 8]
    texts = {r["doc_id"]: r["text"] for r in out if r["doc_id"] != 7}
    assert texts[1] is None and texts[5] == odd_texts[4][1] and texts[6] == "" and texts[8] == odd_texts[7][1]
    assert sorted(r["text"] for r in out if r["doc_id"] == 7) == ["", odd_texts[6][1]]
    near = stages["near_duplicates"](spark, docs, d)
    assert near.columns == docs.columns and by(near) == [0, 1, 2, 3, 4, 5, 7, 7, 8]
    clean = stages["decontamination"](spark, docs, d)
    assert clean.columns == docs.columns and by(clean) == [0, 1, 2, 3, 4, 7, 7, 8]
    empty = docs.filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0, name
