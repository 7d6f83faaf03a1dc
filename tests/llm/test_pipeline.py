"""The corpus pipeline: each stage's decisions on its own input, and the whole."""

import random
from collections import Counter

import corpus_pipeline

rng = random.Random(4)


def word():
    return "".join(rng.choices(["the", "ing", "er", "an", "of", "st"], k=rng.randint(1, 3)))


def line():
    return " ".join(word() for _ in range(12)) + "."


def test_pipeline(spark, docs, saved):
    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 4))), "en", f"s{i % 3}", 0) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(5)]
    rows += [(200 + i, " ".join("%$#&" * 4 for _ in range(40)), "en", "s2", 0) for i in range(5)]
    rows += [(300, None, "en", "s0", 0), (301, "", None, None, 0)]
    table = docs([(*r[:4], len(r[1] or "")) for r in rows]).drop("h")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(70)], "doc_id long, quality int, toxic int")
    d = saved(documents=table, labels=labels)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, d)
        if k < 4:
            assert out.columns == table.columns and out.dtypes == table.dtypes
        path = f"{d}/stage{k}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        seen.append(now.collect())
    ids = [Counter(r["doc_id"] for r in s) for s in seen]
    assert set(ids[0]) == {r[0] for r in rows} - {200 + i for i in range(5)}
    text = {r["doc_id"]: r["text"] for r in seen[1]}
    assert ids[1] == ids[0]
    for i in range(5):
        if rows[i][1].count("\n"):
            assert text[100 + i] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in seen[1] if r["text"] is not None)
    assert len([1 for r in seen[2] if not r["text"]]) == 1
    assert set(ids[2]) >= set(range(80))
    assert max(ids[3].values()) <= 3
    assert set(ids[4]) == set(ids[3])
    whole = corpus_pipeline.run(spark, d).collect()
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in whole if r["doc_tokens"] == r["length"]).keys() <= {(r["doc_id"], r["start"], r["length"]) for r in seen[4]} | {(r["doc_id"], 0, r["doc_tokens"]) for r in seen[4]}


def test_entry_lists_the_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= names
