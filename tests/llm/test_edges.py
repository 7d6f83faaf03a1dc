"""Empty tables, few rows, ties, repeats, very long texts and clashing names, for operators whose own tests have none of them; language identification by brute force."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trivex.llm import common, langid, line_dedup, lsh_search, mixing, norm_search, packing, quality, simhash, suffix_dedup, vectors

rng = random.Random(31)
BYTES, SPACED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(4000)]


def words(n, of=WORDS):
    return " ".join(rng.choices(of, k=n))


def profile(texts, k):
    """The k most frequent 1-, 2- and 3-grams by definition: words set off by one gap, no lone gap, no gap in the middle of three."""
    n = Counter()
    for text in texts:
        s = "_" + "".join(c if c.isalpha() else "_" for c in text.lower()) + "_"
        while "__" in s:
            s = s.replace("__", "_")
        if len(s) > 2:
            n.update(c for c in s if c != "_")
            n.update(s[i : i + 2] for i in range(len(s) - 1))
            n.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != "_")
    code = lambda g: langid_code(g)
    return sorted(n, key=lambda g: (-n[g], code(g)))[:k]


def langid_code(g):
    c = 0
    for x in g:
        c = c << 10 | (int(langid._classes()[ord(x)]) if x != "_" else langid.GAP)
    return c


def test_langid_by_out_of_place_distance(spark, docs, saved):
    from trivex.llm.queries import QUERIES

    letters = {"aa": "abcdefg", "bb": "cdefghij", "cc": "aeioußñ"}
    text = lambda x, n: " ".join("".join(rng.choices(letters[x], k=rng.randint(1, 5))) for _ in range(n))
    rows = [(i, text(x, rng.randint(1, 30)), x) for i, x in enumerate(rng.choices(list(letters), k=60))]
    rows += [(200, rows[3][1], "bb"), (3, rows[3][1], rows[3][2]), (300, "ab " * 20_000, None), (301, "1 2 3", "aa"), (302, None, "bb")]
    got = QUERIES["op1_rank_order_langid"](spark, saved(documents=docs([(*r, None, None) for r in rows], "score"))).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    k = langid.PROFILE
    learned = {x: {g: i for i, g in enumerate(profile([t for d, t, y in rows if y == x and t and not held(d)], k))} for x in letters}
    want = []
    for d, t, _ in rows:
        mine = profile([t or ""], k)
        far = {x: sum(min(abs(p.get(g, 1 << 30) - i), k) for i, g in enumerate(mine)) for x, p in learned.items()}
        best = min(sorted(far), key=far.get)
        want.append((d, held(d), best if mine else "und", round(1 - far[best] / (k * len(mine)), 9) if mine else 0.0))
    assert sorted((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got) == sorted(want)


def test_langid_of_an_empty_table(spark, docs, saved):
    from trivex.llm.queries import QUERIES

    assert QUERIES["op1_rank_order_langid"](spark, saved(documents=docs([]))).count() == 0
    profiles = langid.learn(docs([(1, "ab", "x", None, None), (2, "ab", "w", None, None)]))
    out = langid.predict(docs([(3, "ab"), (3, "ab"), (4, None)]), profiles, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in out) == [(3, "w"), (3, "w"), (4, "und")]  # a tie goes to the first by code point


def embeddings(spark, rows):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in rows], "vec_id long, embedding array<float>")


def test_searches_of_few_repeated_and_no_rows(spark):
    rows = embeddings(spark, [(0, [1, 0]), (1, [0, 2]), (1, [0, 2]), (2, [1, 1]), (3, [1, 1, 1])])
    base = vectors.valid(rows, "vec_id", "embedding", True)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in norm_search.search(base, base.where("vec_id = 0"), 20).collect())
    assert got == [(0, 1, 2, 1), (0, 2, 1, 0)]
    near = sorted((r["rank"], r["vec_id"]) for r in lsh_search.search(base, base.where("vec_id = 0"), 10).collect())
    assert near == [(1, 2), (2, 1)]
    assert norm_search.search(base.limit(0), base.limit(0), 20).count() == 0
    assert norm_search.search(base, base.limit(0), 20).count() == 0


def test_blocks_of_norms_are_whole_and_bounded(spark):
    g = np.random.default_rng(4)
    rows = [(i, g.integers(0, 3, 2 + i % 2).tolist(), float(g.integers(0, 4))) for i in range(300)]
    df = spark.createDataFrame([(i, [float(y) for y in v], len(v), n, 0.5) for i, v, n in rows], "vec_id long, v array<double>, dim int, by double, floor double")
    got = []
    for r in norm_search.blocks_of(df, 16).collect():
        ids, by, data = (np.frombuffer(r[x], t) for x, t in (("ids", np.int64), ("bys", float), ("data", float)))
        assert len(ids) <= 16 and r["first"] == by[0] == by.max() and r["last"] == by[-1] == by.min()
        got += [(int(i), v.tolist(), float(n)) for i, v, n in zip(ids, data.reshape(len(ids), r["dim"]), by, strict=True)]
    assert sorted(got) == sorted((i, [float(y) for y in v], n) for i, v, n in rows)


def test_pairs_of_blocks_are_pruned_by_bounds(spark):
    heads = spark.createDataFrame([(b, 2, float(10 - b)) for b in range(10)] + [(99, 3, 50.0)], "block long, dim int, first double")
    needs = spark.createDataFrame([(0, 2, 8.0), (1, 2, 0.0), (2, 2, 11.0), (3, 3, 50.0)], "qblock long, dim int, last double")
    got = {(r["block"], r["qblock"]) for r in norm_search.pairs_to_meet(heads, needs).collect()}
    assert got == {(b, 0) for b in range(3)} | {(b, 1) for b in range(10)} | {(99, 3)}


def test_packing_of_repeats_and_long_texts(spark, docs):
    long = words(60_000)
    rows = [(1, long), (2, "same"), (2, "same"), (3, "same"), (4, ""), (5, None)]
    got = packing.pack(docs(rows, "offset"), BYTES).collect()
    tok = Tokenizer.from_file(BYTES)
    want = Counter()
    for d, t in rows:
        want[d] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    have, slots = Counter(), Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
        slots[r["sequence_id"]] += r["length"]
    assert have == want and sum(n != 1024 for n in slots.values()) <= 11


def test_tokens_of_a_whole_table_equal_the_library():
    from trivex.llm.tokens import TextTokenizer

    path = "/root/testdata/sf0.01/documents.parquet"
    texts = [t or "" for t in pq.read_table(path).column("text").to_pylist()]
    other = ["Привет, мир!", "你好 世界 hello", "مرحبا بالعالم", "Ελληνικά κείμενο 123", "mixed ñandú Привет <|endoftext|>", "emoji 🙂🙂 x", "ﬁ ligature ½", "á combining", "​zero width"]
    texts += other + [" ".join(rng.choices([*other, *texts[:20]], k=5)) for _ in range(60)]
    for file, kind in ((BYTES, "bytes"), (SPACED, "spaced")):
        want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(file).encode_batch(texts, add_special_tokens=False)]
        got = TextTokenizer(file, kind).encode(texts)
        assert [i for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b] == []


def test_very_long_texts(spark, docs):
    long = words(150_000)
    rows = [(1, long, "en", "s"), (2, f"{words(40)} {long[5_000:9_000]} {words(40)}", "en", "s"), (3, words(30), "en", "s"), (4, long, "en", "s")]
    table = docs([(*r, None) for r in rows])
    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(table).collect()}
    assert cut[1]["n_removed"] == 0 and cut[4]["n_removed"] == len(long) and abs(cut[2]["n_removed"] - 4_000) < 4
    same = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table).collect()}
    assert same[4] == 1 and same[3] == 3
    assert {r["doc_id"] for r in simhash.one_of_each(table).collect()} == {1, 2, 3}
    size = {r["doc_id"]: r["size"] for r in mixing.mixed(table).collect()}
    assert size[1] == size[4] == 150_000 and size[3] == 30
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    scored = {r["doc_id"]: r["n"] for r in quality.scores(table.select("doc_id", "lang", "text"), labels).collect()}
    assert scored == {d: len(t) for d, t, *_ in rows}


def test_names_that_operators_use_inside(spark, docs):
    rows = [(i, f"{words(5)}\n{words(5)}", "en", "ab"[i % 2], 1, "x") for i in range(12)] + [(20, None, None, None, None, None)]
    table = docs(rows, "_doc_id")
    for name in ("_gone", "_th", "_copy", "_kept", "_source", "_text", "_doc", "_COPIES", "h", "fp", "key", "size"):
        table = table.withColumn(name, F.col("_doc_id"))
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert line_dedup.line_dedup(table).drop("n_lines", "n_removed").columns == table.columns
    for out in (mixing.mix(table), simhash.one_of_each(table), quality.judge(table, labels, keep_only=True)):
        assert out.columns == table.columns
        assert {r["_th"] for r in out.collect()} <= {"x", None}


def test_pipeline_of_an_empty_table_and_stage_by_stage(spark, docs, saved, tmp_path):
    import corpus_pipeline

    rows = [(i, "\n".join(words(15) for _ in range(3)), "en", f"s{i % 3}", 0) for i in range(60)] + [(100, None, None, None, None), (101, "", "en", "s1", 0)]
    table = docs([(*r[:4], len(r[1] or "")) for r in rows]).drop("h")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    for name, t in (("full", table), ("empty", table.limit(0))):
        d = str(tmp_path / name)
        t.coalesce(1).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, d).write.parquet(f"{d}/stage{k}")
            now = spark.read.parquet(f"{d}/stage{k}")
        pieces = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
        tokens = lambda c: Counter({d: n for d, n in [(d, sum(x[2] * m for x, m in c.items() if x[0] == d)) for d in {x[0] for x in c}]})
        assert tokens(pieces(corpus_pipeline.run(spark, d))) == tokens(pieces(now))
        assert (now.count() == 0) == (name == "empty")


def test_a_hash_sample_of_columns_is_not_read(spark, docs):
    """Operators that read documents don't read other columns than those they name."""
    table = docs([(1, "a b c", "en", "s", 1)])
    plan = mixing.mixed(table).select(F.sum("size"))._jdf.queryExecution().optimizedPlan().toString()
    assert "n_chars" not in plan


def test_scores_hold_few_tables(docs, spark, monkeypatch):
    live, write, drop = [], quality.written, quality.discard
    seen = {}

    def wrote(df, name):
        seen[name] = list(live)
        live.append(name)
        return write(df, name)

    def gone(df):
        live.remove(next(n for n in live if f"/{n}-" in df._trivex_path))
        drop(df)

    monkeypatch.setattr(quality, "written", wrote)
    monkeypatch.setattr(quality, "discard", gone)
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    rows = [(i, f"some words of document {i}", "en") for i in range(30)]
    assert quality.scores(docs(rows), labels).count() == 30
    assert seen["scores"] == ["chunks", "models", "answers"]


def test_driver_gives_memory_back_when_a_table_is_written(spark, monkeypatch):
    common.written(spark.range(1), "few")  # what a first write takes and keeps
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    some = [jvm.java.util.zip.Deflater() for _ in range(1200)]  # native memory in small blocks
    for x in some[:-1]:
        x.end()
    before = held()
    monkeypatch.setattr(common, "_eased", float("-inf"), raising=False)
    common.written(spark.range(1), "few")
    some[-1].end()
    after = held()
    assert after < before - 40
