"""Suffix dedup, SimHash and line dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trivex.llm import components, line_dedup, simhash, suffix_dedup

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 7))).strip() or "x" for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    base = [prose(rng.randint(5, 120)) for _ in range(12)]
    passage = prose(40)
    out = list(base)
    out += [base[0], base[1], base[1] + " tail", "head " + base[2]]
    out += [prose(20) + passage + prose(15) for _ in range(6)]
    out += ["a" * 500, "ab" * 200, "a" * 150, "", None, "x", passage[:99], passage[:100], passage[3:120]]
    edited = base[3].split()
    if edited:
        edited[len(edited) // 2] = "EDIT"
    return [*out, " ".join(edited)]


def brute_repeats(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        out[d] = (b, gone)
    return out


@pytest.mark.parametrize("hot", [{}, {"hot_at": 2}, {"hot_at": 1, "most": 3}])
def test_suffix_dedup_is_exact(docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_HOT", hot.pop("most", suffix_dedup.MOST_HOT))
    rows = list(enumerate(corpus()))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(rows, "kept"), **hot).collect()}
    for d, (b, gone) in brute_repeats(rows, 100).items():
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], bytes(got[d]["kept"])) == (len(b), int(gone.sum()), spans, kept), d


def test_suffix_dedup_edges(docs):
    assert suffix_dedup.remove_repeats(docs([])).count() == 0
    long = prose(60)
    got = suffix_dedup.remove_repeats(docs([(None, long), (1, long), (2, None), (1, long)])).collect()
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]
    assert {r["n_bytes"] for r in got if r["doc_id"] == 2} == {0}
    assert len(got) == 4


def test_run_index_matching_statistics():
    texts = [prose(20).encode() for _ in range(5)]
    texts += [texts[0], texts[1][10:] + b"z"]
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    text = np.frombuffer(b"".join(texts), np.uint8)
    index = suffix_dedup.RunIndex(text, start, size)
    before, match = index.matching_statistics()
    assert index.runs < index.n
    suffix = lambda i: b"".join(texts)[i : start[np.searchsorted(start, i, "right") - 1] + size[np.searchsorted(start, i, "right") - 1]]
    for i in range(index.n):
        if match[i] > 0:
            a, b = suffix(i), suffix(int(before[i]))
            assert a[: match[i]] == b[: match[i]]
            assert len(a) == match[i] or len(b) == match[i] or a[match[i]] != b[match[i]]


def fingerprint_by_definition(text, width):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_diff):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= max_diff:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {d: find(d) for d in ids}


def test_simhash_against_brute_force(docs):
    rows = list(enumerate([*corpus(), "One TWO\tthree", "one two\x0bthree", "É É", "é é", "a b", "A B "]))
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs(rows, "fp")).collect()}
    fps = {d: fingerprint_by_definition(t, 3) for d, t in rows}
    comp = brute_components(fps, 2)
    assert {d: (f & (1 << 64) - 1, c) for d, (f, c) in got.items()} == {d: (fps[d], comp[d]) for d in fps}


@pytest.mark.parametrize("pairs_up_to", [64, 2])
def test_links_lose_none(spark, monkeypatch, pairs_up_to):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base) | {0, (1 << 64) - 1}
    for b in base[:6]:
        for _ in range(12):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 3))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2)
    comp = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = brute_components(dict(enumerate(fps)), 2)
    group = lambda of: sorted(sorted(x for x in range(len(fps)) if of(x) == r) for r in {of(x) for x in range(len(fps))})
    assert group(lambda i: comp.get(signed[i], signed[i])) == group(lambda i: want[i])


def test_variants_stay_out_of_the_driver(spark, monkeypatch):
    plans, write = {}, simhash.written

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(simhash, "written", spy)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        # read from files, as the planner's sizes come from those
        simhash.links(write(spark.range(500).select(F.xxhash64("id").alias("fp")), "fingerprints"), 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plans["variants"] and "Broadcast" not in plans["variants"]


def test_simhash_edges(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    got = simhash.near_duplicates(docs([(3, None), (1, " \t"), (None, "alone"), (5, "p q r"), (5, "p q r")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (1, 1), (3, 1), (5, 5), (5, 5)]
    kept = simhash.one_of_each(docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words here now and then")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "h"]


def test_similar_takes_pairs_by_simhash(docs, spark, monkeypatch):
    text = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*text[: 399 - i], f"x{i}", *text[400 - i :]])) for i in range(4)] + [(9, "quite another text of some words")]
    fps = {}
    for d, t in rows:
        hashes = [int(h) & (1 << 64) - 1 for h in simhash.shingles(t.encode(), 5)]
        fps[d] = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    signed = {d: f - (1 << 64) if f >> 63 else f for d, f in fps.items()}
    pairs = simhash.by_simhash(spark.createDataFrame([(d, 9, f) for d, f in signed.items()], "h long, n int, fp long"))
    comp = {r["node"]: r["root"] for r in components.components(pairs.select("a", "b")).collect()}
    want = brute_components(fps, 2)
    assert {d: comp.get(d, d) for d in fps} == want and len(set(want.values())) < len(rows)
    seen, own = [], simhash.by_simhash
    monkeypatch.setattr(simhash, "by_simhash", lambda nodes: seen.extend(r["fp"] for r in nodes.collect()) or own(nodes))
    assert {r["doc_id"] for r in simhash.one_of_each(docs(rows)).collect()} == {0, 9}
    assert set(seen) == set(signed.values())


def brute_similar(rows, width, least):
    sets = {d: set(simhash.shingles((t or "").encode(), width).tolist()) for d, t in rows}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and 10 * both >= round(10 * least) * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("knobs", [{}, {"PAIRS_UP_TO": 2, "SAMPLE": 1, "COMMON": 3}, {"PAIRS_UP_TO": 1, "COMMON": 10**6}, {"PAIRS_UP_TO": 1, "LEADS": 1, "ROUNDS": 1, "BLOCK": 3}])
def test_one_of_each_finds_all_similar(docs, monkeypatch, knobs):
    for k, x in knobs.items():
        monkeypatch.setattr(simhash, k, x)
    texts, passage = [], prose(30)
    for n in (6, 30, 60, 120):
        base = prose(n).split()
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            w = list(base)
            for i in rng.sample(range(len(w)), min(edits, len(w))):
                w[i] = f"edit{rng.random()}"
            texts.append(" ".join(w))
    texts += [prose(20) + " " + passage for _ in range(6)] + [passage, passage + " " + prose(3), "", None, " "]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_similar(rows, 5, 0.8)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(docs(rows)).collect()} == want
    assert {r["doc_id"] for r in simhash.one_of_each(docs(rows)).collect()} == {d for d, c in want.items() if d == c}
    twice = {c for c in want.values() if sum(x == c for x in want.values()) > 1}
    bits = lambda a, b: bin(fingerprint_by_definition(texts[a], 5) ^ fingerprint_by_definition(texts[b], 5)).count("1")
    assert any(bits(d, c) > 2 for d, c in want.items() if c in twice)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components.components(edges.limit(0)).count() == 0


def brute_lines(rows, t):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[d] = None
            continue
        lines = text.split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for j in range(len(solid) - t + 1):
            w = tuple(lines[i] for i in solid[j : j + t])
            if w in seen:
                gone |= set(solid[j : j + t])
            seen.add(w)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("t", [1, 2, 3])
def test_line_dedup_against_brute_force(docs, t):
    pool = [prose(4) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, prose(5), "", "  "]) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (104, rows[0][1] + "\n" + rows[0][1])]
    out = line_dedup.line_dedup(docs(rows, "gone"), t)
    assert out.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "gone"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(rows, t)


def test_line_dedup_edges(docs):
    assert line_dedup.line_dedup(docs([])).count() == 0
    got = line_dedup.line_dedup(docs([(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, "c")])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "a\nb"), (1, ""), (1, ""), (2, "c")]
    plan = line_dedup.line_dedup(docs([(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_lines_go_alone(docs):
    passage, short = "w" + " é word" * 25, " ".join(["word"] * 50)
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, passage), (4, passage), (5, short), (6, short), (7, f"{passage} more"), (8, f"e\n\n{passage}\n{passage}\nf")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.line_dedup(docs(rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("c\nd", 1), 3: ("", 1), 4: ("", 1), 5: (short, 0), 6: (short, 0), 7: (rows[6][1], 0), 8: ("e\n\nf", 2)}
    assert line_dedup.line_dedup(docs(rows), 2, None).where("n_removed > 0").count() == 0


def test_winnowing_selects_the_minimum_of_every_window(docs):
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "d", ""]) for _ in range(rng.randint(1, 12)))) for i in range(30)]
    for t in (1, 2, 4):
        got = {}
        for r in line_dedup.fingerprints(docs(rows).select("doc_id", "text"), t, None).collect():
            for w in r["windows"]:
                assert got.setdefault((r["doc_id"], w["j"]), (r["fp"], w["w1"], w["w2"], w["at"])) and len(w["at"]) == t
        want = {}
        for d, text in rows:
            solid = [(i, x) for i, x in enumerate(text.split("\n")) if x]
            for j in range(len(solid) - t + 1):
                want[d, j + 1] = (tuple(x for _, x in solid[j : j + t]), [i for i, _ in solid[j : j + t]])
        assert set(got) == set(want)
        by = {}
        for k, (words, at) in want.items():
            assert got[k][3] == at
            assert by.setdefault(words, got[k][:3]) == got[k][:3]  # equal windows have equal fingerprints
        assert len(set(by.values())) == len(by)


def test_line_dedup_of_a_very_long_text_and_clashing_names(docs):
    lines = [f"line {i % 30_000} of many" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["x", *lines[:5], "", "y"]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs(rows, "_gone")).collect()}
    assert got == {1: "\n".join(lines[:30_000]), 2: "x\n\ny"}


def test_digests(spark, docs, saved):
    from trivex.llm.queries import QUERIES

    d = saved(documents=docs([(1, "héllo"), (2, None)]))
    rows = {r["doc_id"]: r for r in QUERIES["op2_run_length_suffix_dedup"](spark, d).collect()}
    assert rows[1]["kept_sha256"] == hashlib.sha256("héllo".encode()).hexdigest()
    assert rows[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
