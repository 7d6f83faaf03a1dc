"""Line dedup by winnowing over line hashes (operator 8); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checked, discard, fresh, written

#: A repeated run of at least this many lines is always found and deleted.
MIN_LINES = 2
#: A single line of over so many words is a run of its own.
LONG_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"


def _solid(docs: DataFrame, long_words: int | None) -> DataFrame:
    """doc_id, th (text hash), lines: (i, h, g, long) of each line that is not blank; h and g are two hashes of it, long says whether it has over long_words words."""

    def long(x):
        if long_words is None:
            return F.lit(False)
        return F.when(F.length(x) > 2 * long_words, F.regexp_count(x, F.lit(_WORD)) > long_words).otherwise(False)

    def line(x, i):
        solid = F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != ""
        return F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(2), x).alias("g"), long(x).alias("long"), solid.alias("solid"))

    lines = F.transform(F.split("text", "\n", -1), line)
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.filter(lines, lambda x: x["solid"]).alias("lines"))


def fingerprints(docs: DataFrame, t: int, long_words: int | None) -> DataFrame:
    """(doc_id, th, fp, windows): the lines that winnowing selects, those of least hash (the first of equals) of each window of t lines, and single long lines; with the windows (j, w1, w2, at) that each was selected from: place, two hashes of all lines, line numbers.

    Two runs of t or more equal lines have equal windows, so the same fingerprints at the same places of them.
    """
    seq = _solid(docs, long_words).where(F.size("lines") >= (t if long_words is None else 1))
    lines = F.col("lines")
    seq = seq.withColumn("hs", F.transform(lines, lambda x: x["h"])).withColumn("last", F.size("lines") - (t - 1))
    least = lambda j: (F.array_position(F.slice("hs", j, F.lit(t)), F.array_min(F.slice("hs", j, F.lit(t)))) + j - 1).cast("int")
    places = F.when(F.col("last") >= 1, F.transform(F.sequence(F.lit(1), F.greatest("last", F.lit(1))), least)).otherwise(F.array().cast("array<int>"))
    seq = seq.withColumn("places", places)

    def window(j, n: int):
        part = F.slice("lines", j, F.lit(n))
        w1 = F.xxhash64(F.lit(n), F.transform(part, lambda x: x["h"]))
        w2 = F.xxhash64(F.lit(n), F.transform(part, lambda x: x["g"]))
        return F.struct(j.alias("j"), w1.alias("w1"), w2.alias("w2"), F.transform(part, lambda x: x["i"]).alias("at"))

    def selected(p):
        around = F.sequence(F.greatest(p - (t - 1), F.lit(1)), F.least(p, F.col("last")))
        own = F.filter(around, lambda j: F.element_at("places", j) == p)
        return F.struct(F.element_at("hs", p).alias("fp"), F.transform(own, lambda j: window(j, t)).alias("windows"))

    found = F.transform(F.array_distinct("places"), selected)
    if long_words is not None and t > 1:
        alone = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("j"), x["long"].alias("long"))), lambda x: x["long"])
        found = F.concat(found, F.transform(alone, lambda x: F.struct(F.element_at("hs", x["j"]).alias("fp"), F.array(window(x["j"], 1)).alias("windows"))))
    return seq.select("doc_id", "th", F.explode(found).alias("f")).select("doc_id", "th", "f.fp", "f.windows")


def removals(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> tuple[DataFrame, int]:
    """(doc_id, th, gone array<int> of ascending line numbers) of the documents that lose lines, and a bound on the bytes of a row each.

    Occurrences of one fingerprint are joined by position: each is extended both ways, over the windows of min_lines lines that it was selected from, and meets the earliest occurrence with the same lines there. The windows of adjacent fingerprints overlap, so a longer match comes out as one run, whole, whichever earlier documents its parts are from. Windows are equal if two independent 64-bit hashes of all their lines are. Groups are pre-aggregated to their earliest occurrence, so a line or run in a third of all documents is a row per task, and no pairs are made.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    marks = written(fingerprints(docs, min_lines, long_words), "marks")
    often = written(marks.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "often")
    met = marks.join(checked(often, often.count(), 16), "fp").select("doc_id", "th", F.explode("windows").alias("w"))
    met = met.select("doc_id", "th", "w.j", "w.w1", "w.w2", "w.at")
    order = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "th", "j")
    first = met.groupBy("w1", "w2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "first")
    first = written(first, "first")
    late = met.join(checked(first, first.count(), 56), ["w1", "w2"]).where(order > F.col("first")).select("doc_id", "th", "at")
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_set("at"))))
    gone = written(late.groupBy("doc_id", "th").agg(gone.alias("gone")), "gone")
    for x in (marks, often, first):
        discard(x)
    rows, lines = gone.agg(F.count("*"), F.sum(F.size("gone"))).first()
    return gone, rows * 40 + (lines or 0) * 4


def _without(lines, gone):
    """The array lines without those at the ascending numbers gone (from 0): what stands between each number and the one before, and the rest."""
    before = lambda k: F.when(k > 0, F.element_at(gone, k)).otherwise(-1)
    pieces = F.transform(gone, lambda x, k: F.slice(lines, before(k) + 2, x - before(k) - 1))
    last = F.element_at(gone, -1)
    return F.concat(F.flatten(pieces), F.slice(lines, last + 2, F.greatest(F.size(lines) - last - 1, F.lit(0))))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """docs with later repeated runs of lines deleted from text; all columns and rows stay, and n_lines and n_removed are added under those names unless docs has them.

    A run of min_lines or more consecutive lines that are not blank, or a single line of over long_words words (None: no single lines), which also starts earlier (smaller doc_id, null ids first; then earlier in the text), is deleted. Blank lines neither count nor go. A null text stays null; a text of fewer lines, none of them long, stays whole; rows that repeat a doc_id and text are one document and don't delete each other's lines; a text of any length is read whole, in one row; an empty table gives an empty one.
    """
    gone, size = removals(docs, min_lines, long_words)
    names = docs.columns
    doc, th, cut = fresh(docs, "doc", "th", "gone")
    right = checked(gone.select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("gone").alias(cut)), size, 1)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(th))
    out = docs.join(right, same, "left")
    split = F.split(F.col("text").cast("string"), "\n", -1)
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(_without(split, F.col(cut)), "\n"))
    more = {"n_lines": F.coalesce(F.size(split), F.lit(0)), "n_removed": F.coalesce(F.size(cut), F.lit(0))}
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in names], *[F.greatest(v, F.lit(0)).cast("int").alias(k) for k, v in more.items() if k not in names])


def op8(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, runs of two lines or more, as in SQL8 (single long lines only go in the pipeline); the remaining text as its digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs, MIN_LINES, None)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL8 = f"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> ''),
w AS (SELECT a.doc_id, a.j, a.i AS i1, b.i AS i2, row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.j) AS rn FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.j = a.j + {MIN_LINES - 1}),
g AS (SELECT DISTINCT doc_id, unnest([i1, i2]) AS i FROM w WHERE rn > 1),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS n, count(*) AS m FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(k.m, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n, 0) AS INTEGER) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
