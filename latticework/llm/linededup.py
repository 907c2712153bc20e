r"""Line dedup by chunks of lines that an earlier document, or an earlier place, holds.

Each line is hashed, and a hash rolls over the hashes of two neighbouring lines; every such pair is a chunk, so an
insertion shifts none further on and a repeated passage is found whole wherever it stands and whatever its lines'
other occurrences.  A single line of at least LONG_LINE words is a chunk too.  The lines of chunks whose hash occurs more than
once are fetched and compared byte by byte: should two different lines share their 128 bits, chunks of theirs are left alone.
Of equal chunks the first (smallest doc_id, then earliest line) stays, the lines of the others go.  The first occurrence of a
line is in no later chunk, so every line stays somewhere.

Only DataFrame functions.  Edge cases: a null text stays null; lines that occur once are never touched; rows with
the same doc_id and text are one document and get the same text back; a null doc_id counts as smaller than any;
blank lines are neutral: neighbours are the lines that aren't blank, and blank ones between two that go go too; a
text all of whose lines go becomes the empty string; very long texts are taken whole, a line at a time; an empty table gives
no rows; other columns stay, whatever their names.  n_removed_chunks counts contiguous stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words that make a single line worth removing.
LONG_LINE = 50


def _keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text): two hashes that name a document and are never null."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("bigint")
    return docs.select(F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(7), doc_id).alias("k2"), doc_id.alias("doc_id"), text.alias("text"))


def _chunks(keyed: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, begin, n_lines, x, y, h1, h2): every pair of neighbouring lines, and every long line; x and y its lines' hashes."""
    blank = lambda x: F.translate(x, " \t\r\x0b\x0c", "") == ""
    told = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("at"), F.when(~blank(x), F.xxhash64(x)).alias("h"), F.when(~blank(x), F.xxhash64(F.lit(7), x)).alias("g"), F.size(F.split(F.trim(x), "[ \t\r]+")).alias("words")))
    lines = keyed.where(F.col("text").isNotNull()).select("k1", "k2", "doc_id", F.filter(told, lambda x: x["h"].isNotNull()).alias("lines"))
    span = lambda x, y, mark: F.struct(x["at"].alias("begin"), (y["at"] - x["at"] + 1).alias("n_lines"), x["h"].alias("x"), y["h"].alias("y"), F.xxhash64(F.lit(mark), x["h"], y["h"]).alias("h1"), F.xxhash64(F.lit(mark), x["g"], y["g"]).alias("h2"))
    but_last = F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0)))
    pairs = F.zip_with(but_last, F.slice("lines", F.lit(2), F.size("lines")), lambda x, y: span(x, y, 2))
    long_lines = F.transform(F.filter("lines", lambda x: x["words"] >= LONG_LINE), lambda x: span(x, x, 1))
    return lines.select("k1", "k2", "doc_id", F.explode(F.concat(pairs, long_lines)).alias("s")).select("k1", "k2", "doc_id", "s.*")


def _rows(docs: DataFrame) -> DataFrame:
    """docs with its columns renamed c0, c1, ... and the document's keys; both joins below deal out just this."""
    named = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    doc_id, text = doc_id.cast("bigint"), text.cast("string")
    return named.select("*", F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(7), doc_id).alias("k2"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, gone): for each document, array<struct(begin, n_lines)> of the chunks that an earlier one repeats."""
    chunks, _ = written(_chunks(_keyed(docs)), "chunks")
    # how often a hash occurs, and where first, is counted before it is told beside each chunk: no task gathers the copies
    place = F.struct("doc_id", "k1", "k2", "begin", "n_lines")
    many = chunks.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # a chunk that overlaps the first one, as in three equal lines, is part of it
    apart = (F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2")) | (F.col("begin") >= F.col("first.begin") + F.col("first.n_lines"))
    met, _ = written(chunks.join(many, ["h1", "h2"]).select("k1", "k2", "begin", "n_lines", "x", "y", apart.alias("apart")), "repeated")
    for side in ("x", "y"):
        other = _different(docs, met).select(F.col("h").alias(side))
        # lines whose 128 bits agree and whose bytes don't: fewer than one is expected among 2^64 lines
        met = met.join(F.broadcast(other), side, "left_anti")
    return met.where("apart").groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "n_lines")).alias("gone"))


def _different(docs: DataFrame, met: DataFrame) -> DataFrame:
    """(h): hashes of lines in repeated chunks that are equal but for their bytes."""
    wanted = met.groupBy("k1", "k2").agg(F.collect_set("begin").alias("begins"), F.collect_set(F.col("begin") + F.col("n_lines") - 1).alias("ends"))
    rows = _rows(docs)
    text = f"c{docs.columns.index('text')}"
    # reading every column here keeps this exchange equal to the one in deduplicated(), so Spark deals out the texts once
    rest = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in rows.columns if c.startswith("c") and c != text])) * 0
    bound = F.array(F.split(F.col(text).cast("string"), "\n", -1))  # one element, so that the text is split once
    lines = F.flatten(F.transform(bound, lambda split: F.transform(F.array_union("begins", "ends"), lambda i: F.get(split, i + F.col("rest").cast("int")))))
    each = rows.join(wanted, ["k1", "k2"]).withColumn("rest", F.coalesce(rest, F.lit(0))).select(F.explode(lines).alias("line"))
    each = each.groupBy(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), "line").agg(F.count("*").alias("copies"))
    return each.groupBy("h", "g").agg(F.count("*").alias("lines")).where("lines > 1").select("h")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(row struct of docs' columns, clean text, n_removed_lines, n_removed_chunks) of every row."""
    joined = _rows(docs).join(repeated_lines(docs), ["k1", "k2"], "left")
    text = F.col(f"c{docs.columns.index('text')}").cast("string")
    row = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    numbers = F.array_distinct(F.flatten(F.transform("gone", lambda s: F.sequence(s["begin"], s["begin"] + s["n_lines"] - 1))))
    joined = joined.select(row.alias("row"), text.alias("text"), numbers.alias("gone"))
    bound = F.array(F.split("text", "\n", -1))
    kept = F.transform(bound, lambda split: F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone")), lambda i: F.get(split, i)))
    stretches = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(kept), "\n"))
    count = lambda c: F.when(F.col("gone").isNull(), 0).otherwise(c).cast("bigint")
    return joined.select("row", clean.alias("clean"), count(F.size("gone")).alias("n_removed_lines"), count(stretches).alias("n_removed_chunks"))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with the repeated chunks taken out of text; a column n_chars follows the text."""
    done = deduplicated(docs)
    own = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    return done.select(*[own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])
