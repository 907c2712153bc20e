"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A radius of 3 is met from both sides: with one of three bit blocks left out, at least one differing bit falls
away for some choice of the block, so two fingerprints within 3 bits are within 2 on the other bits, and the
variants that each emits within 1 bit there (half the radius) meet.  Variants are the shuffle key; fingerprints
that meet are compared whole, so chance meetings make no link.  Equal fingerprints are one before that, and a
set of r fingerprints that meet gives at most r - 1 links (a forest over its true links), never all pairs.

Edge cases: a null or blank text has fingerprint zero, linked like any other; a null doc_id takes part and is
never the smallest while another id is there; repeated rows share a fingerprint and so a component; a bit that exactly half of
the hashes set is 0; very long texts are hashed whole, some shingles at a time; an empty table gives no rows; columns other than
the two named are ignored, and kept by without_duplicates(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_limits, text_or_empty, written
from .components import components

RADIUS, SEED = 3, 42
#: First bits of the blocks of which one at a time is left out.
BLOCKS = ((0, 21), (21, 43), (43, 64))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64 bits: a bit is set if it is in over half of the shingles' hashes."""
    words = text_or_empty(text).encode().translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        bits += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, shingle: int = 3) -> DataFrame:
    """rows' last column, a text, becomes fp (a signed bigint); the others, of bigint, stay.  A map."""
    arrow_limits(rows.sparkSession)
    names = [*rows.columns[:-1], "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(len(names) - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names)

    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): every variant within one bit outside each block, tagged with the block."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    made = []
    for tag, (begin, stop) in enumerate(BLOCKS):
        left_out = ((1 << stop) - 1) ^ ((1 << begin) - 1)
        keep = ((1 << 64) - 1) ^ left_out
        mark = tag << begin  # the left-out bits are free to tell the blocks apart
        made += [(signed(keep), signed(mark | flip)) for flip in (0, *(1 << b for b in range(64) if keep >> b & 1))]
    told = F.array(*[F.struct(F.lit(k).alias("keep"), F.lit(c).alias("flip")) for k, c in made])
    return fps.select("fp", F.explode(told).alias("v")).select(F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("key"), "fp")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the given distinct fingerprints as all their links would; no more than needed."""
    left, links = fps, []
    while left.size > 1:
        reach, left = [left[0]], left[1:]
        while reach and left.size:
            x = reach.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hit = left[near]
                links += [(int(x), int(y)) for y in hit]
                reach += list(hit)
                left = left[~near]
    return links


def meetings(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) ordered by key -> links (a, b); holds the rows of one key at most besides a batch."""
    rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def runs(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.empty(0, np.int64)
        sizes = np.diff(np.r_[begins, key.size])
        two = begins[sizes == 2]
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= radius
        a, b = [x[near]], [y[near]]
        for s, n in zip(begins[sizes > 2], sizes[sizes > 2]):
            if links := forest(np.unique(fp[s : s + n]).view(np.uint64), radius):
                pair = np.array(links, np.uint64).view(np.int64)
                a.append(pair[:, 0])
                b.append(pair[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([low, high], axis=1)[low < high], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.r_[rest_key, batch.column(0).to_numpy(zero_copy_only=False)]
        fp = np.r_[rest_fp, batch.column(1).to_numpy(zero_copy_only=False)]
        cut = int(np.searchsorted(key, key[-1], "left"))
        rest_key, rest_fp = key[cut:], fp[cut:]
        if cut:
            yield runs(key[:cut], fp[:cut])
    yield runs(rest_key, rest_fp)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints within RADIUS bits, enough of them to keep every component whole."""
    met = variants(fps).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(meetings, "a bigint, b bigint").distinct()


def with_components(fps: DataFrame) -> DataFrame:
    """fps(doc_id, fp, ...) with component_id, the smallest doc_id that links reach."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots, _ = components(links(least.select("fp")))
    root = F.coalesce("root", "fp").alias("root")
    of_fp = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", root, "least")
    of_root = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = of_fp.join(of_root, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    fps, _ = written(fingerprints(rows, shingle), "fingerprints")
    return with_components(fps).select("doc_id", "fp", "component_id")


def without_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of each component, with all columns of docs: the one with the smallest doc_id.

    Rows are told apart by doc_id and text; of rows that repeat both, one stays.
    """
    doc_id, text = F.col("row.doc_id").cast("bigint"), F.col("row.text").cast("string")
    rows = docs.select(F.struct("*").alias("row")).select("row", F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(7), doc_id).alias("k2"))
    fps, _ = written(fingerprints(rows.select(doc_id.alias("doc_id"), "k1", "k2", text.alias("text")), shingle), "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    first = with_components(fps).groupBy("component_id").agg(F.min(order).alias("first")).select("first.k1", "first.k2")
    return rows.join(first, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")


def hexadecimal(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
