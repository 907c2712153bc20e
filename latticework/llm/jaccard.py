"""Near-duplicates by Jaccard similarity of five-word shingles, met by SimHash balls, for the pipeline's near-dedup stage.

Two sets of similarity 0.8 differ in about 15 of 100 SimHash bits, so op3's 64 bits and radius 3 are too narrow.  Here a set's fingerprint
has WORDS * 64 bits, and a table leaves all blocks of them out but one of KEPT bits; two sets within 2 bits of each other there meet in
the middle, by the variants that each emits within 1 bit (half the radius), which are the shuffle key.  By the formula a pair of similarity
0.8 meets in one of 19 tables with probability over 0.9999.  Small sets differ in up to 19 of 100 bits (four shingles of five) and take
part in tables of their own, 25 with a wider reach: 0.999.  Fingerprints that meet are compared in their first two words, which leaves
chance meetings out; whoever is within reach is one group, and in a group all shingle sets are compared whole, so no pair is taken by chance.
What the first tables have joined isn't joined again by the others, and what a bucket or a group gives is a forest over its links: at
most a link for each text, however large a group of copies is.  Groups beyond PART texts are compared part by part, in tasks of two
parts each, so a text moves once for each part of its group; that is the square of a group's size over PART, and nothing is left out.

Edge cases: a text of fewer than five words is one shingle; null and blank texts have none and are one group;
texts with equal shingle sets are one node before they meet; very long texts are read whole; an empty table gives none;
all other columns stay as they are, whatever their names; of equal rows one stays, and a null doc_id is the largest.
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

SHINGLE, SEED = 5, 42
#: Similarity as a fraction, so that no comparison rounds.
UP, DOWN = 4, 5
#: 64-bit words of a fingerprint; bits that a table keeps, of which HIGH deal its variants out and the others are told apart in the bucket.
WORDS, KEPT, HIGH = 8, 20, 5
LOW = KEPT - HIGH
#: Tables of all sets, of which FIRST meet before the others, with the differing bits of two words that still count as near;
#: the same for sets of at most SMALL shingles.
TABLES, FIRST, REACH = 19, 2, 34
SMALL, SMALL_TABLES, SMALL_REACH = 15, 25, 42
#: Entries under one key that are paired by offsets; more are reached one from another.
RUN = 64
#: Texts, and shingles, of a part of a group.
PART, PART_SHINGLES = 1000, 1_000_000
_FACTOR = np.random.default_rng(SEED).integers(0, 1 << 63, (2, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MARK, _MASK = np.uint16(1 << LOW), np.uint16((1 << LOW) - 1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text_or_empty(text).encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    n = max(1, len(words) - SHINGLE + 1)
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n)
    return np.unique(h.view(np.int64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS unsigned words: a bit is set if it is in over half of the hashes, each drawn out to that many words."""
    total = np.zeros(WORDS * 64, np.int64)
    for i in range(0, hashes.size, 255):  # counts of a byte
        z = hashes[i : i + 255, None].view(np.uint64) * _FACTOR[0]
        z ^= z >> np.uint64(32)
        z *= _FACTOR[1]
        z ^= z >> np.uint64(29)
        total += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > hashes.size, bitorder="little").view(np.uint64)


def _fingerprinted(rows: DataFrame) -> DataFrame:
    """rows' last column, a text, becomes node (one for each shingle set), n and fp; the others, of bigint, stay.  A map."""
    names = [*rows.columns[:-1], "node", "n", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(len(names) - 3).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            fps = pa.array([fingerprint(h).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(nodes), pa.array([h.size for h in sets], pa.int64()), fps], names)

    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in names[:-1]) + ", fp binary")


def kept_bits(fps: np.ndarray, block: int) -> np.ndarray:
    """The bits of a block of each fingerprint (a row of WORDS words)."""
    word, bit = divmod(block * KEPT, 64)
    bits = fps[:, word] >> np.uint64(bit)
    if bit + KEPT > 64:
        bits = bits | fps[:, word + 1] << np.uint64(64 - bit)
    return bits & np.uint64((1 << KEPT) - 1)


def _variants(nodes: DataFrame, tables: list[tuple[int, int, bool]]) -> DataFrame:
    """nodes(root, n, fp) -> (bucket, low, near, roots): every variant within one bit, for tables (number, block, small sets only).

    A bucket is a table and a variant's HIGH bits.  The LOW bits of its entries lie packed beside the first words and roots; an
    unmarked entry stands for itself and all variants of its low bits, which the bucket makes for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WORDS)
            for number, block, small in tables:
                who = np.flatnonzero((n <= SMALL) & (n > 0) if small else n > 0)
                bits = kept_bits(fps[who], block)
                high, low = (bits >> np.uint64(LOW)).astype(np.int64), bits.astype(np.uint16) & _MASK
                highs = np.concatenate([high, *(high ^ (1 << b) for b in range(HIGH))])
                lows = np.concatenate([low, *[low | _MARK] * HIGH])
                order = np.argsort(highs, kind="stable")
                highs, lows, at = highs[order], lows[order], np.tile(who, HIGH + 1)[order]
                begins = np.flatnonzero(np.r_[True, highs[1:] != highs[:-1]]) if highs.size else np.empty(0, np.int64)
                ends = np.r_[begins[1:], highs.size]
                packed = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary())
                buckets = pa.array((number << HIGH | highs[begins]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([buckets, packed(lows), packed(fps[at, :2]), packed(root[at])], ["bucket", "low", "near", "roots"])

    return nodes.select("root", "n", "fp").mapInArrow(run, "bucket int, low binary, near binary, roots binary")


def _reached(near: np.ndarray, who: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that join who as all its pairs within reach would; no more than needed."""
    left = who
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            x = todo.pop()
            hit = np.bitwise_count(near[left] ^ near[x]).sum(axis=1) <= reach
            if hit.any():
                yield np.full(int(hit.sum()), x), left[hit]
                todo += list(left[hit])
                left = left[~hit]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of bigint that join what all the given ones do: each to the smallest of its component."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return np.array([top(x) for x in up], np.int64), np.array(list(up), np.int64)


def met(low: np.ndarray, near: np.ndarray, roots: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's entries, links between different roots that share a variant and are within reach; a forest."""
    own = np.flatnonzero(low < _MARK)
    keys = np.concatenate([low & _MASK, *(low[own] ^ np.uint16(1 << b) for b in range(LOW))])
    who = np.concatenate([np.arange(low.size), *[own] * LOW])
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[begins, keys.size])
    few = np.repeat(sizes <= RUN, sizes)
    found = []
    for step in range(1, RUN):
        i = np.flatnonzero((keys[step:] == keys[:-step]) & few[step:])
        if not i.size:
            break
        x, y = who[i], who[i + step]
        hit = (np.bitwise_count(near[x] ^ near[y]).sum(axis=1) <= reach) & (roots[x] != roots[y])
        found.append((x[hit], y[hit]))
    for i, n in zip(begins[sizes > RUN], sizes[sizes > RUN]):
        found += _reached(near, who[i : i + n], reach)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(*(roots[np.concatenate(side)] for side in zip(*found)))


def _links(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64()) for x in (a, b)], ["a", "b"])


def _groups(rows: Iterator[tuple], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rest of the rows of each key (the first values) of ordered rows."""
    key, held = None, []
    for row in rows:
        if row[:keys] != key:
            if held:
                yield key, held
            key, held = row[:keys], []
        held.append(row[keys:])
    if held:
        yield key, held


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _variants() ordered by bucket -> links (a, b); holds the rows of one bucket besides a batch."""
    entries = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for (bucket,), rows in _groups(entries, 1):
        low, near, roots = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*rows), (np.uint16, np.uint64, np.int64)))
        a, b = met(low, near.reshape(-1, 2), roots, REACH if bucket >> HIGH < TABLES else SMALL_REACH)
        if a.size:
            yield _links([a], [b])


def within_reach(nodes: DataFrame) -> DataFrame:
    """nodes(node, k1, k2, n, fp) with root, one for all that meetings within reach join."""
    some = nodes.where("n > 0").withColumn("root", F.col("node"))
    everyone = [(t, t, False) for t in range(TABLES)]
    few = [(TABLES + t, t, True) for t in range(SMALL_TABLES)]
    for tables in (everyone[:FIRST], everyone[FIRST:] + few):
        spread = some.repartition(max(1, nodes.sparkSession.sparkContext.defaultParallelism), "node")
        dealt = _variants(spread, tables).repartition("bucket").sortWithinPartitions("bucket")
        links, _ = written(dealt.mapInArrow(_meetings, "a bigint, b bigint").distinct(), "links")
        roots, _ = components(links)
        roots = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        some, _ = written(some.join(roots, "root", "left").withColumn("root", F.coalesce("up", "root")).drop("up"), "near")
    return some


def joined(sets: list[np.ndarray], part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places in sets of pairs that are similar, enough to join what all such pairs do; between different parts if there are two."""
    count, size = len(sets), np.array([s.size for s in sets])
    ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    cut = np.r_[0, np.cumsum(size)]
    who = np.repeat(np.arange(count), size)[np.argsort(ids, kind="stable")]
    begin = np.r_[0, np.cumsum(times)]
    left, two = np.ones(count, bool), part.min() != part.max()
    for first in range(count):
        todo = [first] if left[first] else []
        left[first] = False
        while todo:
            x = todo.pop()
            own = ids[cut[x] : cut[x + 1]]
            own = own[times[own] > 1]
            if not own.size:
                continue
            both = np.bincount(np.concatenate([who[begin[i] : begin[i + 1]] for i in own]), minlength=count)
            hit = left & (DOWN * both >= UP * (size[x] + size - both))
            if two:
                hit &= part != part[x]
            if hit.any():
                at = np.flatnonzero(hit)
                yield x, at
                todo += at.tolist()
                left[at] = False


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, i, j, node, part, text) ordered by the first three -> links (a, b) of nodes whose texts are similar."""

    # shingles instead of texts, so that a text isn't held longer than needed
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns[:5]), map(shingles, batch.column(5).to_pylist())))
    for _, cell in _groups(rows, 3):
        nodes, part, sets = np.array([r[0] for r in cell], np.int64), np.array([r[1] for r in cell]), [r[2] for r in cell]
        found = list(joined(sets, part))
        if found:
            yield _links([np.repeat(nodes[x], at.size) for x, at in found], [nodes[at] for _, at in found])


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """nodes(node, k1, k2, n, fp), texts(k1, k2, text), a row for each set -> links (a, b) of similar sets, enough to keep every component whole."""
    grouped = within_reach(nodes).select("node", "k1", "k2", "n", "root")
    parts = F.least(F.count("*"), F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / PART_SHINGLES)))
    sizes, _ = written(grouped.groupBy("root").agg(F.count("*").alias("texts"), parts.cast("bigint").alias("parts")).where("texts > 1"), "groups")
    some = grouped.join(sizes, "root").select("k1", "k2", "root", "node", "parts", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    some, _ = written(some, "places")
    # only texts of groups move
    told, _ = written(texts.join(some.hint("merge"), ["k1", "k2"]).dropDuplicates(["node"]).select("root", "node", "parts", "part", "text"), "texts")
    cell = told.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    cell = cell.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "part", "text")
    cell = cell.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    found, _ = written(cell.mapInArrow(_compared, "a bigint, b bigint"), "links")
    return found


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(node, ...) with root."""
    roots, _ = components(links)
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns of docs: the one with the smallest doc_id.

    Rows are told apart by doc_id and text; of rows that repeat both, one stays.
    """
    arrow_limits(docs.sparkSession)
    doc_id, text = F.col("row.doc_id").cast("bigint"), F.col("row.text").cast("string")
    rows = docs.select(F.struct("*").alias("row")).select("row", F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(7), doc_id).alias("k2"))
    plain = rows.select(doc_id.alias("doc_id"), "k1", "k2", text.alias("text"))
    told, _ = written(_fingerprinted(plain), "shingles")
    one = told.groupBy("node").agg(F.min_by(F.struct("k1", "k2", "n", "fp"), F.struct("k1", "k2")).alias("one"))
    nodes, _ = written(one.select("node", "one.*"), "nodes")
    rooted = _roots(told.select("doc_id", "k1", "k2", "node"), links(nodes, plain.select("k1", "k2", "text")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    first, _ = written(rooted.groupBy("root").agg(F.min(order).alias("first")).select("first.k1", "first.k2"), "kept")
    # these tables grow with the input, so the joins are merges at every size
    each = told.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    gone, _ = written(each.join(first, ["k1", "k2"], "left_anti").select("k1", "k2"), "gone")
    twice, _ = written(each.where("copies > 1").join(first, ["k1", "k2"], "left_semi").select("k1", "k2"), "twice")
    kept = rows.join(gone.unionByName(twice).hint("merge"), ["k1", "k2"], "left_anti")
    return kept.unionByName(rows.join(twice.hint("merge"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])).select("row.*")
