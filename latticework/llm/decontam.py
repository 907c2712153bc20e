"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question that was re-parameterised keeps its template.
Windows of the canonical words are hashed; documents and benchmark meet in a hash join on those hashes, windows
that line up are one alignment, and an alignment counts if its slots are consistent: one value of the benchmark
stands for one value of the document and back.  A document is contaminated by an item if aligned windows cover
at least half of the item's windows.

Edge cases: null or empty texts have no window; an item shorter than a window is one window of its own length;
windows that are mostly placeholders stand for their literal words, which only equal values match; rows that share doc_id and text share a result;
an empty benchmark contaminates nothing, an empty table gives no rows; very long texts are read whole; several items that fit a
document, and items that repeat, each give a row; other columns are ignored, and kept by without_contaminated(), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, text_or_empty

WINDOW, COVER = 6, 0.5
#: Up to so many template windows (8 bytes each), tasks also hold their hashes and drop other windows before the join.
SMALL = 1_000_000
#: Words that are units when a number stands before them.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec ms min h hr hours minutes seconds days weeks years km/h mph kb mb gb tb hz kw percent usd eur dollars euros".split())
TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[.!?\n]|\d")
END, NUMBER, NAME, UNIT = 1, 2, 4, 8
_CODE = {kind: np.uint64(xxhash.xxh64_intdigest(f"<{kind}>")) for kind in (NUMBER, NAME, UNIT)}
_LITERAL = np.uint64(xxhash.xxh64_intdigest("<literal>"))
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Reader:
    """Texts -> canonical word hashes; remembers the words it has met, up to a bound."""

    def __init__(self, most: int = 1 << 18):
        self.known: dict[str, int] = {}
        self.code, self.kind = np.zeros(most, np.uint64), np.zeros(most, np.uint8)

    def _add(self, token: str) -> int:
        i = len(self.known)
        self.known[token] = i
        self.code[i] = xxhash.xxh64_intdigest(token.lower())
        if token in ".!?\n":
            self.kind[i] = END
        elif token[0].isdigit():
            self.kind[i] = NUMBER
        else:
            self.kind[i] = NAME * (token[0].isupper() and token[1:].islower()) | UNIT * (token.lower() in UNITS)
        return i

    def canonical(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Hashes of the canonical words, whether each is a slot, all tokens, and each word's place among them."""
        tokens = TOKEN.findall(text)
        if len(self.known) + len(tokens) > self.code.size:
            self.known.clear()
            if len(tokens) > self.code.size:
                self.code, self.kind = np.zeros(len(tokens), np.uint64), np.zeros(len(tokens), np.uint8)
        known = self.known
        ids = np.array([known[t] if t in known else self._add(t) for t in tokens], np.int64)
        code, kind = self.code[ids], self.kind[ids]
        before = np.r_[np.uint8(END), kind[:-1]] if ids.size else kind
        number = (kind & NUMBER) > 0
        name = ((kind & NAME) > 0) & ((before & END) == 0)
        unit = ((kind & UNIT) > 0) & ((before & NUMBER) > 0)
        code = np.where(number, _CODE[NUMBER], np.where(unit, _CODE[UNIT], np.where(name, _CODE[NAME], code)))
        words = np.flatnonzero((kind & END) == 0)
        return code[words], (number | name | unit)[words], tokens, words

    def literal(self, tokens: list[str], words: np.ndarray) -> np.ndarray:
        """Hashes of the words as they stand, of the text that canonical() read last."""
        known = self.known
        return self.code[np.array([known[tokens[i]] for i in words], np.int64)] ^ _LITERAL


def window_hashes(code: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of so many words, and whether at least half of it is literal."""
    n = code.size - size + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, bool)
    total = np.full(n, np.uint64(size))
    with np.errstate(over="ignore"):
        for j in range(size):
            total = (total ^ (total >> np.uint64(29))) * _BASE + code[j : j + n]
        total = (total ^ (total >> np.uint64(32))) * _BASE
    slots = np.r_[0, np.cumsum(slot)]
    return total.view(np.int64), 2 * (slots[size:] - slots[:-size])[:n] <= size


def _windows(table: DataFrame, sizes: tuple[int, ...] | None, only: np.ndarray | None) -> DataFrame:
    """(key, text_hash, hash, at, slots) of the windows; sizes None: WINDOW, or the whole of a shorter text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            rows: list[tuple] = []
            for key, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                code, slot, tokens, places = reader.canonical(text_or_empty(text))
                if not code.size:
                    continue
                for size in sizes or (min(WINDOW, code.size),):
                    hashes, literal = window_hashes(code, slot, size)
                    hashes = hashes & ~np.int64(1)
                    if not literal.all():  # mostly placeholders: their words as they stand, told by an odd hash
                        hashes = np.where(literal, hashes, window_hashes(reader.literal(tokens, places), slot, size)[0] | np.int64(1))
                    wanted = np.ones(hashes.size, bool)
                    if only is not None:
                        at = np.minimum(np.searchsorted(only, hashes), only.size - 1)
                        wanted = only[at] == hashes if only.size else np.zeros(hashes.size, bool)
                    for i in np.flatnonzero(wanted):
                        slots = [tokens[places[i + j]].lower() for j in np.flatnonzero(slot[i : i + size])]
                        rows.append((key, text_hash, int(hashes[i]), int(i), slots))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "text_hash", "hash", "at", "slots"])

    return table.mapInArrow(run, "key bigint, text_hash bigint, hash bigint, at bigint, slots array<string>")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, n_item_windows, coverage, reparameterised: one row for each pair found."""
    arrow_limits(docs.sparkSession)
    keyed = lambda t, i, x: t.select(t[i].cast("bigint").alias("key"), F.xxhash64(t[x].cast("string")).alias("text_hash"), t[x].cast("string").alias("text"))
    items = _windows(keyed(benchmark, "item_id", "text").distinct(), None, None)
    n = items.count()
    lengths = [r[0] for r in _lengths(keyed(benchmark, "item_id", "text")).where(F.col("size") < WINDOW).select("size").distinct().collect()]  # below WINDOW: a few numbers
    only = np.unique(np.array([r[0] for r in items.select("hash").distinct().collect()], np.int64)) if n <= SMALL else None
    found = _windows(keyed(docs, id_column, text_column), (WINDOW, *lengths), only)
    templates = items.select(F.col("key").alias("item_id"), F.col("text_hash").alias("item_hash"), "hash", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    met = found.distinct().join(templates, "hash")
    even = F.col("hash").bitwiseAND(F.lit(1).cast("bigint")) == 0
    pairs = F.array_distinct(F.flatten(F.collect_list(F.when(even, F.arrays_zip(F.col("item_slots").alias("t"), F.col("slots").alias("d"))))))
    by = ["key", "text_hash", "item_id", "item_hash"]
    lined = met.groupBy(*by, (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("places"), F.collect_set(F.when(even, F.col("item_at"))).alias("even_places"), pairs.alias("pairs"))
    one_to_one = (F.size("pairs") == F.size(F.array_distinct("pairs.t"))) & (F.size("pairs") == F.size(F.array_distinct("pairs.d")))
    changed = F.exists("pairs", lambda p: p["t"] != p["d"])
    n_places = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("bigint")
    covered = lined.where(one_to_one).groupBy(*by).agg(n_places("places").alias("n_all"), n_places("even_places").alias("n_even"), F.max(changed).alias("reparameterised"))
    sizes = templates.groupBy("item_id", "item_hash").agg(F.count("*").alias("n_item_all"), F.count(F.when(even, F.lit(1))).alias("n_item_even"))
    # the canonical windows alone suffice, as do all; else windows that only equal values match would outweigh them
    canonical = (F.col("n_item_even") > 0) & (F.col("n_even") >= COVER * F.col("n_item_even"))
    joined = covered.join(sizes, (covered.item_id.eqNullSafe(sizes.item_id)) & (covered.item_hash == sizes.item_hash)).drop(sizes.item_id).drop(sizes.item_hash)
    joined = joined.withColumns({"n_windows": F.when(canonical, F.col("n_even")).otherwise(F.col("n_all")), "n_item_windows": F.when(canonical, F.col("n_item_even")).otherwise(F.col("n_item_all"))})
    share = F.col("n_windows") / F.col("n_item_windows")
    return joined.where(share >= COVER).select(F.col("key").alias("doc_id"), "text_hash", "item_id", "n_windows", "n_item_windows", share.alias("coverage"), "reparameterised").distinct()


def _lengths(table: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(reader.canonical(text_or_empty(t))[0].size) for t in batch.column(0).to_pylist()], pa.int64())], ["size"])

    return table.select("text").mapInArrow(run, "size bigint").where("size > 0")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    bad = contaminated(docs, benchmark).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    kept = rows.join(bad, F.col("row.doc_id").cast("bigint").eqNullSafe(bad.doc_id) & (F.xxhash64(F.col("row.text").cast("string")) == bad.text_hash), "left_anti")
    return kept.select("row.*")
