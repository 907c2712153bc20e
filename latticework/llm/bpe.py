"""Byte-level BPE encoding and decoding.

A text is cut by the vocabulary's own pattern; each piece is merged with a segment tree over the ranks of
adjacent pairs.  The root names the lowest rank, the leftmost leaf that holds it is merged, and three leaves
are updated, so a piece of n bytes takes O(n log n) however long it is.  The trees of a batch's new pieces of up to
WIDEST bytes lie side by side in arrays and take their merges in step: one merge a round in every tree.

Words between blanks ("stretches") and pieces are remembered within a task, up to a bound in characters; every text's
ids are put together from them, and its decoded bytes from its ids.

Edge cases: a null text counts as empty and gives no ids; a special token's own string in a text gives that
token's id; texts and pieces of any length are encoded whole, a long one as a group of its own; repeated rows are
encoded each on its own, and ties between equal ranks go to the left; an empty table gives no rows; columns other
than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_limits, text_or_empty

#: Fixed value: how byte-level vocabularies cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for Python's faster engine, wherever its classes agree with the properties above.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NO_PAIR = (1 << 31) - 1
#: A worker forgets its pieces and stretches beyond so many characters, a row counting as ROW_CHARS of them, and when a task ends.
CACHE_CHARS, ROW_CHARS = 72_000_000, 64
#: Characters of texts that are encoded together (at least one text), bytes of the pieces and pieces merged in step, ids decoded at once.
GROUP_CHARS, WIDEST, ABREAST, SLICE = 1_000_000, 64, 8192, 1 << 18
#: A blank behind which new stretches are cut together; texts that hold it are cut in another way.
SEPARATOR = "\x0b"


@cache
def _told_apart() -> re.Pattern:
    """Characters that PLAIN and PATTERN class differently, and all beyond the basic plane."""
    found = []
    for begin in range(0, 0x10000, 0x1000):
        part = "".join(map(chr, range(begin, begin + 0x1000)))
        sets = [(set(re.findall(x, part)), set(regex.findall(y, part))) for x, y in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"))]
        found += sorted(set().union(*(x ^ y for x, y in sets)))
    return re.compile("[" + "".join(map(re.escape, found)) + "\U00010000-\U0010ffff]")


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        vocab, to_byte = model["vocab"], {c: b for b, c in byte_alphabet().items()}
        self.of_byte = [vocab[c] for _, c in sorted(byte_alphabet().items())]
        self.rank_of: dict[int, int] = {}  # of a pair of ids, as one number
        self.made: list[int] = []  # rank -> the id that the merge makes
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_of[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        names = vocab | self.special
        told = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            known = all(c in to_byte for c in token)
            told[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self.bytes_of, self.names = Ledger(np.uint8), Ledger(np.uint8)
        for ledger, rows in ((self.bytes_of, told), (self.names, [b"%d," % i for i in range(len(told))])):
            ledger.add(list(map(str, range(len(rows)))), np.frombuffer(b"".join(rows), np.uint8), np.fromiter(map(len, rows), np.int64, len(rows)))
        self.cut_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.cut_pieces = regex.compile(PATTERN)
        self.cut_plain, self.odd = re.compile(PLAIN), _told_apart()
        self.cut_spaces = re.compile(r"(?<=\S)(?= \S)")
        self.run_of_blanks = re.compile(r" (?<=\s )(?:(?=\s)|\Z)")
        self.byte_ids, self.made_ids = np.array(self.of_byte, np.int32), np.array(self.made, np.int32)
        codes = np.fromiter(self.rank_of.keys(), np.int64, len(self.rank_of))
        order = np.argsort(codes)
        self.codes = np.r_[codes[order], np.iinfo(np.int64).max]
        self.ranks = np.r_[np.fromiter(self.rank_of.values(), np.int32, len(self.rank_of))[order], np.int32(NO_PAIR)]
        self.forget()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece.  low is the tree: low[1] the root, low[width + i] the rank of the pair at symbol i."""
        of_byte, find, made = self.of_byte, self.rank_of.get, self.made
        symbols = [of_byte[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return symbols
        width = 1 << (n - 1).bit_length()
        ranks = [find(a << 20 | b, NO_PAIR) for a, b in zip(symbols, symbols[1:])]
        low = [NO_PAIR] * width + ranks + [NO_PAIR] * (width - n + 1)
        for i in range(width - 1, 0, -1):
            x, y = low[i + i], low[i + i + 1]
            low[i] = x if x < y else y
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (rank := low[1]) != NO_PAIR:
            i = 1
            while i < width:  # the leftmost leaf of this rank
                i += i
                if low[i] != rank:
                    i += 1
            i -= width
            j = after[i]
            symbols[i], symbols[j] = made[rank], -1
            k, h = after[j], before[i]
            after[i] = k
            at = j + width
            low[at] = NO_PAIR
            while at > 1:
                at >>= 1
                x, y = low[at + at], low[at + at + 1]
                if y < x:
                    x = y
                if low[at] == x:
                    break
                low[at] = x
            at = i + width
            if k < n:
                before[k] = i
                low[at] = find(symbols[i] << 20 | symbols[k], NO_PAIR)
            else:
                low[at] = NO_PAIR
            while at > 1:
                at >>= 1
                x, y = low[at + at], low[at + at + 1]
                if y < x:
                    x = y
                if low[at] == x:
                    break
                low[at] = x
            if h >= 0:
                at = h + width
                low[at] = find(symbols[h] << 20 | symbols[i], NO_PAIR)
                while at > 1:
                    at >>= 1
                    x, y = low[at + at], low[at + at + 1]
                    if y < x:
                        x = y
                    if low[at] == x:
                        break
                    low[at] = x
        return [s for s in symbols if s >= 0]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; a symbol of -1 pairs with nothing."""
        codes = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.codes, codes)
        return np.where(self.codes[at] == codes, self.ranks[at], np.int32(NO_PAIR))

    def merge_abreast(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many pieces of 2 to width bytes, width a power of two; column width stands for no neighbour.
        Gives the ids one piece after the other, and how many each has."""
        m, w = len(pieces), width
        sizes = np.fromiter(map(len, pieces), np.int64, m)
        symbols = np.full((m, w + 1), -1, np.int32)
        symbols[np.arange(w + 1) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        low = np.empty((m, 2 * w), np.int32)
        low[:, w:] = self.pair_ranks(symbols[:, :-1], symbols[:, 1:])
        level = w
        while level > 1:
            level //= 2
            low[:, level : 2 * level] = low[:, 2 * level : 4 * level].reshape(m, level, 2).min(axis=2)
        places = np.arange(w + 1, dtype=np.int64)
        after = np.where(places + 1 < sizes[:, None], places + 1, w)
        before = np.tile(np.r_[w, places[:-1]], (m, 1))
        flat, tree, after, before = symbols.ravel(), low.ravel(), after.ravel(), before.ravel()
        rows = np.arange(m)
        while True:
            rank = tree[rows * 2 * w + 1]
            live = rank != NO_PAIR
            rows, rank = rows[live], rank[live]
            if not rows.size:
                break
            root, first = rows * 2 * w, rows * (w + 1)
            i, level = np.ones(rows.size, np.int64), 1
            while level < w:  # the leftmost leaf of this rank
                level *= 2
                i += i
                i += tree[root + i] != rank
            i -= w
            j, h = after[first + i], before[first + i]
            k = after[first + j]
            made = self.made_ids[rank]
            flat[first + i], flat[first + j] = made, -1
            after[first + i], before[first + k] = k, i
            tree[root + w + i] = self.pair_ranks(made, flat[first + k])
            tree[root + w + j] = NO_PAIR
            has = h < w
            tree[(root + w + h)[has]] = self.pair_ranks(flat[(first + h)[has]], made[has])
            nodes = w + np.stack([i, j, np.where(has, h, i)])
            while level > 1:
                level //= 2
                nodes >>= 1
                under = root + 2 * nodes
                tree[root + nodes] = np.minimum(tree[under], tree[under + 1])
        left = symbols >= 0
        return symbols[left], left.sum(axis=1)

    def meet_pieces(self, pieces: list[str]) -> None:
        """Merge pieces that aren't remembered and remember them."""
        if not pieces:
            return
        encoded = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        order = np.argsort(sizes, kind="stable")
        short = order[np.searchsorted(sizes[order], 2) : np.searchsorted(sizes[order], WIDEST, "right")]
        rest = np.setdiff1d(order, short).tolist()
        self.pieces.add([pieces[i] for i in rest], *_flat([self.merge(encoded[i]) for i in rest]))
        for i in range(0, short.size, ABREAST):
            part = short[i : i + ABREAST]
            width = 1 << int(sizes[part[-1]] - 1).bit_length()
            part = part.tolist()
            self.pieces.add([pieces[i] for i in part], *self.merge_abreast([encoded[i] for i in part], width))

    def meet(self, stretches: list[str]) -> None:
        """Cut stretches that aren't remembered into pieces and remember their ids.

        Most are cut in one go, behind a blank that no text here holds; those that begin or end with blanks, which would
        run together with it, are cut on their own.
        """
        whole = [s for s in stretches if s in self.special]
        alone = [s for s in stretches if s not in self.special and (SEPARATOR in s or s[-1].isspace() or s[:2].isspace())]
        apart = {*whole, *alone}
        together = [s for s in stretches if s not in apart]
        if whole:
            self.stretches.add(whole, *_flat([self.special[s]] for s in whole))
        if together:
            joined = SEPARATOR.join(together)
            pieces = (self.cut_pieces if self.odd.search(joined) else self.cut_plain).findall(joined)
            self._remember(together, pieces, np.flatnonzero(np.fromiter(map(SEPARATOR.__eq__, pieces), bool, len(pieces))))
        for s in alone:
            self._remember([s], self.cut_pieces.findall(s), np.empty(0, np.int64))

    def _remember(self, stretches: list[str], pieces: list[str], cuts: np.ndarray) -> None:
        """The stretches lie one after the other in pieces, at cuts the blanks between them."""
        index = self.pieces.index
        new = set(pieces).difference(index)
        if cuts.size:
            new.discard(SEPARATOR)
        self.meet_pieces(list(new))
        if cuts.size:
            kept = np.ones(len(pieces), bool)
            kept[cuts] = False
            at = np.fromiter(map(index.get, pieces, repeat(0)), np.int64, len(pieces))[kept]
            bounds = np.r_[0, cuts - np.arange(cuts.size), at.size]
        else:
            at, bounds = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces)), np.array([0, len(pieces)])
        ids, ends = self.pieces.gather(at)
        self.stretches.add(stretches, ids, np.diff(np.r_[0, ends][bounds]))

    def cut(self, text: str) -> list[str]:
        """The text cut where no piece crosses: around special tokens, and before a single space between two other
        characters, which always begins a piece."""
        found, begin = [], 0
        for m in chain(self.cut_special.finditer(text), [None]):
            part = text[begin : m.start()] if m else text[begin:]
            if part:
                if SEPARATOR in part or self.run_of_blanks.search(part):
                    found += self.cut_spaces.split(part)
                else:
                    parts = part.replace(" ", SEPARATOR + " ").split(SEPARATOR)
                    found += parts if parts[0] else parts[1:]
            if m:
                found.append(m[0])
                begin = m.end()
        return found

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, some texts at a time."""
        begin = 0
        while begin < len(texts):
            size, stop = len(texts[begin]), begin + 1
            while stop < len(texts) and size + len(texts[stop]) <= GROUP_CHARS:
                size, stop = size + len(texts[stop]), stop + 1
            stretches, counts = [], [0]
            for t in texts[begin:stop]:
                stretches += self.cut(t)
                counts.append(len(stretches))
            if self.stretches.chars + self.pieces.chars > CACHE_CHARS:
                self.forget()
            self.meet(list(set(stretches).difference(self.stretches.index)))
            ids, ends = self.stretches.gather(np.fromiter(map(self.stretches.index.__getitem__, stretches), np.int64, len(stretches)))
            bounds = np.r_[0, ends][counts].tolist()
            for a, b in zip(bounds, bounds[1:]):
                yield ids[a:b]
            begin = stop

    def forget(self) -> None:
        self.stretches, self.pieces = Ledger(np.int32), Ledger(np.int32)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def digest_of(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        digest = hashlib.sha256()
        for i in range(0, ids.size, SLICE):
            told = self.names.gather(ids[i : i + SLICE])[0]
            digest.update(told if i + SLICE < ids.size else told[:-1])
        return digest.hexdigest()

    def decoded(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the ids' own bytes, or where those aren't valid what decoding makes of them."""
        told = b"".join(self.bytes_of.gather(ids[i : i + SLICE])[0].tobytes() for i in range(0, ids.size, SLICE))
        try:
            told.decode()
        except UnicodeDecodeError:
            return told.decode("utf-8", "replace").encode()
        return told

    def decode(self, ids) -> str:
        return self.decoded(np.asarray(ids, np.int64)).decode()


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, and their sizes."""
    lists = list(lists)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


class Ledger:
    """Rows of numbers by key, one after the other in an array that grows."""

    def __init__(self, dtype):
        self.index: dict[str, int] = {}
        self.starts, self.sizes = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.values, self.used, self.chars = np.empty(1024, dtype), 0, 0

    def add(self, keys: list[str], values: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of keys that aren't there yet."""
        n, m = len(self.index), len(self.index) + len(keys)
        if m > self.starts.size:
            self.starts, self.sizes = (np.r_[x[:n], np.empty(m, np.int64)] for x in (self.starts, self.sizes))
        if self.used + values.size > self.values.size:
            self.values = np.r_[self.values[: self.used], np.empty(self.used + values.size, self.values.dtype)]
        self.values[self.used : self.used + values.size] = values
        self.sizes[n:m] = sizes
        self.starts[n:m] = self.used + np.cumsum(sizes) - sizes
        self.used += values.size
        self.chars += sum(map(len, keys)) + ROW_CHARS * len(keys)
        self.index.update(zip(keys, range(n, m)))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after the other, and where each ends."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if ends.size else 0
        return self.values[np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(n)], ends


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids array] of every row; a map, so nothing is shuffled."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        try:
            for batch in batches:
                n_tokens, of_ids, of_text, all_ids = [], [], [], []
                for ids in own.encode_all([text_or_empty(t) for t in batch.column(1).to_pylist()]):
                    n_tokens.append(ids.size)
                    of_ids.append(own.digest_of(ids))
                    of_text.append(hashlib.sha256(own.decoded(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            own.forget()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs[id_column].cast("bigint"), docs[text_column].cast("string")).mapInArrow(run, schema)
