r"""Quality rules in a ledger of failure bits.

Every rule is measured once for each document; the ledger keeps the measurements and one bit for each rule that
failed.  A policy is a version and a mask of rules, so policies are applied, compared and ablated by bitwise
arithmetic on the ledger, without reading a text again.

Edge cases: a null text has no words; a text without words fails by n_words alone; texts of any length are
measured whole; repeated rows are measured each on its own. An empty table gives no rows;
columns other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, text_or_empty

#: Rule -> whether measurements fail it.  The bit of a rule is its place here; new rules go to the end.
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["word_chars"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 20 * m["n_words"],
    "repeated_lines": lambda m: 10 * m["n_dup_lines"] > 7 * max(m["n_lines"], 1),
}
BASE_RULES = ("few_words", "repeated_windows")
#: Version -> rules that reject a document.
POLICIES = {1: BASE_RULES, 2: (*BASE_RULES, "symbols", "short_words", "long_words", "repeated_lines")}
CURRENT = 2
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def measure(text: str | None) -> dict[str, int]:
    data = text_or_empty(text).encode()
    words = data.split()  # of bytes: by the six ASCII blanks
    blank = sum(data.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    continued = 0 if data.isascii() else len(data) - len(text_or_empty(text))
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(windows) > 1:
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = 0  # the first place that isn't counted yet
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(covered, i)
                    covered = i + 3
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return {
        "n_words": len(words),
        "word_chars": len(data) - blank - continued,
        "n_symbols": sum(data.count(b) for b in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
        "n_lines": len(lines),
    }


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the measurements, and failed: a bit for each rule that fails; a map."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = list(RULES.values())
        for batch in batches:
            rows = [measure(t) for t in batch.column(1).to_pylist()]
            failed = [sum(1 << i for i, r in enumerate(rules) if r(m)) for m in rows]
            columns = [pa.array([m[k] for m in rows], pa.int64()) for k in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed, pa.int64())], ["doc_id", *MEASURES, "failed"])

    schema = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in MEASURES) + ", failed bigint"
    return docs.select(docs[id_column].cast("bigint"), docs[text_column].cast("string")).mapInArrow(run, schema)


def judged(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    bits = lambda rules: F.col("failed").bitwiseAND(F.lit(mask(rules))) != 0
    return book.withColumns({"base_failed": bits(BASE_RULES), "kept": ~bits((*BASE_RULES, *POLICIES[version]))})


def ablation(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """rule, n_failed, n_only: documents that a rule of the policy rejects, and those that no other rule of it does."""
    rules = POLICIES[version]
    whole = F.col("failed").bitwiseAND(F.lit(mask(rules)))
    counts = [x for r in rules for x in (F.count_if(whole.bitwiseAND(F.lit(mask([r]))) != 0).alias(f"f_{r}"), F.count_if(whole == mask([r])).alias(f"o_{r}"))]
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in rules]))
    return book.agg(*counts).select(pairs.alias("x")).select("x.*")
