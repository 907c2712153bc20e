"""The pipeline as a whole on odd rows, and two operators against brute force."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from latticework.llm import decontam, linededup

ODD = [None, "", "  \n ", "one", "word tail. " * 20000, "same words here\nand there\n\nsame words here\nand there", "Solve: 12 + 7 - 3 = 16"]


def odd_tables(spark, path, empty=False):
    rows = [(i if i != 3 else None, t, "en", "web", len(t or ""), "x") for i, t in enumerate(ODD)] + [(5, ODD[5], "en", "web", 1, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string")
    tables = {
        "documents": docs,
        "labels": spark.createDataFrame([(0, 1, 0), (5, None, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(0, None), (1, "Solve: 12 + 7 - 3 = 16"), (1, "")], "item_id bigint, text string"),
    }
    for name, table in tables.items():
        (table.limit(0) if empty else table).write.parquet(f"{path}/{name}.parquet")
    return docs


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = odd_tables(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    kept = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 6 not in kept and kept[0] == 0 and kept[4] > 20000 and 1 not in kept and 2 not in kept and set(kept) == {0, None, 4, 5}
    odd_tables(spark, str(tmp_path / "empty"), empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def without_repeats(texts):
    """Texts less the lines of pairs of neighbouring lines that an earlier document, or an earlier place, holds, and of long lines."""
    seen, out = {}, []
    for d, text in texts:
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        spans = [(i, j, (lines[i], lines[j])) for i, j in zip(full, full[1:])] + [(i, i, lines[i]) for i in full if len(lines[i].split()) >= 50]
        gone = set()
        for i, j, body in spans:
            if body not in seen:
                seen[body] = (d, i, j)
            elif seen[body][0] != d or i > seen[body][2]:
                gone.update(range(i, j + 1))
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    line = [f"line {i} of some words" for i in range(40)] + ["", "  "] + [" ".join(f"w{i}{j}" for j in range(55)) for i in range(4)]
    texts = [(d, "\n".join(rng.choice(line) for _ in range(rng.randrange(1, 25)))) for d in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    assert sorted((r["doc_id"], r["text"]) for r in linededup.cleaned(docs).collect()) == without_repeats(texts)


def test_decontamination_against_brute_force(spark):
    """Literal lower-case items: a document is found if it holds at least half of an item's six-word windows in line."""
    rng = random.Random(7)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4, 20)))) for i in range(15)]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 40))]
        if d % 3 == 0:
            piece = items[d % 15][1].split()
            text[3:3] = piece[: rng.randrange(1, len(piece) + 1)]
        docs.append((d, " ".join(text)))

    def found(text, item):
        w, t = item.split(), text.split()
        size = min(6, len(w))
        windows = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        for shift in range(-len(w), len(t)):
            hits = sum(0 <= shift + i <= len(t) - size and tuple(t[shift + i : shift + i + size]) == x for i, x in enumerate(windows))
            if 2 * hits >= len(windows):
                return True
        return False

    want = {(d, i) for d, t in docs for i, x in items if found(t, x)}
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} bigint, text string")
    told = decontam.contaminated(table(docs, "doc_id"), table(items, "item_id"))
    assert {(r["doc_id"], r["item_id"]) for r in told.collect()} == want and len(want) > 5 and re.match("w", words[0])


def test_reparameterised_items_are_found(spark):
    names, verbs = ["Anna", "Bruno", "Carla", "Diego", "Elena"], ["buys", "sells", "finds", "loses", "paints"]
    item = lambda i, x, n, m: f"On the market {x} {verbs[i]} {n} red apples and then gives {m} kg of pears to an old friend from school, how many are left"
    items = [(i, item(i, names[i], 10 + i, 3 + i)) for i in range(5)]
    docs = [(i, "Some words before. " + item(i, names[(i + 2) % 5], 70 + i, 20 + i) + " and after.") for i in range(5)] + [(9, "Nothing of the kind is told in here at all, only plain words.")]
    told = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    found = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in told.collect()}
    # the items share a template but for a verb, so each document fits its own item and may fit others
    assert {(i, i) for i in range(5)} <= found.keys() and all(found.values()) and all(d != 9 for d, _ in found)
    assert told.where(F.col("coverage") < decontam.COVER).count() == 0
