"""Places where the operators once did less than the whole job."""

import random
import re

from pyspark.sql import functions as F

from latticework.llm import decontam, license, linededup, urlfilter


def test_line_dedup_takes_passages_with_uneven_lines(spark):
    rng = random.Random(2)
    line = lambda n=12: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    lines = [line() for _ in range(6)]
    passage = "\n".join(lines)
    docs = [(1, passage), (2, line() + "\n" + lines[1] + "\n" + line()), (3, lines[3] + "\n" + line()), (4, line() + "\n" + passage + "\n" + line()),
            (5, "\n\n".join(lines)), (6, "\n".join(lines[2:5])), (7, "x\nx\nx"), (8, lines[0] + "\n" + lines[2])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["clean"], r["n_removed_lines"], r["n_removed_chunks"]) for r in linededup.deduplicated(table).select("row.doc_id", "clean", "n_removed_lines", "n_removed_chunks").collect()}
    ends = docs[3][1].split("\n")
    want = {d: (t, 0, 0) for d, t in docs} | {4: (ends[0] + "\n" + ends[-1], 6, 1), 5: ("", 11, 1), 6: ("", 3, 1)}
    assert got == want


def test_line_dedup_takes_every_pair_that_stands_before(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    first, want = {}, {}
    units = {}
    for d in sorted(rows):
        lines = rows[d].split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        units[d] = [(i, j, (lines[i], lines[j])) for i, j in zip(full, full[1:])] + [(i, i, lines[i]) for i in full if len(re.split("[ \t\r]+", lines[i].strip(" "))) >= 50]
        for i, j, body in sorted(units[d], key=lambda u: u[:2]):
            first.setdefault(body, (d, i, j))
    for d, text in rows.items():
        gone = {k for i, j, body in units[d] for x, _, y in [first[body]] if x != d or i > y for k in range(i, j + 1)}
        want[d] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    got = {r["doc_id"]: r["text"] for r in linededup.cleaned(docs).collect()}
    assert got == want and want != rows


def test_license_short_forms(spark):
    texts = ["© 2020 Acme. All rights reserved.", "Mozilla Public License v 2.0", "GNU General Public License version 3", "see the MIT License", "all rights are reserved"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in license.scan_documents(table).collect()}
    assert got == {0: "proprietary", 1: "mpl-2", 2: "gpl-3", 3: "mit", 4: ""}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["labels"].split(",") for r in license.scan_documents(docs).collect()}
    lines = [r["doc_id"] for r in docs.collect() if re.search(r"(^|\n)All rights reserved\.", r["text"] or "")]
    assert lines and all("proprietary" in labels[d] for d in lines)


def test_url_rules_against_a_plain_scan(spark, monkeypatch):
    paths = ["clickthrough", "click2", "click", "xclick", "a/click", "Xcasino/", "casino", "casinos", "CASINO/", "x-pornX", "Xporn.y", "Atorrent/b", "torrent/", "torrent", "a.EXE", "a.msi"]
    urls = [f"http://{h}/{p}" for h in ("ads.example.org", "AD.example.org", "bad.example.org", "casino.example") for p in paths]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    want = {}
    for i, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        want[i] = min((r.name for r in urlfilter.PATTERN_RULES if re.search(r.regex, host.lower() + "/" + path)), default=None)
    for most in (urlfilter.SMALL, 0):
        monkeypatch.setattr(urlfilter, "SMALL", most)
        assert {r["page_id"]: r["method_rule"] for r in urlfilter.judged(pages).collect()} == want


def test_decontamination_of_items_that_are_mostly_placeholders(spark):
    items = ["Compute 3 + 4 * 12 - 8", "Solve: 12 + 7 - 3 = 16", "Did Marie Curie Meet Albert Einstein In Paris?"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = [(i, f"some words before. {x} and some after") for i, x in enumerate(items)] + [(3, "some words before. Compute 5 + 9 * 11 - 2 and some after"), (4, "Did John Smith Meet Mary Jones In London?")]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_decontamination_keeps_changed_items_with_few_plain_windows(spark):
    item = "Alice walked to the old market and bought 3 7 9 4 8 2 6 5 1 for her"
    changed = "Then Carol walked to the old market and bought 13 17 19 14 18 12 16 15 11 for her"
    table = lambda x, c: spark.createDataFrame([(0, x)], f"{c} bigint, text string")
    found = [(r["doc_id"], r["reparameterised"]) for r in decontam.contaminated(table("Yes. " + changed[5:], "doc_id"), table(item, "item_id")).collect()]
    assert found == [(0, True)]
