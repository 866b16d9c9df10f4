"""Very long and one-sided texts, and what the learned parts find."""

from __future__ import annotations

import random
import re

import brute
from pyspark.sql import functions as F

from tarn.llm.lines import dedup_lines
from tarn.llm.private import find_private, redact, spans_text

DOCS = "doc_id long, text string"


def test_private_on_long_runs(spark):
    """No pattern may recurse or go quadratic on a megabyte of one thing."""
    big = 250_000
    texts = [
        "a@b" + ".cc" * big,
        "a." * big + "@b.c",
        "9" * big * 4,
        "1 2-" * big,
        "+1" + "(" * big * 4 + "5",
        "+" * big * 4,
        "1." * big,
        "a1" * big,
        "[=:" * big,
        "x@y." * big,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)
    rows = {r["doc_id"]: r for r in find_private(df).withColumn("b", spans_text(F.col("base"))).collect()}
    assert rows[0]["b"] == f"email:0:{len(texts[0])}"
    assert rows[1]["b"] == f"email:0:{len(texts[1])}"
    assert all(rows[i]["b"] == "" for i in (2, 4, 5, 7, 8))
    for i, t in enumerate(texts[:2] + texts[6:7] + texts[9:]):
        i = (0, 1, 6, 9)[i]
        small = t if len(t) < 2000 else t[:2000]
        got = find_private(spark.createDataFrame([(0, small)], DOCS)).select(spans_text(F.col("base"))).first()[0]
        assert got == ",".join(brute.base_spans(small)), i


def test_private_finds_planted_credentials(spark):
    """Recall and precision of the added spans on credentials and telephone numbers in four
    languages among look-alikes: product codes, hashes in paths, words with a number."""
    rng = random.Random(7)
    words = "the of and a report shows data model les une avec der und mit para con los results table figure".split()
    before = ["password: {}", "api token = '{}'", "mot de passe : {}", "Passwort: {}", "contraseña: {}", "clave = {}", "key={}"]
    calls = ["call {}", "tel: {}", "téléphone {}", "Telefon: {}", "teléfono: {}"]
    near = ["see /files/{}.html", "commit @{}", "chapter{}", "#{}"]

    def filler(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows, planted, decoys = [], {}, {}
    for i in range(600):
        kind = i % 4
        if kind == 0:
            secret = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([20, 32, 40, 80, 200])))
            secret = "a1" + secret
            text = f"{filler(12)} {rng.choice(before).format(secret)} {filler(8)}"
            planted[i] = secret
        elif kind == 1:
            secret = f"({rng.randint(200, 989)}) {rng.randint(200, 989)}-{rng.randint(1000, 9999)}"
            text = f"{filler(12)} {rng.choice(calls).format(secret)} {filler(8)}"
            planted[i] = secret
        elif kind == 2:
            secret = "".join(rng.choice("abcdefghij") for _ in range(18)) + str(rng.randint(1, 99))
            text = f"{filler(12)} {rng.choice(near).format(secret)} {filler(8)}"
            decoys[i] = secret
        else:
            text = filler(25)
        rows.append((i, text))
    out = find_private(spark.createDataFrame(rows, DOCS)).withColumn("clean", redact(F.col("text"), F.col("spans"))).collect()
    clean = {r["doc_id"]: r["clean"] for r in out}
    caught = sum(s not in clean[i] for i, s in planted.items())
    left = sum(s in clean[i] for i, s in decoys.items())
    assert caught >= 0.95 * len(planted), caught
    assert left >= 0.95 * len(decoys), left
    assert all(clean[i] == t for i, t in rows if i % 4 == 3)


def test_lines_of_long_documents(spark):
    """Work grows with the lines: 12 documents of 60,000 shared lines and some of their own."""
    shared = [f"shared line number {i}" for i in range(60_000)]
    texts = ["\n".join([f"own {d}", *shared, "", f"end {d}"]) for d in range(12)]
    rows = [(d, t, f"site{d}") for d, t in enumerate(texts)] + [(20, "\n".join(shared[:5]), "site1"), (21, None, None)]
    df = spark.createDataFrame(rows, f"{DOCS}, source string")
    got = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    assert all(got[d]["clean_text"] == f"own {d}\n\nend {d}" for d in range(12))
    assert got[0]["n_lines"] == 60_002 and got[0]["n_removed"] == 60_000
    assert got[20]["n_removed"] == 0 and got[20]["n_boilerplate"] == 5 and got[20]["clean_text"] == texts[0][6:][: len(rows[12][1])]
    assert got[21]["clean_text"] is None and got[21]["n_lines"] == 0


def test_every_line_counts_once(spark):
    lines = ["a", " a ", "b", "", "c c"]
    rows = [(i, "\n".join(lines), f"s{i}") for i in range(11)] + [(99, "a\nmine\na", "s1")]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, f"{DOCS}, source string")).collect()}
    assert got[99]["clean_text"] == "mine" and got[99]["n_removed"] == 2
    assert re.fullmatch("a\n a \nb\n\nc c", got[0]["clean_text"])
