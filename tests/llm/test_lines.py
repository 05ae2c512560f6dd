import os
import random

import pytest
from pyspark.sql import functions as F

from stepweave.llm import lines

from . import brute

R = random.Random(12)


def pair(n, spaced, r=R):
    """Two lines of exact similarity 0.8 or more, one character or the last number apart."""
    while True:
        t = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(5, 11))) for _ in range(n))
        t = t if spaced else t.replace(" ", "")
        k = r.choice([0, len(t) - 1, r.randrange(len(t))])
        x, y = (t[:k] + "#" + t[k + 1 :], t) if r.random() < 0.5 else (f"{t} {r.randint(1, 9)}", f"{t} {r.randint(10, 99)}")
        a, b = brute.line_sets(x), brute.line_sets(y)
        if x != y and 100 * len(a & b) >= 80 * len(a | b):
            return x, y


def left(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}


def test_lines_of_few_words_and_without_spaces_are_found(spark):
    kinds = [(n, True) for n in (4, 5, 6, 7, 8)] + [(n, False) for n in (4, 8, 30)]
    texts = [x for n, spaced in kinds for _ in range(60) for x in pair(n, spaced)]
    got = left(spark, texts)
    lost = [i for i in range(1, len(texts), 2) if got[i] != ""]
    assert len(lost) <= 1, [(texts[i - 1], texts[i]) for i in lost[:5]]
    assert all(got[i] == texts[i] for i in range(0, len(texts), 2))


def test_short_lines_are_judged(spark):
    short = ["Read more", "Share on Facebook", "All rights reserved.", "ab", "版权所有,未经许可不得转载。", "}"]
    texts = ["\n".join([*short, "", " ", f"only here {i}"]) for i in range(3)]
    got = left(spark, [*texts, "click here for more 1\nclick here for more 2"])
    want = brute.lines(list(enumerate([*texts, "click here for more 1\nclick here for more 2"])), 0)
    assert got == want
    assert got[1] == "\n \nonly here 1" and got[3] == "click here for more 1"


def test_lines_of_repeats_are_linked_at_any_length(spark):
    texts = ["=" * 40, "=" * 70, "* * * " * 8, "* * * " * 30, "ha " * 9 + "ha", "ha " * 200 + "ha", "-" * 5, "-" * 900, "=" * 39 + "#"]
    got = left(spark, texts)
    assert got == brute.lines(list(enumerate(texts)), 0)
    assert [i for i, t in got.items() if t] == [0, 2, 4, 6, 8]


def test_unlike_lines_of_one_bucket_are_ruled_out_before_they_are_paired(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    texts = [f"all rights are reserved by {' '.join(word() for _ in range(r.randint(6, 14)))}" for _ in range(700)]
    texts += [f"{t} {r.randint(10, 99)}" for t in texts[:40]] + [f"{'ha ' * 200}{' '.join(word() for _ in range(60))}" for _ in range(10)]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "node long, line string, part long")
    sized = df.select("node", "line", F.size(F.array_distinct(lines.hashes(F.col("line")))).alias("size"))
    got = {(x["a"], x["b"]) for x in lines._across(df.select(F.lit(1).alias("band"), "node", "part"), sized, 80).collect()}
    sets = [brute.line_sets(t) for t in texts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(want) >= 40 and want <= got and len(got) <= 2 * len(want)


def test_long_lines_that_nearly_are_similar_are_ruled_out_before_they_are_paired(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    base, texts = [word() for _ in range(75)], []
    for i in range(120):
        own = list(base)
        for k in r.sample(range(75), 2 if i < 12 else 4):
            own[k] = word()
        texts.append(" ".join(own))
    sets = [brute.line_sets(t) for t in texts]
    near = {(a, b): 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(sets)) for a in range(b)}
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "node long, line string, part long")
    sized = df.select("node", "line", F.size(F.array_distinct(lines.hashes(F.col("line")))).alias("size"))
    got = {(x["a"], x["b"]) for x in lines._across(df.select(F.lit(1).alias("band"), "node", "part"), sized, 80).collect()}
    want, below = {p for p, x in near.items() if x >= 80}, {p for p, x in near.items() if x < 75}
    assert len(want) >= 40 and want <= got
    assert len(below) >= 1000 and len(below & got) <= 0.05 * len(below)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/documents.parquet"), reason="the given tables are not here")
def test_lines_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    want = brute.lines(list(texts.items()), 0)
    count = lambda own: sum(len((texts[i] or "").split("\n")) - len((t or "").split("\n")) for i, t in own.items())
    wrong = [i for i in texts if (got[i] or "") != want[i]]
    assert count(want) > 50 and abs(count(got) - count(want)) <= 0.02 * count(want) and len(wrong) <= 0.02 * len(texts)
