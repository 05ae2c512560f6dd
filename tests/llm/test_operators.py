import math
import random

import pytest
from pyspark.sql import functions as F

from stepweave.llm import chains, decontaminate, fmindex, language, lines, minhash, mixing, pii, quality, substrings, urls
from stepweave.llm.components import components

from . import brute

R = random.Random(4)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 9))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def changed(t, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) if r.random() < share else w for w in t.split(" "))


def corpus():
    """Exact and near copies, shared passages, empty, null, white and long texts."""
    docs, passage = [], prose(60, 1)
    for i in range(24):
        docs.append(prose(40 + 5 * i, 100 + i))
    docs += [docs[3], docs[3], changed(docs[5], 0.01, 1), changed(docs[5], 0.02, 2), changed(docs[23], 0.03, 3)]
    docs += [prose(20, 5) + " " + passage + " " + prose(9, 6), passage + " " + prose(30, 7), prose(30, 8) + "\n" + passage.upper()]
    docs += ["", None, " \t\n ", "one", "One", "two words", "é" * 60, "é" * 61, "x" * 200, prose(5000, 9)]
    docs.append(docs[-1])
    return [(3 * i, t) for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, none, width):
    want = brute.near(corpus(), width)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, width).collect()}
    assert got == want
    assert minhash.near_duplicates(none, width).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Many near copies in one bucket, of which some are near only to some."""
    base = prose(150, 77)
    own = [(i, changed(base, 0.002 * (i % 12), i)) for i in range(150)]
    want = brute.near(own, 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_without_ids_and_with_the_same(spark):
    t = prose(30, 1)
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (2, prose(30, 2)), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, 4, False), (2, 2, True), (4, 4, True), (4, 4, True)]


def test_parity_bound_never_rules_out_a_link():
    import numpy as np

    for seed in range(30):
        r = np.random.default_rng(seed)
        a = np.unique(r.integers(0, 2**64, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(100, 200)], r.integers(0, 2**64, 20, dtype=np.uint64)]))
        apart = int(np.bitwise_count(minhash.parity(a) ^ minhash.parity(b)).sum())
        assert apart <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    got = components(df)
    assert got.groupBy("label").count().select("count").orderBy("count").toPandas()["count"].tolist() == [2, 40, 61]
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("part_bytes", [400, 1 << 23])
def test_substrings(docs, none, part_bytes):
    got = substrings.duplicate_substrings(docs, part_bytes=part_bytes).withColumn("h", F.sha2("kept", 256)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in got) == brute.substrings(corpus())
    assert substrings.duplicate_substrings(none).count() == 0


def test_substrings_of_pieces(spark, monkeypatch):
    """Documents longer than one pass of NumPy are cut into pieces that overlap."""
    t = prose(400, 3)
    own = [(1, t), (2, "z" * 37 + t[100:] + prose(50, 4)), (3, "z" * 120)]
    monkeypatch.setattr(substrings, "PASS", 300)
    ps = list(substrings.passes([x.encode() for _, x in own], [True] * 3))
    assert all(p.n <= 2 * (300 + substrings.WIDTH) for p in ps)
    assert sum(int(p.starts.sum()) for p in ps) == sum(len(x) - substrings.WIDTH + 1 for _, x in own)


def test_fuzzy_passages(docs, none):
    got = {r["doc_id"]: r for r in chains.fuzzy_passages(docs).collect()}
    words = {i: brute.WORD.findall(brute.low(t)) if t else [] for i, t in corpus()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][j : j + 50]), i)
    for i, w in words.items():
        covered = {k for p in got[i]["passages"] for k in range(p["start"], p["end"])}
        assert len(covered) == got[i]["n_repeated"] and got[i]["n_words"] == len(w)
        assert all(p["source"] < i for p in got[i]["passages"])
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                assert covered.issuperset(range(j, j + 50))
        if i < 3 * 24:
            assert not covered
    near = got[3 * 26]["passages"]  # a copy with changed words: one chain across the changes
    assert len(near) == 1 and near[0]["source"] == 15 and 0.8 <= near[0]["similarity"] < 1
    assert chains.fuzzy_passages(none).count() == 0


def test_chains_keep_order():
    import numpy as np

    got = chains.chains(np.array([0, 5, 10, 12, 90]), np.array([100, 105, 110, 3, 190]))
    assert sorted(map(tuple, got)) == [(0, 1, 2), (3,), (4,)]


def test_fm_index():
    import numpy as np

    r = np.random.default_rng(1)
    runs = [r.integers(1, 5, n) for n in (30, 1, 17, 30)] + [np.ones(40, np.int64)]
    runs.append(runs[0])
    seq = np.concatenate([x for own in runs for x in (own, [0])]).astype(np.int64)
    index = fmindex.FMIndex(seq, 4)
    for n in (1, 2, 3, 7):
        phrases = np.unique(np.stack([seq[i : i + n] for i in range(len(seq) - n) if (seq[i : i + n] > 0).all()]), axis=0)
        which, place = index.search(phrases)
        got = {(tuple(phrases[a]), int(b)) for a, b in zip(which, place, strict=True)}
        assert len(which) == len(got) and got == {(tuple(seq[i : i + n]), i) for i in range(len(seq) - n + 1) if (seq[i : i + n] > 0).all()}


ITEMS = [(1, prose(25, 50)), (2, prose(12, 51)), (3, VOCAB[3] + " " + VOCAB[9]), (4, None), (5, " "), (6, prose(25, 50)), (10, prose(14, 52))]


@pytest.mark.parametrize("block_bytes", [1 << 23, 60])
def test_decontaminate(spark, none, block_bytes):
    a, b = ITEMS[0][1], ITEMS[6][1]
    own = [*corpus(), (500, prose(9, 1) + " " + a[: len(a) // 2].upper() + ". " + prose(5, 2)), (501, b + ", " + b), (502, (a + "-" + b)), (503, "é" + a)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([(i, t, i) for i, t in own], "doc_id long, text string, spans long")  # a column that clashes
    out = decontaminate.decontaminate(df, items, block_bytes=block_bytes)
    got = {r["doc_id"]: r for r in out.withColumn("h", F.sha2(F.concat_ws(",", F.sort_array(F.col("items").cast("array<string>"))), 256)).collect()}
    want = brute.leaks(own, ITEMS)
    assert {i: (r["n_words"], r["n_hit"], len(r["items"]), r["h"], r["contaminated"]) for i, r in got.items()} == want
    assert brute.PLAIN.findall(got[501]["clean_text"]) == [] and got[1 * 3]["clean_text"] == dict(own)[3]
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(df, items.limit(0)).where("contaminated").count() == 0
    named = spark.createDataFrame([(f"set/{i}", t) for i, t in ITEMS], "item_id string, text string")
    kinds = {x for r in decontaminate.decontaminate(df, named).select("items").collect() for x in r["items"]}
    assert kinds and all(x.startswith("set/") for x in kinds)


RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
URLS = {
    "http://A.Example.org/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
    "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
    "http://x.com/d": ("x.com", "/d", None, "allow"),
    "http://spam-farm.example.com/fr/1": ("spam-farm.example.com", "/fr/1", "com/fr/", "allow"),
    "http://m.spam-farm.example.com/en/1": ("m.spam-farm.example.com", "/en/1", None, "block"),
    "http://org": ("org", "", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "http://": ("", "", None, "allow"),
    "://y.net?a/b": ("y.net", "", None, "allow"),
    "http://a.org/x\ny?z": ("a.org", "/x\ny", "org/", "allow"),
    "a://b.com://c/": ("b.com:", "//c/", None, "allow"),
}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_urls(spark, limit):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, None])], "page_id int, url string, verdict string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, RULES, max_index_bytes=limit).collect()}
    assert got == {**URLS, None: ("", "", None, "allow")}


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b))
    path = tmp_path / "x.idx"
    path.write_bytes(urls.build_index(["ab", "cd", "efg"]))
    index = urls.DigestArray(str(path))
    assert [index.size, *(index.find([b"cd", b"zz", b"efg", b"x"]) >= 0)] == [3, True, False, True, False]


def test_quality(spark, none):
    texts = ["a b c a b c", "w " * 60, prose(80, 1) + ".", None, "", "\n\n", "x\ny\nx\n x\nx\r", "§ ｜ € #|<>", *[t for _, t in corpus()], "a b a b a b a", "q r s t q r s u"]
    out = quality.base_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in out.collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.base(texts[r["doc_id"]]), texts[r["doc_id"]]
    good = "\n".join(prose(12, i).capitalize() + "." for i in range(8))
    bad = "\n".join([" | ".join(prose(20, i).split()) for i in range(6)] + [good.split("\n")[0]])
    shout = " ".join(f"{w.upper()}!!" for w in prose(80, 3).split())
    rows = [(1, good), (2, bad), (3, shout), (4, good + "\nAll rights reserved.")]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in range(1, 5)] == [True, False, False, True] and got[4]["clean_text"] == good
    assert quality.quality(none).count() == 0


def test_lines(spark, none):
    r = random.Random(2)
    own = []
    for i in range(30):
        rows = [prose(r.randint(6, 25), 1000 * i + k).capitalize() + "." for k in range(r.randint(1, 6))]
        if i % 3 == 0:
            rows.append("This page is part of the archive, read it with care.")
        if i % 4 == 1:
            rows.append(prose(15, 9) + " " + VOCAB[i])
        own.append((i, "\n".join([*rows, "short"])))
    own += [(40, None), (41, ""), (42, own[3][1]), (43, "\n \n")]
    df = spark.createDataFrame([(i, t, i) for i, t in own], "doc_id long, text string, n_lines long")
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(df).collect()}
    want = brute.lines(own, lines.SHORT)
    assert got[40] is None and {i: t for i, t in got.items() if i != 40} == {i: t for i, t in want.items() if i != 40}
    assert lines.dedup_lines(none).count() == 0


def test_hot_buckets_are_salted(spark):
    members = spark.createDataFrame([(7, i) for i in range(500)] + [(8, 3), (8, 4)], "band long, node long")
    plain, salted = (lines._stars(members, hot) for hot in ([], [7]))
    assert plain.count() == 500 and salted.count() == 500
    got = components(salted.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    assert got.select("label").distinct().count() == 1 and got.count() == 500


def test_mixing(docs, none):
    got = mixing.mix(docs, (5, 2, 1), 1.5, 2.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()))
    sizes = {}
    for i, t in corpus():
        s = f"s{i % 3}" if i % 7 else None
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    names = sorted((s for s in sizes if s), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, rest, left = {s: 0.0 for s in names}, 1.5 * sum(sizes.values()), set(names)
    while rest > 1e-9 and left:
        share = rest / sum(weight[s] for s in left)
        rest = 0.0
        for s in sorted(left, key=str):
            target[s] += share * weight[s]
            if target[s] > 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
        left = {s for s in left if target[s] < 2 * sizes[s]}
    longest = max(r["size"] for r in got)
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and math.isclose(r["target"], target[s]) and r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= longest / 2 + 1
    assert mixing.mix(none).count() == 0


def test_mixing_prefers_quality(spark):
    df = spark.createDataFrame([(i, "w w w w", "s", 1.0 if i % 2 else 0.1) for i in range(2000)], "doc_id long, text string, source string, q double")
    got = mixing.mix(df, share=0.3, quality=F.col("q")).where("taken > 0").groupBy(F.col("doc_id") % 2).count().collect()
    n = {r[0]: r["count"] for r in got}
    assert sum(n.values()) == 600 and n[1] > 4 * n[0]


TEXTS = {"en": "the cat and the dog are in the house with all of their things", "de": "der hund und die katze sind im haus mit allen ihren sachen", "fr": "le chat et le chien sont dans la maison avec toutes leurs choses"}


def test_language(spark, none):
    rows = [(i * 3 + k, " ".join(random.Random(i).sample(t.split(), 9)), lang) for i in range(60) for k, (lang, t) in enumerate(TEXTS.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where(~language.held_out(F.col("doc_id"))))
    got = language.identify(df.withColumn("score", F.lit("clash")), model).where(language.held_out(F.col("doc_id")))
    assert got.where("lang = lang_pred").count() / got.count() > 0.95 and got.where("score < 0 or score > 1").count() == 0
    odd = spark.createDataFrame([(None,), ("",), ("123 ² !?",), ("é",), ("x" * 100_000,)], "text string")
    assert [r["lang_pred"] == "und" for r in language.identify(odd, model).collect()] == [True, True, True, False, False]
    blank = language.fit(none)
    assert language.identify(df, blank).where("lang_pred <> 'und'").count() == 0
    one = language.fit(df.where("lang = 'de'"))
    assert {r["lang_pred"] for r in language.identify(df, one).select("lang_pred").distinct().collect()} == {"de"}


def test_codewords_are_far_apart():
    for n in (2, 4, 7, 40):
        code = language.codebook(n)
        assert min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


VALUES = {
    "email": "jo.doe7@mail.example.com",
    "card": "4111 1111 1111 1111",
    "phone": "(743) 555-3824",
    "ip": "152.143.123.131",
    "date": "2024-02-29",
    "iban": "DE89 3704 0044 0532 0130 00",
    "social": "123-45-6789",
    "token": "24be64439e3e49cf46b2d7c90f3602a3d0b907ff",
}


def test_pii_round_trip_and_format(spark, none):
    f = pii.Feistel(b"0" * 32)
    for kind, value in VALUES.items():
        new, counts = pii.pseudonymise(f"see {value}, then", f)
        assert counts == {kind: 1} and value not in new and len(new) == len(f"see {value}, then") or kind == "ip"
        again, counts = pii.pseudonymise(new, f, back=True)
        assert again == f"see {value}, then" and counts == {kind: 1}
    for same in ("4111-1111-1111-1111", "4111111111111111"):
        strip = lambda s: "".join(c for c in s if c.isdigit())
        assert strip(pii.card(same, f)) == strip(pii.card(VALUES["card"], f))
    for kept in ("4111 1111 1111 1112", "2024-02-30", "000-12-3456", "999.1.1.1", "no data, 12 cats", "DE00 3704 0044 0532 0130 00"):
        assert pii.pseudonymise(kept, f) == (kept, {})
    rows = [(1, " ".join(VALUES.values()), 5), (2, None, 5), (3, "", 5), (4, VALUES["phone"] + "\n" + VALUES["phone"], 5)]
    out = {r["doc_id"]: r for r in pii.protect(spark.createDataFrame(rows, "doc_id long, text string, n_card long"), b"0" * 32).collect()}
    assert out[1]["n_pii"] == 8 and out[2]["text"] is None and out[2]["n_pii"] == 0 and out[4]["n_phone"] == 2 and len(set(out[4]["text"].split("\n"))) == 1
    assert pii.protect(none, b"k").count() == 0


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"key")
    got = [f.permute("t", n, x) for x in range(n)]
    assert sorted(got) == list(range(n)) and [f.permute("t", n, y, True) for y in got] == list(range(n))
