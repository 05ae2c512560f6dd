import random

import corpus_pipeline
from stepweave.llm import lines

from . import brute
from .test_operators import ITEMS, TEXTS


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for i in range(60):
        lang = list(TEXTS)[i % 3]
        words = TEXTS[lang].split()
        rows.append((i, "\n".join(" ".join(r.choice(words) for _ in range(14)) + f" w{i}x{k} v{k}y{i * 7}" for k in range(6)), lang, f"s{i % 4}"))
    extra = [rows[0][1], rows[1][1].replace("w1x0", "changed"), None, "", "12 34", ITEMS[0][1], rows[2][1] + "\n" + rows[3][1].split("\n")[0]]
    rows += [(100 + i, t, None, "s1") for i, t in enumerate(extra)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = {x["doc_id"]: x for x in docs.collect()}
    text = lambda name: [(i, x["text"]) for i, x in seen[name].items()]
    assert {i for i, _, _, _ in rows} - set(seen["language"]) == {102, 103, 104}
    left = {i: t for i, t in brute.lines(text("language"), lines.SHORT).items() if brute.WORD.search(t)}
    assert {i: t for i, t in text("lines")} == left and 100 not in left
    assert all(x["n_chars"] == len(x["text"]) for x in seen["lines"].values())
    near = brute.near(text("lines"), 5)
    assert set(seen["near"]) == {i for i, (_, _, kept) in near.items() if kept}
    leaks = brute.leaks(text("near"), ITEMS)
    assert set(seen["benchmark"]) == {i for i, x in leaks.items() if not x[4]} and 105 not in seen["benchmark"]
    assert set(seen["mix"]) <= set(seen["benchmark"]) and all(0 < x["taken"] <= 2 * x["size"] for x in seen["mix"].values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["mix"])


def test_stages_keep_columns_of_any_name_and_rows_without_ids(spark, tmp_path):
    r = random.Random(3)
    words = TEXTS["en"].split()
    text = lambda i: " ".join(r.choice(words) for _ in range(30)) + "".join(f" own{i}x{k}" for k in range(25))
    same = text(99)
    rows = [(i, text(i), "en") for i in range(8)] + [(None, same, None), (None, same, None), (None, text(50), None), (3, text(51), "en"), (7, None, "en")]
    clash = ["score", "ambiguous", "lang_pred", "n_lines", "n_removed", "n_words", "spans", "items", "key_", "n_chars"]
    docs = spark.createDataFrame([(*x, "s", *[f"{k}/{c}" for c in clash[:-1]], 5) for k, x in enumerate(rows)], f"doc_id long, text string, lang string, source string, {', '.join(f'{c} string' for c in clash[:-1])}, n_chars int")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        got = out.collect()
        assert all(r[c] == f"{r['score'].split('/')[0]}/{c}" for r in got for c in clash[:-1]), name
        assert stage(spark, none, str(tmp_path)).count() == 0
        if name == "language":
            assert len(got) >= 10 and all(r["text"] for r in got)
        if name == "near":
            assert sorted(r["doc_id"] is None for r in got) == [False] * 10 + [True] * 2
            assert sum(r["text"] == same for r in got) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
