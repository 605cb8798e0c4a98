"""The pipeline over a small corpus with planted cases: toxic texts, shared passages, copies and test items."""

import random

import corpus_pipeline
from test_operators import prose


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    r = random.Random(3)
    passage = prose(60, 9001)
    items = [(i, prose(30, 8000 + i)) for i in range(5)]
    docs, marks = [], []
    for i in range(240):
        text = prose(80, 100 + i) + "\n" + prose(40, 1900 + i)
        if i % 6 == 0:
            text += " vileword" + r.choice(["", "s"]) + " vilewording"
        docs.append((i, text))
        marks.append((i, 1, int(i % 6 == 0)))
    plant = {241: docs[7][1], 242: "changed " + docs[8][1].split(" ", 1)[1] + " extra", 243: prose(70, 1) + "\n" + passage, 244: prose(70, 2) + "\n" + passage, 245: prose(40, 3) + " " + items[2][1] + " " + prose(40, 4)}
    docs += list(plant.items())
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        seen[name] = {x.doc_id: x for x in now.collect()}
        if name != "byte_bpe":
            assert now.columns == before.columns
    clean = {i for i in range(240) if i % 6} | {243}
    assert all(clean <= set(rows) for rows in seen.values())
    assert not {i for i in range(0, 240, 6)} & set(seen["toxicity"])
    assert 241 not in seen["line_dedup"] and passage in seen["line_dedup"][243].text and passage not in seen["line_dedup"][244].text
    assert seen["line_dedup"][244].n_chars == len(seen["line_dedup"][244].text)
    assert 242 in seen["line_dedup"] and 242 not in seen["near_dedup"]
    assert 245 in seen["near_dedup"] and 245 not in seen["decontamination"]
    final = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == set(seen["byte_bpe"]) and all(x.n_tokens > 0 for x in final.values())


def edge_tables(spark, path, rows):
    extra = "n_lines string, n_deleted string, `_id` string, `key` string, `row` string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e") for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 8001)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_on_edge_rows(spark, tmp_path):
    """Nulls in any column, blank and very long texts, ties, repeated rows, clashing names."""
    long = prose(30_000, 1)
    rows = [(1, prose(80, 2)), (2, prose(80, 2)), (3, None), (4, ""), (5, " \n "), (6, "one"), (7, long), (8, "É" * 5000), (9, prose(20, 3)), (9, prose(20, 3)), (None, prose(20, 4)), (None, None), (10, prose(20, 5) + " " + prose(30, 8001))]
    edge_tables(spark, tmp_path, rows)
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert now.columns == before.columns and {tuple(r)[5:] for r in now.collect()} == {("a", "b", "c", "d", "e")}
    got = now.collect()
    ids = sorted((r.doc_id for r in got if r.doc_id is not None))
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9] and sum(r.doc_id is None for r in got) == 2
    tokens = {r.doc_id: r.n_tokens for r in got if r.doc_id is not None}
    assert tokens[3] == tokens[4] == 0 and all(tokens[i] > 0 for i in (1, 5, 6, 7, 8, 9))


def test_stages_on_an_empty_table(spark, tmp_path):
    edge_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
