import random

from pyspark.sql import functions as F

import corpus_pipeline

from .test_text_operators import DE, EN, brute_components, texts_of


def test_stages_against_plain_versions(spark, tmp_path):
    r = random.Random(1)
    words = [f"{a}{b}" for a in EN for b in EN]
    clean = texts_of(words, 120, 11) + texts_of([f"{a}{b}" for a in DE for b in DE], 60, 12)
    rows = [(i, t, "en" if i < 120 else "de", "hot" if i % 3 else f"s{i % 4}") for i, t in enumerate(clean)]
    rows += [(1000 + i, " ".join(f"{w}###" for w in t.split()), "en", "s1") for i, t in enumerate(texts_of(words, 60, 13))]
    rows += [(2000 + i, clean[i], "en", "s2") for i in range(20)]
    rows += [(3000, None, "en", "s0"), (3001, "", None, None), (3002, "12 34", "en", "s0")]
    r.shuffle(rows)
    d = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if 1000 <= i < 2000 else 1) for i, *_ in rows if i < 2000], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([x.doc_id for x in docs.select("doc_id").collect()])
    ids = {i for i, *_ in rows}
    assert set(kept[0]) == ids - {3000, 3001, 3002}
    assert {i for i in kept[0] if i < 1000 or i >= 2000} <= set(kept[1]) and not any(1000 <= i < 2000 for i in kept[1])
    _, comp = brute_components([(i, t) for i, t, *_ in rows if i in set(kept[1])])
    assert sorted(kept[2]) == sorted({c for c in comp.values()})
    assert set(kept[3]) == set(kept[2]) and max(map(kept[3].count, set(kept[3]))) <= 2 and len(kept[3]) > len(kept[2])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(kept[4]) == sorted(x.doc_id for x in whole.select("doc_id").collect())
    assert whole.where(F.col("offset") + F.col("length") > 2048).count() == 0


def test_copies_keep_one_row_of_a_group(spark):
    a, b, c, d = texts_of([f"{x}{y}" for x in EN for y in EN], 4, 21)
    long = " ".join(EN * 3)
    rows = [(None, a), (None, b), (1, c), (1, c), (2, long), (3, d), (3, long + " x"), (None, c), (4, None), (None, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.copies_stage(spark, docs, "").collect()]
    exp = [(None, a), (None, b), (1, c), (2, long), (3, d), (4, None), (None, ""), (4, None)]
    assert sorted(got, key=str) == sorted(exp, key=str)


def test_copies_are_taken_out_without_a_shuffle_of_the_texts(spark):
    a, b, c, d = texts_of([f"{x}{y}" for x in EN for y in EN], 4, 22)
    docs = spark.createDataFrame([(1, a), (2, b), (3, c), (4, d), (5, a), (6, b), (2, b), (7, None)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = corpus_pipeline.copies_stage(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        assert sorted(out.collect(), key=str) == sorted([(1, a), (2, b), (3, c), (4, d), (7, None)], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stages_without_labels_keep_clean_documents(spark, tmp_path):
    texts = texts_of(EN, 6, 3)
    docs = spark.createDataFrame([*((i, t, None) for i, t in enumerate(texts)), (90, None, None), (91, "12 34", None)], "doc_id long, text string, lang string")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(6)) and got.columns == docs.columns
    assert sorted(r.doc_id for r in corpus_pipeline.quality_stage(spark, got, str(tmp_path)).collect()) == list(range(6))


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    texts = texts_of([f"{a}{b}" for a in EN for b in EN], 40, 31)
    extra = ["_p", "_known", "_quality", "_at", "_mix", "mix_rank", "_row", "lang_pred", "score", "component_id"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", *(f"{c}{i}" for c in extra)) for i, t in enumerate(texts)], schema)
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        rows = got.collect()
        assert {r.doc_id for r in rows} == set(range(40)), name
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra), name
    empty = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
