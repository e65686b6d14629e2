import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    import random

    from tests.llm.test_documents import prose, toxic_corpus

    rng = random.Random(11)
    rows, labels = toxic_corpus()
    item = prose(rng, 30, 9000)
    clean = prose(rng, 120, 9000)
    rows += [(1000, clean), (1001, clean), (1002, clean + " more"), (1003, "before " + item + " after"), (1004, clean[:200] + " token = abcdefghijklmnop"), (1005, None), (1006, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'kept' AS score", "doc_id AS secrets", "'kept' AS grp", "1 AS n_words")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = docs, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r for r in at.collect()}
        if k < len(pipeline.STAGES) - 1:
            assert at.columns == docs.columns and {r.score for r in seen[name].values()} == {"kept"} and all(r.secrets == d for d, r in seen[name].items())
    toxic = {d for d, t in labels if t}
    assert len(toxic & seen["toxicity"].keys()) <= 5 and len(seen["toxicity"]) > 300
    assert {1000, 1001, 1002} & seen["ngram_jaccard"].keys() == {1000} and {1003, 1004, 1005, 1006} <= seen["ngram_jaccard"].keys()
    assert seen["ngram_jaccard"].keys() - seen["decontamination"].keys() == {1003}
    redacted = seen["secrets"][1004]
    assert redacted.text.endswith(" [SECRET]") and redacted.n_chars == len(redacted.text)
    assert seen["packing"].keys() == seen["secrets"].keys()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t)) for d, t in rows], SCHEMA)


def test_one_row_of_each_group(spark):
    """Rows are told apart by id and text: an id on several texts, identical rows, nulls and texts without words."""
    from gridlake.llm import stages

    a, b, c = "one two three four five six seven", "another text of its own with several words", "third text, quite unlike the other two texts"
    rows = [(1, a), (2, a), (2, b), (4, c), (4, c), (None, a), (None, a), (7, None), (7, None), (8, ""), (8, " ")]
    got = stages.keep_one_of_each_group(spark, _frame(spark, rows), "")
    assert sorted((r.doc_id or 0, r.text or "-") for r in got.collect()) == sorted([(0, a), (0, a), (1, a), (2, b), (4, c), (7, "-"), (7, "-"), (8, "-"), (8, " ")])
    assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]


def test_stages_on_empty_tables_and_very_long_texts(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(1, "word " * 30_000), (2, "y" * 100_000), (3, None)]):
        docs = _frame(spark, rows)
        for _, stage in pipeline.STAGES:
            found = stage(spark, docs, str(tmp_path))
            docs = spark.createDataFrame(found.collect(), found.schema)
        assert {r.doc_id for r in docs.collect()} == {d for d, _ in rows}


def test_the_pipeline_equals_stage_by_stage_brute_force(spark, tmp_path):
    """Each stage's result on what the one before kept, against plain Python; of the toxicity stage, its own scores decide."""
    import random

    from gridlake.llm import packing, toxicity
    from tests.llm.test_documents import brute_components, brute_hits, brute_spans, prose, toxic_corpus

    rng = random.Random(21)
    rows, labels = toxic_corpus()
    rows, items = rows[:150], [(k, prose(rng, 14, 9000)) for k in range(3)]
    for d in range(200, 260):
        text = rng.choice(rows)[1] if d % 3 else prose(rng, 40, 9000) + " " + items[d % 3][1]
        rows.append((d, text + (" password: abcdefghijklmnop0" if d % 4 == 0 else "")))
    _frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()

    scored = toxicity.digest(_frame(spark, rows), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    fine = {r.doc_id for r in scored if not r.predicted}
    kept = [r for r in rows if r[0] in fine]
    kept = [(d, t) for (d, t), (_, of, _, root) in zip(sorted(kept), brute_components(kept)) if of == root]
    kept = [(d, t) for (d, t), hit in zip(sorted(kept), brute_hits(kept, items)) if not hit[-1]]
    assert 0 < len(kept) < len(fine)
    ids = packing.word_ids(packing.default_tokenizer())
    want = {}
    for d, t in kept:
        clean, at = "", 0
        for a, _, b, _ in brute_spans(t):
            clean, at = (clean + t[at:a] + "[SECRET]" if a >= at else clean), max(at, b)
        want[d] = len(ids.ids((clean + t[at:]).encode())) // 4 + 1
    assert {r.doc_id: r.doc_tokens for r in got} == want
