import corpus_pipeline
from signalspark.llm import decontamination, packing, simhash, toxicity

from .test_dedup import brute_lines


def test_stages_are_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns
            now = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "toxicity":
            assert now == {d: t for d, t in before.items() if model.score(t) < 0.5}
        elif name == "line dedup":
            gone = brute_lines(sorted(before.items()))
            assert now == {d: "\n".join(s for k, s in enumerate(t.split("\n")) if k not in set(gone[d])) for d, t in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif name == "near dedup":
            sets = {d: simhash._shingles(t, 5) for d, t in before.items()}
            for d in before.keys() - now.keys():
                assert any(e < d and (not x | y or len(x & y) >= 0.8 * len(x | y)) or e > d and len(x & y) >= 0.8 * len(x | y) for e in before if e != d for x, y in [(sets[d], sets[e])])
        elif name == "decontamination":
            hits = {r["doc_id"] for r in decontamination.contained_items(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert now == {d: t for d, t in before.items() if d not in hits}
        else:
            pieces = [r.asDict() | {"ids_crc32": packing.zlib.crc32(r["token_ids"])} for r in after.collect()]
            assert packing.faults(sorted(before.items()), pieces, packing.tokenizer_path()) == []
        kept.append(after.count())
        docs = after
    assert corpus_pipeline.run(spark, sf).count() == kept[-1]


def written(spark, folder, rows, schema):
    """A folder of tables: documents of odd rows, and labels and benchmark of their own."""
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_run_of_odd_rows(spark, tmp_path):
    long = " ".join(f"long{i}" for i in range(60_000))
    texts = [None, "", " \n\t", "word", "Word", "menu of five plain words\n" * 3, "a text of its own with words enough to stand " * 9, long, "x one two three four five six seven eight nine ten y", "É ß \U0001f600"]
    rows = [(i, t, None, None, None if t is None else len(t), "clash", 1.5, 7) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "without an id", "en", "s", 13, None, None, None), (50, texts[6], None, None, None, "c", 0.0, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, version int"
    docs = written(spark, str(tmp_path), rows, schema)
    assert docs.count() == 14
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    kept = {p["doc_id"] for p in pieces}
    assert kept <= {*range(10), 50, None} and 50 not in kept and 8 not in kept and 7 in kept
    whole = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    for d in kept - {6, None}:
        mine = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == d)
        assert sum(n for _, n in mine) == whole[d] and [a for a, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))]


def test_run_of_an_empty_table(spark, tmp_path):
    written(spark, str(tmp_path), [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_keeps_one_of_each_exact_group(spark, sf):
    from .test_dedup import exact_groups

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    groups = exact_groups(rows)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(groups.values()))
