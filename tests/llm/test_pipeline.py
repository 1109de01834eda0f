"""Every stage of the pipeline against a plain version, on a small table with odd rows."""

from test_dedup_and_joins import plain_components, plain_groups
from test_tokens import check_packing

import corpus_pipeline
from sluice.llm import mixing, toxicity

ODD = [(9001, None, None, None), (9002, "", "en", "s"), (9003, "  ", "en", "s"), (None, "no id at all", "en", "s"), (9004, "same text here\n", "de", "t"), (9005, "same text here", "de", "t"), (9006, "a b c d e f g h i j k l", "fr", "u"), (9007, "a b c d e f g h i j k l m", "fr", "u")]


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.union(spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string"))
    docs = docs.selectExpr("*", "doc_id AS score", "1 AS _row", "'x' AS _drop")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns

    rows = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()), key=str)
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.toxicity(before, labels).where("predicted = 1").collect()}
    assert bad
    assert rows(after) == [x for x in rows(before) if x[0] not in bad]

    before, after = kept["exact_dedup"]
    best = [min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)) for own in plain_groups(rows(before)).values()]
    assert sorted(((i, t or "") for i, t in rows(after)), key=str) == sorted(best, key=str)

    before, after = kept["near_dedup"]
    component = plain_components(rows(before))
    assert rows(after) == [x for x in rows(before) if x[0] is None or component[x[0]][1] == x[0]]
    assert any(component[i][1] != i for i in component)

    before, after = kept["mixing"]
    chosen = {r["doc_id"] for r in mixing.mixed(before).where("_selected").collect()}
    assert rows(after) == [x for x in rows(before) if x[0] in chosen]

    before, after = kept["packing"]
    check_packing(after.collect(), rows(before), 2048)


def test_run_packs_what_all_stages_keep(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < out.select("doc_id").distinct().count() < spark.read.parquet(f"{tables}/documents.parquet").count()
