"""The pipeline, stage by stage, on the small documents."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from chronoloom.llm import queries as q

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(pipeline.COLUMNS).collect()), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    repeated = docs.union(docs.limit(7)).union(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "x", 0)], docs.schema))
    kept = {(r["track_id"]) for r in pipeline.judge_lyrics(q.as_tracks(repeated, F.expr(pipeline.KEY))).filter("kept").collect()}
    key = repeated.select(F.expr(pipeline.KEY).alias("key"), *pipeline.COLUMNS).collect()
    after = pipeline.quality_rules(spark, repeated, SF)
    assert rows(after) == sorted((tuple(r[1:]) for r in key if r["key"] in kept), key=str)
    judged = pipeline.quality_classifier(spark, after, SF)
    assert set(rows(judged)) <= set(rows(after)) and judged.count() > 0.8 * after.count()
    single = pipeline.simhash_near_dedup(spark, repeated, SF)
    groups = q.near_copies(q.as_tracks(repeated, F.expr(pipeline.KEY))).collect()
    assert single.count() == len({r["component_id"] for r in groups})
    mixed = pipeline.mixing(spark, judged, SF)
    assert mixed.columns == pipeline.COLUMNS and set(rows(mixed)) <= set(rows(judged))
    assert abs(mixed.selectExpr("sum(n_chars)").first()[0] / judged.selectExpr("sum(n_chars)").first()[0] - 1) < 0.3
    nothing = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def test_run(spark):
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "quality classifier", "simhash near-dedup", "mixing", "packing"]
    packed = pipeline.run(spark, SF).collect()
    assert packed and max(p["offset"] + p["length"] for p in packed) <= 4096


def test_url_twin(spark):
    import check

    con = check.connect(SF)
    _, n, problem = check.compare(spark, con, SF, "op2", q.op2_url_filters, q.OP2_SQL)
    assert problem is None and n
