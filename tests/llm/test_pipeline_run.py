def test_run_equals_its_stages_and_leaves_no_intermediate_tables(spark, small, tmp_path):
    import os

    import corpus_pipeline as p

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = sorted(map(tuple, p.run(spark, small).collect()), key=str)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert got and left <= {"mixing", "token-store"}, left
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, apply in p.STAGES:
        docs = p.stage(apply(spark, docs, small), name)
    assert sorted(map(tuple, docs.collect()), key=str) == got
