"""The five stages against their operators' brute-force versions, in small."""

import corpus_pipeline
from fixtures import rows, table
from test_decontaminate import brute as bench_brute
from test_simhash import one_of_each

from cabgrid.llm.common import written


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    items = [(1, rows()[60][1]), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark)
    columns, data = docs.columns, [tuple(r) for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)), name)
        got = [tuple(r) for r in out.select(*columns).collect()]
        assert out.columns == columns + (["shard", "slot"] if name == "shard" else [])
        if name == "language":
            assert set(got) <= set(data) and not any(r[1] in (None, "") for r in got)
            assert {r for r in data if r[1] and len(r[1].split()) > 50} <= set(got)
        elif name == "near_duplicates":
            one_of_each(got, data)
            assert {tuple(r) for r in got} <= {tuple(r) for r in data}
        elif name == "decontaminate":
            want = sorted((d for d, b in zip(data, bench_brute(data, items)) if not b[5]), key=str)
            assert sorted(got, key=str) == want
        elif name == "mix":
            assert set(got) <= set(data) and all(got.count(r) <= 2 for r in got)
        else:
            assert sorted(got, key=str) == sorted(data, key=str)
        docs, data = out, got


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
    assert docs.count() == 0


def test_run_gives_every_row_a_place(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    sizes = [sum(r.shard == s for r in got) for s in range(corpus_pipeline.SHARDS)]
    assert got and max(sizes) - min(sizes) <= 1
