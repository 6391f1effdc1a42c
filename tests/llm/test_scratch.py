"""Tables of intermediate results don't outlive the stage that wrote them."""

from pathlib import Path

import corpus_pipeline
from verbaloom.llm import near_copies
from verbaloom.storage import materialize, scratch, shared_dir

SF = "/root/testdata/sf0.001"


def written(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}


def test_only_what_is_kept_stays(spark):
    before = written(spark)
    with scratch(spark) as outer:
        with scratch(spark) as keep:
            materialize(spark.range(3), "gone")
            a = keep(materialize(spark.range(4), "inner"))
            b = keep(materialize(spark.range(5), "inner-too"))
        outer(a)
        assert sorted(x.rsplit("-", 1)[0] for x in written(spark) - before) == ["inner", "inner-too"] and b.count() == 5
    assert [x.rsplit("-", 1)[0] for x in written(spark) - before] == ["inner"] and a.count() == 4


def test_near_duplicates_leave_their_result(spark):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), written(spark)
    found = near_copies.near_components(docs)
    left = {x.rsplit("-", 1)[0] for x in written(spark) - before}
    assert left <= {"shingle-sets", "class-components", "hot-keys"} and found.count() == docs.count()


def test_pipeline_leaves_one_stage(spark):
    before = written(spark)
    out = corpus_pipeline.run(spark, SF)
    left = {x.rsplit("-", 1)[0] for x in written(spark) - before}
    assert {x for x in left if x.startswith("stage-")} == {"stage-pii"} and not left & {"shingles", "classes", "near-candidates"} and out.count() > 100
