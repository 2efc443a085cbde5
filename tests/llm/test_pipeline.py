"""The pipeline's stages take effect and pass the columns on."""

import pytest

import corpus_pipeline
from poolwright.llm.queries import QUERIES
from poolwright.llm.stage import materialize, purge, stage_root

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = materialize(spark.read.parquet(f"{SF}/documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(stages):
    assert [s[0] for s in stages] == ["language_id", "near_duplicates", "decontamination", "secret_scans", "mixing_sources"]
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema == before.schema, name
        assert ids(after) <= ids(before)
    (_, _, lang), (_, _, near), (_, _, clean), (_, _, bare), (_, _, mixed) = stages
    assert len(ids(near)) < len(ids(lang)) and ids(bare) == ids(clean)
    assert ids(mixed) < ids(bare) and "probability" in mixed.columns


def test_effects(stages, spark):
    from poolwright.llm import decontaminate, neardup, secrets

    near = neardup.near_duplicates(stages[1][2], percent=80)
    assert near.where("not kept").count() == 0
    assert decontaminate.find_leaks(stages[2][2], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert secrets.digest(stages[3][2]).where("spans <> ''").count() == 0


def test_run_and_purge(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert "/stages-" in stage_root(spark)
    purge(spark)


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("which", ["messy", "empty"])
def test_stages_on_odd_tables(spark, which, request, tmp_path):
    """Nulls in every column, repeated rows, very long texts; and no row at all."""
    docs = request.getfixturevalue(which)
    spark.createDataFrame([(1, None), (None, "a b c"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, str(tmp_path)))
        if name != "mixing_sources":
            assert after.columns == docs.columns, name
        sizes.append(after.count())
        docs = after
    if which == "empty":
        assert sizes == [0] * 5
    else:
        assert sizes[0] > sizes[1] > 0 and sizes[2] == sizes[3]
