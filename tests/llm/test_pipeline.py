"""The pipeline's stages one after the other, each against what its operator says of the same rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from kinetra.llm import decontaminate, language, mixing, simhash, suffix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns[: len(steps[0].columns)] == steps[0].columns


def test_stages_follow_their_operators(spark, steps):
    docs, told, single, cut, clean, mixed = steps
    assert ids(told) == ids(language.identify(docs).where("lang_pred <> 'und' and score >= 0.5"))
    groups = simhash.simhash_groups(told)
    assert ids(single) == sorted(r[0] for r in groups.groupBy("component_id").agg(F.min("doc_id")).select("component_id").collect())
    lost = suffix.suffix_dedup(single)
    assert ids(cut) == ids(lost.where("n_removed < n_bytes or n_bytes = 0"))
    touched = {r.doc_id: r.n_bytes - r.n_removed for r in lost.where("n_removed > 0 and n_removed < n_bytes").collect()}
    assert all(len(r.text.encode()) <= touched.get(r.doc_id, len(r.text.encode())) for r in cut.select("doc_id", "text").collect())
    found = {r.doc_id for r in decontaminate.contaminated(cut, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(clean) == [i for i in ids(cut) if i not in found]
    assert ids(mixed) == ids(mixing.mix(clean).where("taken > 0"))
