"""Every stage keeps columns of any name as they are, and the mixing stage draws without texts."""

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from kinetra.llm import mixing
from kinetra.llm.queries import MIXING_SQL

SF = "/root/testdata/sf0.001"
NAMES = ["_p", "_bucket", "_bits", "_may", "_id", "_h", "row", "i", "h", "id", "fp", "copies", "before", "asked", "spans", "key", "words", "_TEXT", "no de", "piece0"]


@pytest.fixture(scope="module")
def wide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.select("*", *[F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")).alias(c) for k, c in enumerate(NAMES)]).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_columns_of_any_name_pass_through(spark, wide, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got, plain = stage(spark, wide, SF), stage(spark, wide.drop(*NAMES), SF)
    assert got.columns[: len(wide.columns)] == wide.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.select("doc_id").collect())
    assert all(r[c] == f"{k}:{r.doc_id}" for r in rows for k, c in enumerate(NAMES))


def test_no_text_meets_the_drawing_windows(spark, wide):
    plan = mixing.mix_stage(spark, wide, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan  # the draw is done, in tables of ids and sizes, before texts are joined


def test_rows_that_share_an_id_or_are_equal(spark):
    rows = [(1, "a b c " * 30, "s"), (1, "d e f " * 30, "s"), (2, "g h " * 40, "s"), (None, "k l " * 50, "s"), (None, "m n " * 50, "t"), (None, "k l " * 50, "s"), (3, None, "s"), (4, "o p " * 90, None)]
    rows += [(5, "same words here " * 20, "t")] * 40 + [(6, "one", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    key = lambda r: (r.doc_id, r.text, r.source, r.size, r.taken)
    got = Counter(map(key, mixing.mix_stage(spark, df.repartition(3), "").collect()))
    assert got == Counter(map(key, mixing.mix_stage(spark, df.repartition(2), "").collect()))
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", rows)
    want = Counter((i, n, k) for i, n, _, _, k in db.sql(MIXING_SQL).fetchall() if k > 0)
    assert Counter(x for k, n in got.items() for x in [(k[0], k[3], k[4])] * n) == want
    assert mixing.mix_stage(spark, df.limit(0), "").columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
