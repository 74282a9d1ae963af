"""The corpus pipeline: five stages from documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage as Parquet and rereads it as
the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinetra.llm.common import shared_folder
from kinetra.llm.decontaminate import clean_stage
from kinetra.llm.language import language_stage
from kinetra.llm.mixing import mix_stage
from kinetra.llm.simhash import keep_one
from kinetra.llm.suffix import suffix_stage

STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", keep_one),
    ("suffix_dedup", suffix_stage),
    ("decontamination", clean_stage),
    ("mixing", mix_stage),
]

#: The suffix and language stages are beyond SQL; tests/llm holds run() against a brute-force version of all five.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table stays in the shared folder, where a lost executor finds it again.

    Rows may have null or repeated ids, null, empty or very long texts and columns of any name; each stage says what
    becomes of them. No documents give no rows.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
