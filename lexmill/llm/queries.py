"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.ann import op7_nearest
from lexmill.llm.ballkmeans import op12_ball_kmeans, op12_sql
from lexmill.llm.collocations import op11_collocations, op11_sql
from lexmill.llm.common import table
from lexmill.llm.decontaminate import op8_decontamination
from lexmill.llm.jaccard import OP9_SQL, op9_ngram_jaccard
from lexmill.llm.langid import op1_language_id
from lexmill.llm.licenses import op10_license_scans, op10_sql
from lexmill.llm.packing import op6_packing
from lexmill.llm.quality import op13_quality_rules, op13_sql
from lexmill.llm.secrets import op4_secret_scans
from lexmill.llm.sharding import op5_sharding, op5_sql
from lexmill.llm.toxicity import op3_toxicity
from lexmill.llm.warc import OP2_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on = lambda f, name: lambda spark, sf_dir: f(table(spark, sf_dir, name))
    return {
        "op1_language_id": on(op1_language_id, "documents"),
        "op2_warc": on(op2_warc, "pages"),
        "op3_toxicity": lambda spark, sf_dir: op3_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op4_secret_scans": on(op4_secret_scans, "documents"),
        "op5_sharding": on(op5_sharding, "documents"),
        "op6_packing": on(op6_packing, "documents"),
        "op7_nearest": on(op7_nearest, "embeddings"),
        "op8_decontamination": lambda spark, sf_dir: op8_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op9_ngram_jaccard": on(op9_ngram_jaccard, "documents"),
        "op10_license_scans": on(op10_license_scans, "documents"),
        "op11_collocations": on(op11_collocations, "documents"),
        "op12_ball_kmeans": on(op12_ball_kmeans, "embeddings"),
        "op13_quality_rules": on(op13_quality_rules, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op5_sharding": op5_sql(), "op9_ngram_jaccard": OP9_SQL, "op10_license_scans": op10_sql(), "op11_collocations": op11_sql(), "op12_ball_kmeans": op12_sql(), "op13_quality_rules": op13_sql()}
