"""Queries p7_ to p9_: the text problems of TESTDATA.md over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloom.llm import leakage, packing, subjects
from keyloom.session import table


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p7_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, d), table(spark, d, "pack_specs"))


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    """What no packing may have: all documents are there, and nothing is overfull, torn, out of order or left over."""
    return packing.faults(p7_pack(spark, d), table(spark, d, "pack_specs"))


def p7_packers_compared(spark: SparkSession, d: str) -> DataFrame:
    """What splitting the work costs: containers by one packer for each 100,000 documents and by eight times as many."""
    documents, specs = table(spark, d, "documents"), table(spark, d, "pack_specs")
    n = documents.count()
    few = packing.fill_report(packing.pack(documents, specs), specs).select("spec_id", "least_containers", F.col("containers").alias("containers"))
    each = max(1, -(-n // (8 * max(1, -(-n // packing.GROUP_ITEMS)))))
    many = packing.fill_report(packing.pack(documents, specs, group_items=each), specs).select("spec_id", F.col("containers").alias("containers_of_many"))
    return few.join(many, "spec_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item: in how many documents, and how far question and answer leak too."""
    return _leaks(spark, d).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.max("score").alias("best_score"), F.count_if("prompt_overlap").alias("with_prompt"), F.count_if("answer_overlap").alias("with_answer")
    )


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = subjects.train(documents, table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))
    return subjects.subjects_of(documents, model)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Posts and expected posts per subject."""
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("posts"), F.round(F.sum("probability"), 3).alias("expected_posts"))


QUERIES = {
    "p7_pack": p7_pack,
    "p7_fill_report": p7_fill_report,
    "p7_faults": p7_faults,
    "p7_packers_compared": p7_packers_compared,
    "p8_found": p8_found,
    "p8_leaked_items": p8_leaked_items,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

#: SQL states what holds of any packing.  Neither rendered words nor a trained model can be put into SQL.
SQL: dict[str, str] = {"p7_faults": "select spec_id, count(*) as documents, 0 as overfull, 0 as torn, 0 as gaps, 0 as unplaced from pack_specs, documents where capacity_tokens > 0 group by spec_id"}
