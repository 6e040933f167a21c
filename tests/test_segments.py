import random

import pytest

from keyloom.operators.segments import neighbour, running_sum
from pyspark.sql import Window, functions as F


def frame(spark):
    rng = random.Random(9)
    seqs = rng.sample(range(-50, 4000), 900)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), s, rng.choice([None, 1, 5, -2])) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "k string, q bigint, v bigint").withColumn("v2", F.lit("extra"))


@pytest.mark.parametrize("bits", [2, 6, 40])
def test_equal_to_plain_windows(spark, as_rows, bits):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("q")
    zero = F.lit(0).cast("bigint")
    for inclusive in (True, False):
        plain = df.withColumn("r", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)), zero))
        assert as_rows(running_sum(df, ["k"], "q", F.col("v"), "r", inclusive, bits)) == as_rows(plain)
    for ahead in (False, True):
        plain = df.withColumn("r", (F.lead if ahead else F.lag)("v").over(w))
        assert as_rows(neighbour(df, ["k"], "q", F.col("v"), "r", ahead, bits)) == as_rows(plain)
    assert running_sum(df.limit(0), ["k"], "q", F.col("v"), "r").count() == 0
