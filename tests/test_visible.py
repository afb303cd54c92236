"""What users see is counted from products' counts: as many as by meeting every proposal, null keys and users of several products too."""

from pyspark.sql import functions as F

from corpusmill.operators import lifecycle


def test_counts_without_pairs(spark):
    p = spark.createDataFrame([(i, None if i % 10 == 0 else f"p{i % 3}", "pending" if i % 2 else "done") for i in range(60)], "id int, product_id string, status string")
    m = spark.createDataFrame([("a", "p0"), ("a", "p0"), ("a", "p1"), ("b", "p2"), ("c", None), ("d", "p9"), (None, "p1")], "user_id string, product_id string")
    for status in (None, "pending"):
        want = lifecycle.visible(p, m, status).groupBy("user_id").agg(F.count("*").alias("n"))
        assert sorted(map(repr, lifecycle.visible_counts(p, m, status).collect())) == sorted(map(repr, want.collect())) != []
