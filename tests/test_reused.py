"""A plan that has the same rows twice and takes the second from the first."""

from corpusmill import registry


def test_candidates_meet_themselves(spark):
    """Each fused hit is found again, with the score of both its lists."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        c = registry.retrieval._candidates(spark, "/root/testdata/sf0.001").select("query_id", "chunk_id", "score")
        assert c.join(c, ["query_id", "chunk_id", "score"], "left_anti").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
