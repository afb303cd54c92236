"""A run's report rounds numbers by their exact value, as printf and the SQL do."""

from corpusmill.sources import corpus


def test_halves(spark):
    rows = [("p", "a", 1, 3, 0.0005, 0.0125, 2.5), ("p", "b", 2, 3, 0.0015, 0.0120, 5.0), ("p", "c", 3, 3, None, 0.0005, 0.5), ("q", "a", 1, 1, 0.0045, 0.0, 48.5)]
    m = spark.createDataFrame([(*r, True) for r in rows], "product_id string, mode string, place int, n long, recall double, ndcg double, avg_latency_ms double, passed boolean")
    got = {r.product_id: r.text for r in corpus.run_report(m).collect()}
    show = lambda v, spec: "—" if v is None else format(v, spec)
    for p, mode, _, _, recall, ndcg, ms in rows:
        assert f"| {mode} | {show(recall, '.3f')} | {show(ndcg, '.3f')} | {show(ms, '.0f')}ms |" in got[p]
    assert "| a | 0.001 | " in got["p"]
    for _, mode, _, _, recall, ndcg, ms in rows[1:3]:
        parts = [] if recall is None else [f"recall {recall - 0.0005:+.3f}"]
        assert f"- `{mode}` vs `a`: {', '.join([*parts, f'ndcg {ndcg - 0.0125:+.3f}', f'latency {ms - 2.5:+.0f}ms'])}" in got["p"]
