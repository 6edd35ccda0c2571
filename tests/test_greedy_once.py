"""Greedy matching reads its edges once and passes a long chain in order."""

from findlake.operators import lookups


def test_edges_are_computed_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch

    n = 40  # a chain of rising scores, of which a round settles one edge
    edges = [(k, k + 1000, 0.5 + k / 1000, True) for k in range(n)] + [(k, k + 999, 0.4 + k / 1000, True) for k in range(1, n)]
    given = spark.createDataFrame(edges, "old_path long, new_path long, score double, edited boolean").mapInPandas(seen, "old_path long, new_path long, score double, edited boolean")
    found = lookups.greedy_match(given).collect()
    assert {(r.old_path, r.new_path) for r in found} == {(k, k + 1000) for k in range(n)}
    assert rows.value == len(edges)
