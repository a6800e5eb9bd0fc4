"""Results that a cut form of an operator would not give."""

import pytest

from tidewright.operators import factor


@pytest.mark.parametrize("bucket_rows", [10_000, 5])
def test_all_draws_are_made(spark, monkeypatch, bucket_rows):
    """A row with a third of the squared norm gets about a third of the draws, and draws are exactly ``c``."""
    monkeypatch.setattr(factor, "BUCKET_ROWS", bucket_rows)
    rows = spark.createDataFrame([(0, [10.0, 0.0])] + [(i, [0.0, 2.0]) for i in range(1, 51)] + [(51, [0.0, 0.0])], "id long, x array<double>")
    for c in (1, 40, 400):
        copies = {r["id"]: r["copies"] for r in factor.cur_columns(rows, c).collect()}
        assert sum(copies.values()) == c and 51 not in copies
    assert 100 <= copies[0] <= 167
    assert factor.cur_columns(rows.where("id = 51"), 40).count() == 0
