"""What the findings of round 3 asked for."""

import random

from quillstream.operators import intervals, shared


def test_budget_parts_double_few_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(u, k, float(k), rng.choice([0, 0, 1, 2, 5, 30])) for u, n in ((1, 400), (2, 1), (None, 150)) for k in range(n)]
    want = {}
    for u in (1, 2, None):
        part = used = 0
        for _, k, _, size in (r for r in rows if r[0] == u):
            if used and used + size > 20:
                part, used = part + 1, 0
            used += size
            want[u, k] = part
    held, plain = [], shared.durable

    def durable(df):
        out = plain(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(intervals, "HOPS", 32, raising=False)
    monkeypatch.setattr(shared, "durable", durable)
    df = spark.createDataFrame(rows, "u int, k int, at double, size int").repartition(3)
    got = {(r.u, r.k): r.part for r in intervals.budget_parts(df, ["u"], "at", 25.0, ["at", "k"], "size", 20).collect()}
    assert got == want
    # the sums, the jumps (twice) and the starts; what is doubled beside them is few
    assert sum(held) < 6 * len(rows), held
