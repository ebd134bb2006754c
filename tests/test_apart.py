"""Cells far enough apart: the same as one by one, in rounds that do not grow with a chain along the rim."""

from rillwork.operators import vector


def one_by_one(cells, apart):
    taken = []
    for r, c, v in sorted(cells, key=lambda x: (-x[2], x[0], x[1])):
        if all((r - a) ** 2 + (c - b) ** 2 >= apart**2 for a, b, _ in taken):
            taken.append((r, c, v))
    return sorted(taken)


def test_chain_in_few_rounds(spark, monkeypatch):
    calls, plain = [], vector.written
    monkeypatch.setattr(vector, "written", lambda df, *by: calls.append(1) or plain(df, *by))
    cells = [(0, c, float(c)) for c in range(800)]  # each cell waits for its right neighbour
    got = vector.all_apart(spark.createDataFrame(cells, "r int, c int, v double"), "v", 20.0)
    assert sorted(map(tuple, got.collect())) == one_by_one(cells, 20.0)
    assert len(calls) <= 4


def test_chains_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector, "APART_TILE", 16)
    cells = [(r, c, float((r * 31 + c * 17) % 23 if r % 2 else r + c)) for r in range(40) for c in range(40) if (r * c) % 3]
    got = vector.all_apart(spark.createDataFrame(cells, "r int, c int, v double"), "v", 7.5)
    assert sorted(map(tuple, got.collect())) == one_by_one(cells, 7.5)
