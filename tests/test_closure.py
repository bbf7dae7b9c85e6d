"""Paths of any length over structure edges, against a search node by node."""

import random

import pytest

from lexmill.operators.graph_query import closure


def brute(edges, starts, steps, own):
    out = set()
    for a in starts:
        seen, at = ({a} if own else set()), {a}
        for _ in range(steps if steps is not None else 10**6):
            at = {d for s, d in edges if s in at} - seen
            if not at:
                break
            seen |= at
        out |= {(a, n) for n in seen}
    return sorted(out)


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("steps", [0, 1, 4, None])
def test_as_a_search(spark, steps, own):
    rng = random.Random(9)
    edges = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(30)} | {(f"c{i}", f"c{(i + 1) % 6}") for i in range(6)} | {(f"p{i}", f"p{i + 1}") for i in range(9)} | {("s", "s")}
    starts = ["n1", "n2", "c0", "p0", "s", "alone"]
    rows = spark.createDataFrame([(a, "CO_KHOAN" if i % 2 else "CO_DIEM", b) for i, (a, b) in enumerate(sorted(edges))] + [("p0", "THAM_CHIEU", "other")], "src string, rel string, dst string")
    got = closure(rows, spark.createDataFrame([(a,) for a in starts + ["n1"]], "article_id string"), steps, own=own)
    assert sorted(map(tuple, got.collect())) == brute(edges, starts, steps, own)
