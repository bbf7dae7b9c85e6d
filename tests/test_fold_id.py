"""fold_id on whole texts."""

import re

from lexmill.functions import text as T
from lexmill.plans import texts


def test_whole_texts_are_folded(spark):
    rows = [(1, "Điều 1 " + "x y " * 100 + "Tail"), (2, "__A  b__"), (3, None), (4, "")]

    class Tables:
        documents = spark.createDataFrame(rows, "doc_id long, text string")

    table = str.maketrans(T.ACCENTED, T.PLAIN)
    want = {i: t and re.sub("_+", "_", re.sub("[^a-z0-9_]", "_", t.translate(table).lower())).strip("_") for i, t in rows}
    got = {r.doc_id: r.folded for r in texts.fold_id(Tables()).collect()}
    assert got == want and got[1].endswith("_tail")
