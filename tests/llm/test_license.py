import re
from collections import Counter

from lexmill.llm.license_rules import rules
from lexmill.llm.license_scan import TRIGGERS, detections, license_scan, suppressed


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    pos = [i for i, _ in at]
    return len(w), len(at), min(pos, default=None), max(pos, default=None), ",".join(sorted({x for _, x in at}))


def test_base_as_brute_force(spark):
    docs = [(1, "Licensed under CC BY-NC 4.0."), (2, "All Rights\nreserved, all rights, reserved ball rights reserved"), (3, None), (4, ""), (5, "écc by cc  by cc-by"), (None, "GNU General_Public/License version 3 CC BY"), (6, "x" * 100_000 + " cc by"), (6, "Ünder the cc by é")]
    docs += [docs[0], (7, "nothing here at all")]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, labels int")
    got = license_scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *base(t)) for i, t in docs)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert license_scan(df.limit(0)).collect() == []


def test_rules_are_many_and_reached_by_a_trigger():
    assert len(rules()) > 300
    for text, want in [
        ("this work is licensed under the gnu general public license, version 3.", {"gpl-3.0"}),
        ("released under the mit license.", {"mit"}),
        ("licensed under cc by-nc 4.0.", {"cc-by-nc"}),
        ("licensed under the apache license, version 2.0.", {"apache-2.0"}),
        ("spdx-license-identifier: bsd-3-clause", {"bsd-3-clause"}),
        ("see https://creativecommons.org/licenses/by-sa/4.0/ now", {"cc-by-sa"}),
        ("copyright (c) 2019-2021 some body. all rights reserved", {"copyright", "reserved"}),
        ("mit dem wind", set()),
    ]:
        assert {x[4] for x in detections(text.encode())} == want, text
        assert not want or any(t in text.encode() for t in TRIGGERS)


def test_containment():
    assert suppressed([(0, 10, 5, 0, "a", 1), (2, 8, 4, 1, "b", 1), (5, 12, 4, 2, "c", 1), (0, 10, 5, 0, "a", 1)]) == [(0, 10, 5, 0, "a", 1), (5, 12, 4, 2, "c", 1)]
