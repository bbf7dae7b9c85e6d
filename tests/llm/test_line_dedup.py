import hashlib
import random
from collections import Counter

from lexmill.llm.line_dedup import LineRuns, line_dedup

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(docs, m):
    n = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < m]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_as_brute_force(spark):
    rng = random.Random(1)
    pool = ["Header", " header\t", "HEADER\r", "ÉTÉ", "été", "", "  ", " x", "footer"] + [f"l{i}" for i in range(40)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(80)] + [(100, None), (101, ""), (None, "header\nb"), (102, "Header\nHEADER"), (103, "q\n" * 3), (103, "q\n" * 3)]
    df = spark.createDataFrame([(*d, [1]) for d in docs], "doc_id long, text string, common array<int>")
    for m in (2, 10):
        got = line_dedup(df, m).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute(docs, m)
        assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert line_dedup(df.limit(0)).collect() == []


def test_runs_are_levelled(spark):
    runs = LineRuns(3, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1), (k, 2)], "h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    total = {(r.h1, r.h2): r.n for r in runs.merged(runs.runs()).collect()}
    assert total == {(1, 1): 3, **{(k, 2): 1 for k in range(5)}}  # settled once two full runs were merged and not counted on
    assert {(r.h1, r.h2) for r in runs.settled().collect()} == {(1, 1)}
