"""near_dups against the reference's all-pairs comparison."""

import random
from difflib import SequenceMatcher

import pytest

from lexmill.operators import evaluation as E
from lexmill.plans import evals


def brute(rows, threshold=0.9):
    first = {}
    for i, t in sorted(r for r in rows if r[1] is not None):
        first.setdefault(t, i)
    own = sorted((i, t) for t, i in first.items())
    out = {(a, b) for k, (a, x) in enumerate(own) for b, y in own[k + 1 :] if SequenceMatcher(None, x, y).ratio() >= threshold}
    return out | {(first[t], i) for i, t in rows if t is not None and i != first[t]}


def test_ratio_duplicates_as_brute_force(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    rows = [(0, ""), (1, None), (2, "a"), (3, "a"), (4, "abcdefghi"), (5, "abcdefgi"), (6, "ab ab ab ab ab ab"), (7, "ab ab ab ab ab aab")]
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 20]))]
        rows.append((100 + 10 * i, " ".join(w)))
        for k in range(1, 4):
            t = list(" ".join(w))
            for _ in range(rng.randint(1, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice("abcdexyz")
            rows.append((100 + 10 * i + k, "".join(t)))
    got = {(r.a, r.b) for r in E.ratio_duplicates(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == brute(rows) and len(got) > 60


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9, 0.95])
def test_pairs_at_the_bound_meet(spark, threshold):
    """Edits spread as evenly as they can be, so that hardly any segment stays whole; of all kinds, in texts of all lengths."""
    rng = random.Random(4)
    rows = []
    for n in [*range(1, 60, 3), 80, 120, 200, 333, 500]:
        x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        rows.append(x)
        for kind in ("drop", "add", "change", "both"):
            t, k = list(x), int((1 - threshold) * n / (1 if kind == "change" else 0.5 + threshold / 2 if kind == "drop" else 0.6))
            at = sorted({round((i + 0.5) * n / max(k, 1)) % n for i in range(k)}, reverse=True)
            for i in at:
                t[i : i + 1] = {"drop": [], "add": [t[i], "#"], "change": ["#"], "both": [] if i % 2 else [t[i], "#"]}[kind]
            rows.append("".join(t))
            rows.append("".join(t[: len(t) // 2]) + x[n // 2 :])
    rows = list(enumerate(rows))
    got = {(r.a, r.b) for r in E.ratio_duplicates(spark.createDataFrame(rows, "id long, text string"), threshold).collect()}
    assert got == brute(rows, threshold) and len(got) > 60


def test_common_subsequence():
    rng = random.Random(5)
    for k in range(400):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randrange(12 if k < 300 else 400))) for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
        n = table[-1][-1]
        assert E.may_match(x, y, n) and E.may_match(x, y, max(n - 2, 0)) and not E.may_match(x, y, n + 1)


def test_few_pairs_reach_the_ratio(spark):
    """Unrelated texts of one language don't become candidates, though they share many runs of a few characters."""
    rng = random.Random(6)
    syllables = ["the", "an", "er", "tion", "on", "re", "ing", "ha", "ou", "at", "sh", "en", "or", "ed", "nd"]
    rows = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(30))) for i in range(200)]
    rows += [(1000 + i, t.replace("tion", "tiom", 3)) for i, t in rows[:40]]
    sized = spark.createDataFrame(rows, "id long, text string")
    assert 40 <= E.segment_candidates(sized, 0.9).count() < 240 * 239 / 2 / 8
    near = {(i, 1000 + i) for i, t in rows[:40] if SequenceMatcher(None, t, rows[200 + i][1]).ratio() >= 0.9}
    assert {(r.a, r.b) for r in E.ratio_duplicates(sized).collect()} == near and len(near) > 25


def test_one_changed_word(spark):
    x = "what does the law say about the notice that an employer has to give before it ends a contract at work"

    class Tables:
        conversations = spark.createDataFrame([(1, 0, x), (2, 0, x.replace("about", "as to"))], "conv_id long, turn long, text string")

    assert (1000, 2000) in {(r.a, r.b) for r in evals.near_dups(Tables()).collect()}


def test_texts_that_differ_leave_no_candidates(spark):
    """Long texts of few syllables: every pair shares segments, but only copies have a common subsequence that is long enough; texts are dealt to several blocks."""
    rng = random.Random(7)
    syllables = ["the", "an", "er", "tion", "on", "re", "ing", "ha", "ou", "at", "sh", "en", "or", "ed", "nd"]
    rows = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(150))) for i in range(60)]
    rows += [(1000 + i, "Zz " + t.replace("tion", "tiom", 3) + "\U0001f600é") for i, t in rows[:20]]
    sized = spark.createDataFrame(rows, "id long, text string")
    want = {(i, 1000 + i) for i in range(20)}
    before, E.BLOCK_TEXTS = E.BLOCK_TEXTS, 9
    try:
        assert {(r.a, r.b) for r in E.segment_candidates(sized, 0.9).collect()} == want
    finally:
        E.BLOCK_TEXTS = before
    assert {(r.a, r.b) for r in E.ratio_duplicates(sized).collect()} <= want


def test_all_pairs_of_rows(spark):
    """The query gives every pair of rows, copies included, with the ratio of the first row's text with the other's, which isn't symmetric."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(n)) for n in (5, 12, 60, 60)]
    for t in texts[:4]:
        for _ in range(3):
            w = t.split(" ")
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    rows = [(i, 0, rng.choice(texts)) for i in range(1, 61)]

    class Tables:
        conversations = spark.createDataFrame(rows, "conv_id long, turn long, text string")

    own = sorted([(1000 * c, t) for c, _, t in rows] + [(1000 * c + 500, t + " Zz") for c, _, t in rows if c % 3 == 0] + [(1000 * c + 700, "  " + t) for c, _, t in rows if c % 7 == 0])
    want = {(a, b): round(r, 6) for k, (a, x) in enumerate(own) for b, y in own[k + 1 :] if (r := SequenceMatcher(None, x, y).ratio()) >= 0.9}
    got = evals.near_dups(Tables()).collect()
    assert {(r.a, r.b): r.ratio for r in got} == want and len(got) == len(want) > 300


@pytest.mark.parametrize("threshold", [0.7, 0.9, 0.95])
def test_shared_runs_lose_no_pair_and_leave_few(threshold):
    rng = random.Random(9)
    syllables = ["the", "an", "er", "tion", "on", "re", "ing", "ha", "ou", "at", "sh", "en", "or", "ed", "nd"]
    for n in (1, 4, 20, 40):
        xs = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)) for _ in range(30)]
        ys = []
        for x in xs:
            t = list(x)
            for _ in range(int((1 - threshold) * len(x) * 0.9)):
                t[rng.randrange(len(t))] = rng.choice(["", "z", "\U0001f600", *"aeinor"])
            ys.append(x[: len(x) // 3] + "".join(t[len(x) // 3 :]))
        sides = sorted(xs, key=len), sorted(ys, key=len)
        for one, other in (sides, sides[::-1]):
            kept = E.enough_shared(one, other, threshold)
            assert all(kept[i, j] for i, y in enumerate(other) for j, x in enumerate(one) if E.may_match(x, y, max(0, -int(-(threshold / 2 * (len(x) + len(y)) - 1e-9) // 1))))
            assert threshold < 0.9 or n < 20 or kept.mean() < 0.2, n
