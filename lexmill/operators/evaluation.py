"""Evaluation of question sets: coverage, ranking, cost, test-set checks and audits, as aggregations over tables."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import cut


def completeness(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of a case's facts (case_id, fact_id) that are covered (case_id, fact_id, covered); facts without a verdict aren't. Cases without facts have no row."""
    of = facts.join(verdicts, ["case_id", "fact_id"], "left")
    return of.groupBy("case_id").agg(F.count("*").alias("facts"), F.sum(F.coalesce(F.col("covered"), F.lit(False)).cast("int")).alias("covered")).withColumn("rate", F.col("covered") / F.col("facts"))


def by_group(rows: DataFrame, value: str, mode: str = "mode", category: str = "category") -> DataFrame:
    """Mean and number of the values that aren't null, for each mode and category and for each mode (category ALL)."""
    grouped = rows.groupingSets([[F.col(mode), F.col(category)], [F.col(mode)]], F.col(mode), F.col(category))
    # grouping sets have a null for what they leave out, and so may the data
    out = grouped.agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping(category).alias("all"))
    return out.select(mode, F.when(F.col("all") == 1, "ALL").otherwise(F.col(category)).alias(category), "mean", "n")


def token_usage(calls: DataFrame) -> DataFrame:
    """Per query and tag, and per query over all tags (tag ALL): calls and tokens."""
    out = calls.rollup("query_id", "tag").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum(F.col("prompt") + F.col("completion")).alias("total"), F.grouping("tag").alias("g"), F.grouping("query_id").alias("gq"))
    return out.filter("gq = 0").select("query_id", F.when(F.col("g") == 1, "ALL").otherwise(F.col("tag")).alias("tag"), "calls", "prompt", "completion", "total")


def token_summary(per_query: DataFrame, final: DataFrame) -> DataFrame:
    """Mean usage of each mode over its queries, and of the final call, in long form: mode, metric, value, n."""
    a = per_query.groupBy("mode").agg(*(F.avg(c).alias(f"mean_{c}") for c in ("total", "prompt", "completion", "calls")), F.count("*").alias("n"))
    b = final.groupBy("mode").agg(*(F.avg(c).alias(f"final_{c}") for c in ("total", "prompt", "completion")), F.count("*").alias("n"))
    long = lambda df: df.unpivot(["mode", "n"], [c for c in df.columns if c not in ("mode", "n")], "metric", "value")
    return long(a).unionByName(long(b)).select("mode", "metric", "value", "n")


def final_usage(calls: DataFrame, order: list[str]) -> DataFrame:
    """Usage of the call that gave the answer: of each query, the first tag of order that it has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("tag"))
    of = calls.groupBy("query_id", "mode", "tag").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion")).withColumn("r", rank).filter("r > 0")
    best = of.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).filter("k = 1")
    return best.select("query_id", "mode", "tag", "prompt", "completion", (F.col("prompt") + F.col("completion")).alias("total"))


def metric_means(scores: DataFrame) -> DataFrame:
    """Mean of each metric over the scores that are numbers."""
    v = F.nanvl("score", F.lit(None).cast("double"))
    return scores.groupBy("metric").agg(F.avg(v).alias("mean"), F.count(v).alias("n"))


def batch_health(rows: DataFrame, ok: Column, floor: float = 0.5) -> DataFrame:
    """Share of good rows of each batch, and an alarm where it and the one before are under floor. Batches are numbered, so the one before is a join."""
    share = rows.groupBy("batch").agg(F.avg(ok.cast("int")).alias("share"))
    before = share.select((F.col("batch") + 1).alias("batch"), F.col("share").alias("before"))
    return share.join(before, "batch", "left").select("batch", "share", ((F.col("share") < floor) & (F.coalesce("before", F.lit(1.0)) < floor)).alias("alarm"))


def relevant_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked (case_id, pos from 0, item) with gold (case_id, item), compared without case: pos of each hit."""
    g = gold.select("case_id", F.lower("item").alias("item")).distinct()
    return ranked.select("case_id", "pos", F.lower("item").alias("item")).join(g, ["case_id", "item"], "left_semi")


def mrr(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Reciprocal of the first hit's place for each case of gold, 0 without any."""
    first = relevant_ranks(ranked, gold).groupBy("case_id").agg(F.min("pos").alias("first"))
    return gold.select("case_id").distinct().join(first, "case_id", "left").select("case_id", F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("rr"))


def ndcg(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Normalised discounted cumulative gain of the first k, hits counting one each."""
    gain = relevant_ranks(ranked, gold).filter(F.col("pos") < k).groupBy("case_id").agg(F.sum(1 / F.log2(F.col("pos") + 2)).alias("dcg"))
    n = gold.groupBy("case_id").agg(F.countDistinct(F.lower("item")).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return n.join(gain, "case_id", "left").select("case_id", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def context_pr(retrieved: DataFrame, fetched: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision and recall of the articles that are retrieved or fetched; 0 where there are none."""
    got = retrieved.select("case_id", "item").unionByName(fetched.select("case_id", "item")).groupBy("case_id").agg(F.collect_set("item").alias("got"))
    want = gold.groupBy("case_id").agg(F.collect_set("item").alias("want"))
    both = want.join(got, "case_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    hit = F.size(F.array_intersect("got", "want"))
    return both.select("case_id", F.when(F.size("got") > 0, hit / F.size("got")).otherwise(0.0).alias("precision"), (hit / F.size("want")).alias("recall"))


def context_chars(contexts: DataFrame) -> DataFrame:
    """Mean characters of the contexts (case_id, mode, contexts) of each mode."""
    n = F.aggregate(F.transform("contexts", lambda c: F.length(c)), F.lit(0), lambda a, b: a + b)
    return contexts.groupBy("mode").agg(F.avg(n).alias("mean_chars"))


def mode_pivot(summary: DataFrame, modes: list[str]) -> DataFrame:
    """metric by mode."""
    return summary.groupBy("metric").pivot("mode", modes).agg(F.first("value"))


def missing_articles(gold: DataFrame, articles: DataFrame) -> DataFrame:
    """Gold items that the corpus (item) hasn't, compared without case."""
    return gold.withColumn("k", F.lower("item")).join(articles.select(F.lower("item").alias("k")), "k", "left_anti").drop("k")


def wrong_cardinality(gold: DataFrame, many: list[str]) -> DataFrame:
    """Cases with a wrong number of gold items: the categories of many need two at least, others one."""
    n = gold.groupBy("case_id", "category").agg(F.countDistinct("item").alias("n"))
    return n.filter(F.when(F.col("category").isin(many), F.col("n") < 2).otherwise(F.col("n") != 1))


def near_duplicates(texts: DataFrame, threshold: float = 0.9, k: int = 3) -> DataFrame:
    """Pairs a < b of rows (id, text) whose sets of k-character shingles have a Jaccard similarity of threshold or more.

    Equal texts (case and spacing apart) are one: each copy is paired with the first of them, which stands for them in all
    other pairs. Prefix filtering then: shingles are ordered from rare to frequent, and two sets so similar share one of
    each other's first ones. Only pairs that do are compared, by the sizes of their sets and of what is shared.
    """
    flat = texts.select("id", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("t")).filter("t IS NOT NULL")
    first = flat.groupBy("t").agg(F.min("id").alias("rep"))
    copies = flat.join(first, "t").filter("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    sets = first.select(F.col("rep").alias("id"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - (k - 1), F.lit(1))), lambda i: F.substring("t", i, F.lit(k)))).alias("s"))
    each = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("sh"))
    freq = each.groupBy("sh").agg(F.count("*").alias("df"))
    ordered = each.join(freq, "sh").withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("df", "sh")))
    head = ordered.filter(F.col("p") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("sh", "id", "n")
    b = head.select("sh", F.col("id").alias("b"), F.col("n").alias("m"))
    pairs = head.withColumnRenamed("id", "a").join(b, "sh").filter((F.col("a") < F.col("b")) & (F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9)).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("jaccard")).filter(F.col("jaccard") >= threshold).unionByName(copies)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many partitions as shuffles have, however few bytes they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Blocks of texts that are compared with each other hold so many texts, and about so many characters, at most.
BLOCK_TEXTS, BLOCK_CHARS = 4096, 1 << 21
#: So many characters of a text are matched before its partners are looked at again.
SEGMENT = 32
#: Characters as bits are told apart by their lowest seven bits, so that a block has 128 masks at most; where others meet, more seems to match.
SIGNS = 128


def signs(text: str) -> np.ndarray:
    return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % SIGNS).astype(np.uint8)


def sign_masks(texts: list[str]) -> dict[int, np.ndarray]:
    """For each sign of the texts, a bit for each place where a text has it: words of 64 places by texts."""
    of = np.full((len(texts), -(-max(map(len, texts)) // 64) * 64), SIGNS, np.uint8)
    for row, t in zip(of, texts, strict=True):
        row[: len(t)] = signs(t)
    return {int(c): np.ascontiguousarray(np.packbits(of == c, axis=1, bitorder="little").view("<u8").T) for c in np.unique(of) if c < SIGNS}


def may_match_any(masks: dict[int, np.ndarray], sizes: np.ndarray, y: str, least: np.ndarray) -> np.ndarray:
    """Which of the texts of masks may have a common subsequence of that many characters with y: ``may_match`` for many texts side by side.

    Only places that pairs with so many can match are matched: of y's character j those of x from j - (n - least) to
    j + (m - least). It stops when few texts are left.
    """
    n, count = len(y), len(sizes)
    over_x, over_y = sizes - least, n - least
    alive = (over_x >= 0) & (over_y >= 0)
    if not alive.any():
        return np.flatnonzero(alive)
    ahead, behind = int(over_x[alive].max()), int(over_y[alive].max())
    words = -(-int(sizes.max()) // 64)
    v = np.full((words, count), ~np.uint64(0))
    u, s, t, carry = (np.empty(count, np.uint64) for _ in range(4))
    own = signs(y)
    for k in range(0, n, SEGMENT):
        done = min(k + SEGMENT, n)
        low, high = max(0, k - behind) // 64, min(words, (done - 1 + ahead) // 64 + 1)
        for c in own[k:done].tolist():
            if (mask := masks.get(c)) is None:
                continue
            for w in range(low, high):
                x = v[w]
                np.bitwise_and(x, mask[w], out=u)
                np.add(x, u, out=s)
                if w > low:
                    np.add(s, carry, out=s)
                if w < high - 1:
                    # what the sum carries into the next word
                    np.invert(s, out=t)
                    np.bitwise_and(t, x, out=t)
                    np.bitwise_or(t, u, out=t)
                    np.right_shift(t, 63, out=carry)
                np.bitwise_xor(x, u, out=x)
                np.bitwise_or(x, s, out=x)
        reach = np.minimum(sizes, done + over_x)
        unmatched = np.zeros(count, np.int64)
        for w in range(min(words, max(0, int(reach.max())) // 64 + 1)):
            bits = np.clip(reach - 64 * w, 0, 64)
            part = np.where(bits > 0, ~np.uint64(0) >> (64 - np.maximum(bits, 1)).astype(np.uint64), np.uint64(0))
            unmatched += np.bitwise_count(v[w] & part)
        alive &= (reach >= 0) & (done - (reach - unmatched) <= over_y)
        if np.count_nonzero(alive) * 256 <= count:
            break
    return np.flatnonzero(alive)


#: Length classes that a pair of the ratio can be apart. More of them keep the lengths in a task closer, and with them how far what matches can have moved.
APART = 4
#: Runs of so many characters are counted, fewer where the ratio leaves too few of them whole.
GRAM = 4
#: Runs are told apart by so many numbers; where others meet, more seems to be shared.
SLOTS = 1 << 14


def gram_size(threshold: float) -> int:
    """The longest run, up to GRAM characters, of which pairs of the ratio share a tenth of a text's length at least; else one character."""
    return max([q for q in range(1, GRAM + 1) if (q - 0.5) * threshold - (q - 1) >= 0.1], default=1)


def runs(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of q characters: a hash, the text's number and the place in it, in order."""
    s = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.array([len(t) for t in texts])
    own, at = np.repeat(np.arange(len(n)), n), np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
    here = np.flatnonzero(at + q <= n[own])
    h = np.zeros(len(here), np.uint64)
    for k in range(q):
        h = h * np.uint64(1_000_003) + s[here + k]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SLOTS, own[here], at[here]


def enough_shared(xs: list[str], ys: list[str], threshold: float) -> np.ndarray:
    """For texts of ys (rows) and xs that aren't longer: whether at least as many runs are shared as the ratio leaves whole. No pair of the ratio fails.

    Of m and n characters with M matched, (2 q - 1) M - (q - 1) (m + n + 1) runs of q match as a whole, each of y's at j
    with one of x's from j - (n - M) to j + (m - M). So y is parted into pieces, and a piece's runs are looked up among
    those of x that are near enough.
    """
    q, m, n = gram_size(threshold), np.array([len(t) for t in xs]), np.array([len(t) for t in ys])
    # the most that can be unmatched of any x, and of any y
    over_x, over_y = (math.floor(max(a.max() - threshold / 2 * (a.max() + b.min()), 0) + 1e-9) for a, b in ((m, n), (n, m)))
    piece = 64 if n.max() > 512 else 128
    shared = np.zeros((len(ys), len(xs)), np.uint32)
    (hx, of_x, at_x), (hy, of_y, at_y) = runs(xs, q), runs(ys, q)
    order = np.argsort(at_x, kind="stable")
    hx, of_x, at_x = hx[order], of_x[order], at_x[order]
    order = np.lexsort((of_y, at_y // piece))
    hy, of_y, part = hy[order], of_y[order], (at_y // piece)[order]
    has = np.zeros((SLOTS, len(xs)), np.uint8)
    for k in range(int(part[-1]) + 1 if len(part) else 0):
        lo, hi = np.searchsorted(at_x, [k * piece - over_y, (k + 1) * piece + over_x])
        has[hx[lo:hi], of_x[lo:hi]] = 1
        begin, end = np.searchsorted(part, [k, k + 1])
        own, h = of_y[begin:end], hy[begin:end]
        for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []):
            # a piece has under 256 runs, so bytes hold their number
            shared[own[i]] += np.add.reduce(has[h[i:j]], axis=0, dtype=np.uint8)
        has[hx[lo:hi], of_x[lo:hi]] = 0
    both = n[:, None] + m[None, :]
    return shared >= (2 * q - 1) * np.ceil(threshold / 2 * both - 1e-9) - (q - 1) * (both + 1)


#: So many partners of a text or more are matched side by side.
MANY = 256


def bands(sizes: np.ndarray, least: int = 512, spread_: float = 1.02) -> Iterator[slice]:
    """Sorted lengths parted into stretches of least texts or more and not many of very different lengths: the closer lengths are, the less can have moved."""
    begin = 0
    while begin < len(sizes):
        end = max(begin + least, int(np.searchsorted(sizes, sizes[begin] * spread_, "right")))
        yield slice(begin, end)
        begin = end


def matched(xs: list[tuple], ys: list[tuple], threshold: float) -> Iterator[tuple[tuple, tuple]]:
    """Pairs of xs and ys, sorted rows (length, id, text, ...), whose common subsequence is long enough for the ratio and of which x is the lesser."""
    if not xs or not ys or xs[0] >= ys[-1]:
        return
    sizes, masks, places = np.array([x[0] for x in xs]), None, {}
    likely = np.zeros((len(ys), len(xs)), bool)
    for i in bands(np.array([y[0] for y in ys])):
        for j in bands(sizes):
            likely[i, j] = enough_shared([x[2] for x in xs[j]], [y[2] for y in ys[i]], threshold)
    for y, some in zip(ys, likely, strict=True):
        n, text = y[0], y[2]
        lo, hi = int(np.searchsorted(sizes, math.ceil(n * threshold / (2 - threshold) - 1e-9))), bisect.bisect_left(xs, y)
        some = lo + np.flatnonzero(some[lo:hi])
        least = np.ceil(threshold / 2 * (sizes[some] + n) - 1e-9).astype(np.int64)
        if len(some) >= MANY:
            masks = sign_masks([x[2] for x in xs]) if masks is None else masks
            few = may_match_any({c: masks[c][:, some] for c in set(signs(text).tolist()) & masks.keys()}, sizes[some], text, least)
            some, least = some[few], least[few]
        for i, need in zip(some.tolist(), least.tolist(), strict=True):
            if i not in places:
                places[i] = places_of(xs[i][2])
            if may_match(xs[i][2], text, need, places[i]):
                yield xs[i], y


def segment_candidates(sized: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of texts (id, text) with both texts, text_a and text_b, whose longest common subsequence is as long as pairs with the ratio have at least. Other columns come along for both.

    Pairs of the ratio are at most APART length classes apart. Texts of a class are dealt to blocks, and each block meets
    those of its own class and of the next ones in a task of its own. There the runs of characters that texts share near
    each other are counted, and only pairs that share enough are matched, segment by segment, and given up as soon as
    too many characters are unmatched.
    """
    classes = F.floor(F.log(F.length("text").cast("double")) / (math.log((2 - threshold) / threshold) / APART) + 1e-9).cast("int")
    more = [f for f in sized.schema.fields if f.name not in ("id", "text")]
    texts = sized.filter("text <> ''").select("id", "text", *(f.name for f in more), classes.alias("class"))
    counts = texts.groupBy("class").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum(F.length("text").cast("long")) / BLOCK_CHARS)).cast("int").alias("blocks"))
    # a row with an entry for each class, which are few: their number grows with the logarithm of the longest text
    counts = counts.agg(F.map_from_entries(F.collect_list(F.struct("class", "blocks"))).alias("counts"))
    block = F.pmod(F.xxhash64("id"), F.try_element_at("counts", F.col("class"))).cast("int")
    dealt = texts.crossJoin(F.broadcast(counts)).withColumn("block", block)
    # all blocks of a class and of those near it that a text's block meets: (class and block of the one, of the other)
    named = lambda c, p, d, q: F.struct(c.alias("c"), p.alias("p"), d.alias("d"), q.alias("q"))
    own, block = F.col("class"), F.col("block")

    def met(k: int) -> Column:
        n = F.try_element_at("counts", own + k)
        pair = (lambda i: named(own, F.least(i, block), own, F.greatest(i, block))) if not k else (lambda i: named(own, block, own + k, i)) if k > 0 else (lambda i: named(own + k, i, own, block))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast("array<struct<c:int,p:int,d:int,q:int>>"))

    meets = F.concat(*(met(k) for k in range(-APART, APART + 1)))
    sides = ((own == F.col("of.c")) & (block == F.col("of.p"))).alias("one"), ((own == F.col("of.d")) & (block == F.col("of.q"))).alias("other")
    names = ["id", "text", *(f.name for f in more)]
    each = dealt.select(*names, "class", "block", F.explode(meets).alias("of")).select(*names, "of", *sides)

    def paired(p: pd.DataFrame) -> pd.DataFrame:
        key = lambda side: sorted((len(r[1]), *r) for r in p.loc[p[side], names].itertuples(index=False, name=None))
        one, other = key("one"), key("other")
        # of two blocks of one class each may have the shorter text of a pair
        met = [(one, other)] if (p["one"] & p["other"]).all() else [(one, other), (other, one)]
        pairs = [sorted(pair, key=lambda r: r[1]) for xs, ys in met for pair in matched(xs, ys, threshold)]
        rows = [(a[1], b[1], a[2], b[2], *itertools.chain(*zip(a[3:], b[3:], strict=True))) for a, b in pairs]
        return pd.DataFrame(rows, columns=["a", "b", "text_a", "text_b", *(f"{f.name}_{side}" for f in more for side in "ab")])

    kinds = "".join(f", {f.name}_{side} {f.dataType.simpleString()}" for f in more for side in "ab")
    # few bytes, much work: a number of its own keeps Spark from joining partitions by size
    return spread(each, "of").groupBy("of").applyInPandas(paired, "a long, b long, text_a string, text_b string" + kinds)


def ratio_links(texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Different texts of rows (id, text), each once (one: its number, text, first and last id, copies), and links x, y, ratio of their numbers.

    The ratio isn't symmetric, and a pair of rows has that of the text with the smaller id with the other: so of two texts
    each direction is linked by itself that rows have and in which the ratio is threshold or more.
    """
    found = texts.filter("text IS NOT NULL").groupBy("text").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.countDistinct("id").alias("copies"))
    one = cut(found.withColumn("id", F.monotonically_increasing_id()))
    pairs = segment_candidates(one.select("id", "text", "first", "last"), threshold)
    way = lambda a, b: F.when((F.col(f"first_{a}") < F.col(f"last_{b}")) | (F.col(f"first_{a}") == F.col(f"last_{b}")) & (F.col(a) < F.col(b)), F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(f"text_{a}").alias("text_a"), F.col(f"text_{b}").alias("text_b")))
    ways = pairs.select(F.explode(F.array_compact(F.array(way("a", "b"), way("b", "a")))).alias("w")).select("w.*")
    return one, exact_ratio(spread(ways, "a", "b"), threshold).withColumnsRenamed({"a": "x", "b": "y"})


def ratio_duplicates(texts: DataFrame, threshold: float = 0.9, expanded: bool = False) -> DataFrame:
    """Pairs a < b of rows (id, text) whose matching-block ratio is threshold (between 0 and 1) or more, of the texts as they are.

    Equal texts are one: each copy is paired with the first of them, which stands for them in all other pairs. expanded
    gives all pairs of rows instead, copies included: of k copies k (k - 1) / 2, and of each of them those with other texts.
    Rows of the same id and text are one row. Of texts of m and n characters with such a ratio, (1 - threshold) (m + n)
    characters at most are unmatched, in both together, and what matches has moved by no more than the other text's
    unmatched characters. So the runs of characters that they share near each other, and then the longest common
    subsequence, which no matching is longer than, tell nearly all other pairs apart; the ratio is computed for what is left.
    """
    if not 0 < threshold < 1:
        raise ValueError("a ratio between 0 and 1 is needed")
    one, links = ratio_links(texts, threshold)
    again = texts.join(one.filter("copies > 1").select("text", F.col("id").alias("of"), "first"), "text").select("of", "first", "id").distinct()
    if not expanded:
        named = lambda c: one.select(F.col("id").alias(c), F.col("first").alias("a" if c == "x" else "b"))
        own = links.join(named("x"), "x").join(named("y"), "y").filter("a < b OR a = b AND x < y").select("a", "b", "ratio")
        return own.unionByName(again.filter("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("ratio")))
    rows = one.filter("copies = 1").select(F.col("id").alias("of"), F.col("first").alias("id")).unionByName(again.select("of", "id"))
    side = lambda df, of, c: df.select(F.col("of").alias(of), F.col("id").alias(c))
    pairs = links.join(side(rows, "x", "a"), "x").join(side(rows, "y", "b"), "y").filter("a < b OR a = b AND x < y").select("a", "b", "ratio")
    copies = side(again, "x", "a").join(side(again, "x", "b"), "x").filter("a < b").select("a", "b", F.lit(1.0).alias("ratio"))
    return pairs.unionByName(copies)


def places_of(x: str) -> dict[str, int]:
    """A bit for each place of each character."""
    codes = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}


def may_match(x: str, y: str, least: int, places: dict[str, int] | None = None) -> bool:
    """Whether the longest common subsequence has at least so many characters. There is a bit for each character of x; it is given up where y leaves too many unmatched with the part of x that is within reach."""
    places = places_of(x) if places is None else places
    of = {c: places.get(c, 0) for c in set(y)}
    v = whole = (1 << len(x)) - 1
    for k in range(0, len(y), 64):
        for c in y[k : k + 64]:
            if u := v & of[c]:
                v = (v + u | v - u) & whole
        done = min(k + 64, len(y))
        reach = min(len(x), done + len(x) - least)
        if reach < 0 or done - (reach - (v & (1 << reach) - 1).bit_count()) > len(y) - least:
            return False
    return len(x) - v.bit_count() >= least


def exact_ratio(pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b, text_a, text_b) whose matching-block ratio is threshold or more."""

    def rate(x: str, y: str) -> float:
        if not may_match(x, y, math.ceil(threshold / 2 * (len(x) + len(y)) - 1e-9)):
            return 0.0
        return SequenceMatcher(None, x, y).ratio()

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p.assign(ratio=[rate(x or "", y or "") for x, y in zip(p.text_a, p.text_b, strict=True)])
            yield p.loc[p.ratio >= threshold, ["a", "b", "ratio"]]

    return pairs.mapInPandas(rated, "a long, b long, ratio double")


def case_source(gold: DataFrame, texts: DataFrame, missing: str = "[không có văn bản]") -> DataFrame:
    """The texts (item, content) of a case's gold items (case_id, pos, item) in order, with a marker for those without."""
    keyed = texts.select(F.lower("item").alias("key"), "content")
    of = gold.withColumn("key", F.lower("item")).join(keyed, "key", "left").select("case_id", "pos", F.coalesce("content", F.lit(missing)).alias("t"))
    return of.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n\n").alias("source"))


def validation_rates(rows: DataFrame, checks: list[str]) -> DataFrame:
    """rows (case_id, category, error, and a flag for each check): share of each check by category and over all rows (ALL), without rows in error."""
    good = rows.filter("error IS NULL").groupingSets([[F.col("category")], []], F.col("category"))
    out = good.agg(*(F.avg(F.col(c).cast("int")).alias(c) for c in checks), F.count("*").alias("n"), F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("category")).alias("category"), *checks, "n")


def validation_fails(rows: DataFrame, checks: list[str]) -> DataFrame:
    """check and case_id of each failure, and of rows in error (check error)."""
    flags = F.array(*(F.when(~F.col(c), F.lit(c)) for c in checks))
    failed = rows.filter("error IS NULL").select("case_id", F.explode(F.array_compact(flags)).alias("check"))
    return failed.unionByName(rows.filter("error IS NOT NULL").select("case_id", F.lit("error").alias("check")))


def validation_detail(cases: DataFrame, rows: DataFrame, checks: list[str]) -> DataFrame:
    """A row for each case with its checks, blank where it is in error or wasn't judged."""
    of = cases.select("case_id").join(rows, "case_id", "left")
    return of.select("case_id", *(F.when(F.col("error").isNull() & F.col(c).isNotNull(), F.col(c).cast("string")).otherwise("").alias(c) for c in checks))


def judgment_merge(old: DataFrame, new: DataFrame, field: str) -> DataFrame:
    """old with field replaced where new has a value for the case."""
    return old.join(new.select("case_id", F.col(field).alias("_new")), "case_id", "left").withColumn(field, F.coalesce("_new", field)).drop("_new")


def grouped_means(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means over each column of by alone and over all rows: dimension, value, n and the metrics."""
    sets = rows.groupingSets([[F.col(b)] for b in by] + [[]], *map(F.col, by))
    out = sets.agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("n"), *(F.grouping(b).alias(f"g_{b}") for b in by))
    dim, val = F.lit("ALL"), F.lit("ALL")
    for b in by:
        dim, val = F.when(F.col(f"g_{b}") == 0, b).otherwise(dim), F.when(F.col(f"g_{b}") == 0, F.col(b).cast("string")).otherwise(val)
    return out.select(dim.alias("dimension"), val.alias("value"), "n", *metrics)


def error_counts(rows: DataFrame) -> DataFrame:
    """rows (case_id, labels): how many cases have each label, with its place by count."""
    n = rows.select("case_id", F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


def worst_cases(rows: DataFrame, n: int) -> DataFrame:
    """The n cases with the most labels, of ties the smallest."""
    return rows.select("case_id", F.size("labels").alias("n_labels")).orderBy(F.desc("n_labels"), "case_id").limit(n)


def retention_audit(rows: DataFrame) -> DataFrame:
    """rows (group, reached, kept_before, kept_after): outcomes and the share kept of what was reached, before and after."""
    hit = F.col("reached")
    return rows.groupBy("group").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("reached"), F.count_if(hit & F.col("kept_before")).alias("before"), F.count_if(hit & F.col("kept_after")).alias("after"),
        F.count_if(hit & ~F.col("kept_before") & F.col("kept_after")).alias("gained"), F.count_if(hit & F.col("kept_before") & ~F.col("kept_after")).alias("lost"),
    ).withColumn("rate_before", F.col("before") / F.nullif("reached", F.lit(0))).withColumn("rate_after", F.col("after") / F.nullif("reached", F.lit(0)))
