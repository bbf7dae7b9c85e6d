"""SimHash near-dedup with DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import columns, cut, keyed_rows, release
from lexmill.llm.components import components

BITS = 64
WHITE = "[\\x20\\x09-\\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. (Spark's lower() does that for texts of ASCII only, and faster.)"""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, copy (a hash of the text) and fingerprint (long) of each distinct doc_id and text; fingerprint zero without words.

    A shingle is a row only between a scan and the partial sums over it: what is shuffled is a row of 32 sums for each
    document. Each sum counts two bits, 32 apart, in the halves of a long.
    """
    text = F.coalesce("text", F.lit(""))
    split = F.split(F.btrim(lower_ascii(text), F.lit(" \t\n\u000b\f\r")), WHITE)
    docs = docs.select("doc_id", F.xxhash64(text).alias("copy"), F.filter(split, lambda w: w != "").alias("words"))
    docs = docs.withColumn("last", F.greatest(F.size("words") - shingle, F.lit(0)))
    rows = docs.select("doc_id", "copy", "words", F.explode(F.sequence(F.lit(0), "last")).alias("i"))
    whole = F.when(F.size("words") >= shingle, F.concat_ws(" ", *(F.get("words", F.col("i") + k) for k in range(shingle)))).otherwise(F.concat_ws(" ", "words"))
    rows = rows.select("doc_id", "copy", F.when(F.size("words") > 0, F.xxhash64(whole)).alias("h"))
    half = BITS // 2
    sums = rows.groupBy("doc_id", "copy").agg(F.count("h").alias("n"), *(F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit((1 << half) | 1))).alias(f"s{k}") for k in range(half)))
    low = [F.shiftleft((F.col(f"s{k}").bitwiseAND(F.lit((1 << half) - 1)) * 2 > F.col("n")).cast("long"), k) for k in range(half)]
    high = [F.shiftleft((F.shiftrightunsigned(F.col(f"s{k}"), half) * 2 > F.col("n")).cast("long"), k + half) for k in range(half)]
    bits = low[0]
    for b in low[1:] + high:
        bits = bits.bitwiseOR(b)
    return sums.select("doc_id", "copy", F.coalesce(bits, F.lit(0)).cast("long").alias("fingerprint"))


#: Bits of a trie's first step (at most) and of later ones; a node's children are then a mask of 16 bits.
TOP, STEP = 12, 4
#: So many bits below log2(number of leaves) a node has a leaf or two, and node pairs with few leaves are finished leaf by leaf.
PAST = 6
HALF = BITS // 2
CHILDREN = 1 << STEP
#: Node pairs with so many leaves together are finished leaf by leaf.
FEW = 64


def moved(mask: Column, by: int) -> Column:
    """The mask of children with each child x in the place of x XOR by."""
    for bit, low in ((1, 0x5555), (2, 0x3333), (4, 0x0F0F), (8, 0x00FF)):
        if by & bit:
            mask = F.shiftleft(mask.bitwiseAND(F.lit(low)), bit).bitwiseOR(F.shiftright(mask, bit).bitwiseAND(F.lit(low)))
    return mask


def near(a: str, b: str, budget: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= budget


def node_of(depth: int) -> Column:
    """A leaf's node of that depth: its leading bits."""
    return F.shiftrightunsigned("ord", BITS - depth).alias("node")


def trie_nodes(leaves: DataFrame, depth: int) -> DataFrame:
    """The nodes of that depth: a mask of their children, the class of all their leaves (null if there are several, or one leaf without a class), and how many leaves they have."""
    child = F.shiftrightunsigned("ord", max(0, BITS - depth - STEP)).bitwiseAND(F.lit(CHILDREN - 1)).cast("int")
    one = F.call_function("shiftleft", F.lit(1), child)
    of = [F.bit_or("child").alias("kids"), F.when((F.min("cls") == F.max("cls")) & (F.count("cls") == F.count("*")), F.min("cls")).alias("cls"), F.count("*").alias("n")]
    return leaves.select("trie", node_of(depth), one.alias("child"), "cls").groupBy("trie", "node").agg(*of)


def levels(leaves: int) -> tuple[int, int]:
    """The depth of the tries' first step, and the depth from which on node pairs with few leaves are finished: PAST bits below log2(leaves), whole steps apart."""
    last = max(TOP, min(BITS, (max(leaves, 2) - 1).bit_length() + PAST))
    return TOP - (TOP - last) % STEP, last


def top_pairs(nodes: DataFrame, limit: int, top: int = TOP) -> DataFrame:
    """The first step: pairs (trie, a, b, off: differing bits) of nodes of depth top, each node with itself and with those that differ in limit bits at most. There are 2 ** TOP nodes a trie at most, whatever the input."""
    ways = [e for e in range(1 << top) if e.bit_count() <= limit]
    met = nodes.select("trie", F.col("node").alias("a"), F.explode(F.array(*(F.lit(e) for e in ways))).alias("e")).select("trie", "a", F.col("a").bitwiseXOR(F.col("e")).alias("b"), F.bit_count("e").alias("off")).filter("a <= b")
    return met.join(nodes.select("trie", F.col("node").alias("b")), ["trie", "b"], "left_semi").select("trie", "a", "b", "off")


def followed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs with what their nodes are; without single leaves paired with themselves and those whose leaves are all of one class: they have nothing left to find."""

    def of(side: str) -> DataFrame:
        return nodes.select("trie", F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in nodes.columns if c not in ("trie", "node")))

    of_a = pairs.join(of("a").hint("shuffle_hash"), ["trie", "a"]).filter("a <> b OR n_a > 1")
    both = of_a.join(of("b").hint("shuffle_hash"), ["trie", "b"])
    return both.filter("cls_a IS NULL OR cls_b IS NULL OR cls_a <> cls_b")


def below(both: DataFrame, depth: int, budget: int) -> DataFrame:
    """One step down from node pairs (see ``followed``) of that depth: pairs of their children that are still within the budget.

    For each way e in which the next bits may differ, one AND of two masks gives all children that have a partner.
    """
    limit = budget // 2 if depth + STEP <= HALF else budget
    ways = [e for e in range(CHILDREN) if e.bit_count() <= limit]
    made = [F.struct(F.when(F.col("off") + e.bit_count() <= limit, F.col("kids_a").bitwiseAND(moved(F.col("kids_b"), e))).otherwise(0).alias("mask"), F.lit(e).alias("e")) for e in ways]
    ways_down = both.select("trie", "a", "b", "off", F.explode(F.array(*made)).alias("way")).filter("way.mask <> 0")
    each = ways_down.select("*", F.explode(F.filter(F.array(*(F.lit(x) for x in range(CHILDREN))), lambda x: F.call_function("getbit", F.col("way.mask"), x) == 1)).alias("x"))
    child_a, child_b = F.shiftleft("a", STEP).bitwiseOR(F.col("x")), F.shiftleft("b", STEP).bitwiseOR(F.col("x").bitwiseXOR(F.col("way.e")))
    # children of one node meet in both orders
    each = each.filter((F.col("a") != F.col("b")) | (child_a <= child_b))
    return each.select("trie", child_a.alias("a"), child_b.alias("b"), (F.col("off") + F.bit_count("way.e")).alias("off"))


def leaf_pairs(both: DataFrame, leaves: DataFrame, depth: int, budget: int) -> DataFrame:
    """a, b, of_a and of_b: leaves below node pairs with few leaves, of different classes and within the budget."""

    def of(side: str) -> DataFrame:
        return leaves.select("trie", node_of(depth).alias(f"node_{side}"), F.col("fp").alias(side), F.coalesce("cls", "fp").alias(f"of_{side}"))

    pairs = both.select("trie", F.col("a").alias("node_a"), F.col("b").alias("node_b"))
    return pairs.join(of("a"), ["trie", "node_a"]).join(of("b"), ["trie", "node_b"]).filter((F.col("of_a") != F.col("of_b")) & near("a", "b", budget)).select("a", "b", "of_a", "of_b")


def links(nodes: DataFrame, budget: int) -> DataFrame:
    """Binary trie self-join: edges(a, b) of fingerprints (fp) within budget differing bits that connect all that such pairs connect.

    Of two such fingerprints, one half of the bits differs in budget // 2 at most. So there are two tries, each with
    another half of the bits first. Pairs of nodes go down a trie together, four bits at a time; differing bits add up,
    and a pair is pruned when it has over budget // 2 in the first half of the way or over budget later. Both tries go
    down in the same jobs.

    The steps are laid out by l = log2(number of fingerprints). Random fingerprints make most pairs at a depth of l,
    where each node has about 1 + l + l (l - 1) / 2 partners, so the work is n l ** 2; further down their number falls
    by the square of n over the nodes possible. From l + PAST on, pairs with few leaves are finished at once, others
    go on. Counts at a depth so laid out grow as n l ** 2 does, at a fixed one with the square of n.

    First each leaf meets the next three in the order of its trie (below one node half-way down). What is connected then
    is one class, and node pairs with leaves of one class only are pruned too, so a large group of near copies isn't
    squared. Between two classes one edge is kept. Many fingerprints that are similar but not linked make more pairs
    than random ones.
    """
    turned = F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))
    tries = [(0, F.col("fp")), (1, turned)]

    def ordered(leaves: DataFrame) -> DataFrame:
        return leaves.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("trie"), o.alias("ord")) for i, o in tries))).alias("t")).select("t.trie", "t.ord", *leaves.columns)

    order = Window.partitionBy("trie", F.shiftrightunsigned("ord", HALF)).orderBy("ord")
    beside = ordered(nodes.select("fp")).select("fp", *(F.lead("fp", k).over(order).alias(f"next{k}") for k in (1, 2, 3)))
    beside = beside.select(F.col("fp").alias("a"), F.explode(F.array("next1", "next2", "next3")).alias("b")).filter(near("a", "b", budget)).distinct()
    beside = cut(beside)
    release(nodes.sparkSession)
    classes = components(beside)
    leaves = cut(ordered(nodes.select("fp").join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.col("label").alias("cls"))))
    across = []
    top, last = levels(nodes.count())
    pairs = top_pairs(trie_nodes(leaves, top), budget // 2, top)
    for depth in range(top, BITS + 1, STEP):
        both = followed(pairs, trie_nodes(leaves, depth))
        if depth >= last:
            both = cut(both)
            # a node within a step of the leaves has few
            few = F.lit(depth + STEP > BITS) | (F.col("n_a") + F.col("n_b") <= FEW)
            across.append(leaf_pairs(both.filter(few), leaves, depth, budget))
            both = both.filter(~few)
            if both.isEmpty():
                break
        pairs = cut(below(both, depth, budget))
        release(nodes.sparkSession)
    met = across[0]
    for more in across[1:]:
        met = met.unionByName(more)
    met = met.groupBy(F.least("of_a", "of_b"), F.greatest("of_a", "of_b")).agg(F.min(F.struct("a", "b")).alias("pair"))
    return beside.unionByName(met.select("pair.*"))


def _labelled(docs: DataFrame, shingle: int, budget: int) -> DataFrame:
    """doc_id, copy (a hash of the text), fingerprint, and first: of all in the component, the least doc_id that isn't null, and its least copy."""
    prints = cut(fingerprints(columns(docs, doc_id="long", text="string"), shingle))
    nodes = cut(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy")).alias("least")))
    classes = components(links(nodes, budget))
    labels = nodes.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    of_class = labels.groupBy("label").agg(F.min("least").alias("first"))
    of_print = cut(labels.join(of_class, "label").select(F.col("fp").alias("fingerprint"), "first"))
    return prints.join(of_print, "fingerprint")


def simhash_components(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links of budget differing bits lead to.

    Words are runs of anything but ASCII whitespace, A-Z lower-cased; shingles are hashed with XXH64 (seed 42), and a
    bit is set if over half of the shingles, repeats included, have it.

    Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; a text of fewer words than
    shingle is one shingle; repeated rows (same doc_id and text) are one; a null doc_id is the smallest of a component
    only if it has no other; of a very long text all shingles count, by one task;
    an empty table gives an empty table; other columns are ignored.
    """
    return _labelled(docs, shingle, budget).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def simhash_dedup(docs: DataFrame, shingle: int = 5, budget: int = 4) -> DataFrame:
    """The rows of docs, one of each component: the one with the smallest doc_id, and of those the one with the smallest hash of its text.

    Each row is judged by its own text. Rows with the same doc_id and text are one row; a component of rows without a doc_id keeps one of them.
    """
    kept = _labelled(docs, shingle, budget).filter((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("copy") == F.col("first.copy"))).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_of")).distinct()
    keyed = keyed_rows(docs)
    return keyed.join(kept, keyed["id"].eqNullSafe(kept["_id"]) & (keyed["node"] == kept["_of"]), "left_semi").dropDuplicates(["id", "node"]).select("row.*")
