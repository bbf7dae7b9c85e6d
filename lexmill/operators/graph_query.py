"""Pattern queries over the graph tables. What is optional is aggregated before it is joined, so rows never multiply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import cut

STRUCTURE = ("CO_KHOAN", "CO_DIEM")


def hop(edges: DataFrame, *rels: str) -> DataFrame:
    return edges.filter(F.col("rel").isin(*rels)).select("src", "rel", "dst").distinct()


def joined(c: str | Column, sep: str = ",") -> Column:
    """The distinct values of a group in order, as one text; null for none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c)), sep), F.lit(""))


def targets(edges: DataFrame, name: str, *rels: str) -> DataFrame:
    """src and all targets over some relations, as one text."""
    return hop(edges, *rels).groupBy("src").agg(joined("dst").alias(name))


def behaviour_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each behaviour: main penalties, additional penalties and what regulates it."""
    sources = hop(edges, "QUY_DINH_HANH_VI").groupBy("dst").agg(joined("src").alias("sources"))
    out = nodes.filter("label = 'HanhVi'").select("id", "ten")
    for part, key in ((targets(edges, "main", "CHE_TAI_CHINH"), "src"), (targets(edges, "additional", "CHE_TAI_BO_SUNG"), "src"), (sources, "dst")):
        out = out.join(part.withColumnRenamed(key, "id"), "id", "left")
    return out


def closure(edges: DataFrame, starts: DataFrame, steps: int | None, rels: tuple[str, ...] = STRUCTURE, own: bool = True) -> DataFrame:
    """starts (article_id) with each node_id that up to steps structure edges (None: any number) lead to, each once; own: and with itself.

    Only what a step has found for the first time goes on to the next one, so cycles end, and the loop stops where nothing
    new is found. A start that a cycle leads back to counts as found. Steps are checkpointed: each plan is one join and one anti-join.
    """
    e = cut(edges.filter(F.col("rel").isin(*rels)).select(F.col("src").alias("node_id"), F.col("dst").alias("next_id")))
    new = starts.select("article_id", F.col("article_id").alias("node_id")).distinct()
    known = new if own else new.limit(0)
    step = 0
    while steps is None or step < steps:
        found = new.join(e, "node_id").select("article_id", F.col("next_id").alias("node_id")).distinct()
        new = cut(found.join(known, ["article_id", "node_id"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
        step += 1
    return known


def article_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each article: its clauses, points, references, behaviours (its own and its clauses'), and the penalties of its own behaviours."""
    rels = ("CO_KHOAN", "CO_DIEM", "THAM_CHIEU", "QUY_DINH_HANH_VI")
    # edges are shuffled once, by source: all that reads them takes the same one set of each source, so that Spark makes and keeps it once
    own = edges.filter(F.col("rel").isin(*rels)).groupBy("src").agg(F.collect_set(F.struct("rel", "dst")).alias("out"))
    over = lambda rel: F.transform(F.filter("out", lambda e: e["rel"] == rel), lambda e: e["dst"])
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    nodes = nodes.filter("label = 'Dieu'")
    below = own.select(F.col("src").alias("clause"), over("CO_DIEM").alias("points"), over("QUY_DINH_HANH_VI").alias("via"))
    clauses = own.select(F.col("src").alias("id"), F.explode(over("CO_KHOAN")).alias("clause"))
    parts = clauses.join(below, "clause").groupBy("id").agg(every("points").alias("points"), every("via").alias("via"))
    penalty = edges.filter(F.col("rel").isin("CHE_TAI_CHINH", "CHE_TAI_BO_SUNG")).groupBy(F.col("src").alias("behaviour")).agg(F.collect_set("dst").alias("penalties"))
    direct = own.withColumnRenamed("src", "id").join(nodes.select("id"), "id", "left_semi").select("id", F.explode(over("QUY_DINH_HANH_VI")).alias("behaviour"))
    penalties = direct.join(penalty, "behaviour").groupBy("id").agg(every("penalties").alias("penalties"))
    found = nodes.select("id", "ten").join(own.withColumnRenamed("src", "id"), "id", "left").join(parts, "id", "left").join(penalties, "id", "left")
    none = F.array().cast("array<string>")
    behaviours = F.array_union(F.coalesce(over("QUY_DINH_HANH_VI"), none), F.coalesce("via", none))
    text = lambda c: F.nullif(F.array_join(F.array_sort(c), ","), F.lit(""))
    return found.select("id", "ten", text(over("CO_KHOAN")).alias("clauses"), text("points").alias("points"), text(over("THAM_CHIEU")).alias("refers_to"), text(behaviours).alias("behaviours"), text("penalties").alias("penalties"))


def article_detail(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each article: clauses with their behaviours and these behaviours' penalties, as one text ``clause>behaviour>kind:penalty``."""
    articles = nodes.filter("label = 'Dieu'").select("id", "van_ban_id", "ten")
    clause = hop(edges, "CO_KHOAN").select(F.col("src").alias("id"), F.col("dst").alias("clause"))
    behaviour = hop(edges, "QUY_DINH_HANH_VI").select(F.col("src").alias("clause"), F.col("dst").alias("behaviour"))
    penalty = hop(edges, "CHE_TAI_CHINH", "CHE_TAI_BO_SUNG").groupBy(F.col("src").alias("behaviour")).agg(joined(F.concat("rel", F.lit(":"), "dst"), "+").alias("penalties"))
    rows = clause.join(behaviour, "clause", "left").join(penalty, "behaviour", "left")
    detail = rows.groupBy("id").agg(F.countDistinct("clause").alias("n_clauses"), joined(F.concat_ws(">", "clause", "behaviour", "penalties"), ";").alias("detail"))
    return articles.join(detail, "id", "left").withColumn("n_clauses", F.coalesce("n_clauses", F.lit(0)))


def retrieved_nodes(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("chunk_id").alias("node")).distinct()


def chunk_neighbours(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges out of what a query retrieved, with a flag for targets that it retrieved too."""
    got = retrieved_nodes(hits)
    out = got.join(edges.select(F.col("src").alias("node"), "rel", "dst").distinct(), "node")
    have = got.select("query_id", F.col("node").alias("dst"), F.lit(True).alias("have"))
    return out.join(have, ["query_id", "dst"], "left").select("query_id", "node", "rel", "dst", F.col("have").isNotNull().alias("already"))


def missing_chunks(hits: DataFrame, edges: DataFrame, rels: tuple[str, ...]) -> DataFrame:
    """Targets over some relations that the query hasn't retrieved."""
    return chunk_neighbours(hits, edges.filter(F.col("rel").isin(*rels))).filter("NOT already").select("query_id", "dst", "rel").distinct()


def neighbour_text(neighbours: DataFrame) -> DataFrame:
    line = F.concat(F.col("node"), F.lit(" -["), F.col("rel"), F.lit("]-> "), F.col("dst"), F.when(F.col("already"), F.lit(" (đã có)")).otherwise(""))
    return neighbours.groupBy("query_id").agg(joined(line, "\n").alias("text"))


def document_toc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Articles of each document by number: numbers that are none (as 25a) come last, in order of their text."""
    number = F.regexp_extract("id", r"_D(\d+[a-zA-Z]*)$", 1)
    of = hop(edges, "CO_DIEU").select(F.col("src").alias("document"), F.col("dst").alias("id")).join(nodes.filter("label = 'Dieu'").select("id", "ten"), "id")
    numeric = F.expr("try_cast(so AS BIGINT)")
    order = F.row_number().over(Window.partitionBy("document").orderBy(F.asc_nulls_last(numeric), "so", "id"))
    return of.withColumn("so", number).withColumn("pos", order).select("document", "pos", "id", "ten")


def document_penalties(edges: DataFrame) -> DataFrame:
    """Behaviours one or two steps below a document's articles, with their penalties."""
    article = hop(edges, "CO_DIEU").select(F.col("src").alias("document"), F.col("dst").alias("node"))
    step = hop(edges, "CO_KHOAN", "QUY_DINH_HANH_VI").select(F.col("src").alias("node"), F.col("dst").alias("next"), "rel")
    one = article.join(step, "node").select("document", F.col("next").alias("node"), "rel")
    two = one.select("document", "node").join(step, "node").select("document", F.col("next").alias("node"), "rel")
    behaviours = one.unionByName(two).filter("rel = 'QUY_DINH_HANH_VI'").select("document", F.col("node").alias("behaviour")).distinct()
    penalty = hop(edges, "CHE_TAI_CHINH", "CHE_TAI_BO_SUNG").groupBy(F.col("src").alias("behaviour")).agg(joined(F.concat("rel", F.lit(":"), "dst")).alias("penalties"))
    return behaviours.join(penalty, "behaviour").select("document", "behaviour", "penalties")


def part_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many clauses and points are up to four steps below each article; 0 for none."""
    articles = nodes.filter("label = 'Dieu'").select(F.col("id").alias("article_id"))
    n = closure(edges, articles, 4, own=False).groupBy("article_id").agg(F.countDistinct("node_id").alias("parts"))
    return articles.join(n, "article_id", "left").select("article_id", F.coalesce("parts", F.lit(0)).cast("long").alias("parts"))
