"""Structural chunking: lines of a document become articles, clauses and points by windows over their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Markers:
    """Patterns that open an article, clause or point (group 1 is its number), and that of a note which ends the text."""

    article: str
    clause: str
    point: str
    note: str


#: Markers of Vietnamese statutes.
STATUTE = Markers(
    article=r"(?iu)^Điều\s+(\d+[a-zA-Z]*)",
    clause=r"(?u)^(\d+)\.(?:\[\d+\]|\d+)?\s*.+",
    point=r"(?iu)^([a-zđ])\)(?:\[\d+\]|\d+)?\s*.+",
    note=r"(?iu)^(?:\d+\s+|\[\d+\]\s*)(?:Tên|Luật|Nghị định|Thông tư|Quyết định|Điểm|Khoản|Điều|Cụm từ|Từ|Các|Mục)(?![\p{L}\p{N}_])",
)

def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no and line: a row for each line that isn't blank, stripped."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(" \t\r\u000b\f"))).filter("line <> ''")


def by_document(lines: DataFrame, partitions: int = 0, key: str = "doc_id") -> DataFrame:
    """lines dealt by document to as many partitions as shuffles have, or to partitions, if these are more. Partitions joined by size would take 64 MB of packed lines each, of which every sort of a task keeps its own unpacked copy."""
    return lines.repartition(max(partitions, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def classified(lines: DataFrame, markers: Markers, partitions: int = 0) -> DataFrame:
    """lines with cls: article, clause, point, text, or none before the first article; lines from the ending note on are dropped."""
    flagged = by_document(lines, partitions).withColumn("art", F.col("line").rlike(markers.article))
    seen = flagged.withColumn("in_article", F.max("art").over(_doc()))
    with_end = seen.withColumn("ended", F.max(F.col("in_article") & ~F.col("art") & F.col("line").rlike(markers.note)).over(_doc()))
    kept = with_end.filter(~F.col("ended"))
    cls = F.when(F.col("art"), "article").when(~F.col("in_article"), "none").when(F.col("line").rlike(markers.clause), "clause").when(F.col("line").rlike(markers.point), "point").otherwise("text")
    return kept.withColumn("cls", cls).drop("in_article", "ended", "art")


def inside(lines: DataFrame, markers: Markers) -> DataFrame:
    """Classified lines within articles, with chunk_seq, article_seq and the article, clause and point that each stands in. All windows run over one order of a document's lines, so they share one sort."""
    kind = F.col("cls")
    lines = lines.filter(kind != "none")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(_doc())
    # a new article ends a clause, and both end a point
    value = lambda own, pattern, *ends: F.when(kind == own, F.struct(F.regexp_extract("line", pattern, 1).alias("v"))).when(kind.isin(*ends), F.struct(F.lit(None).cast("string").alias("v")))
    last = lambda c: F.last(c, True).over(_doc())["v"]
    return (
        lines.withColumn("article_seq", count(kind == "article")).withColumn("chunk_seq", count(kind != "text"))
        .withColumn("article", last(value("article", markers.article, "none")))
        .withColumn("clause", last(value("clause", markers.clause, "article")))
        .withColumn("point", last(value("point", markers.point, "article", "clause")))
    )


def occurrence() -> Column:
    """Which of the articles of the same number it is."""
    return F.dense_rank().over(Window.partitionBy("doc_id", "article").orderBy("article_seq"))


def filled(lines: DataFrame, markers: Markers) -> DataFrame:
    """Classified lines within articles, with the article (and which of the same number it is), clause and point that each stands in, and chunk_seq."""
    return inside(lines, markers).withColumn("occurrence", occurrence())


def article_id() -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit("_D"), F.col("article"), F.when(F.col("occurrence") > 1, F.concat(F.lit("_O"), F.col("occurrence").cast("string"))).otherwise(""))


def chunks(lines: DataFrame, markers: Markers, prefixed: bool = False, partitions: int = 0) -> DataFrame:
    """chunk_id, doc_id, article_id, chunk_type, ord, parent_id, content of each chunk.

    An article line that no text follows goes to the article's first clause or point, and stays alone only if there is
    none. Ids that come again in a document get ``_C2`` and so on. prefixed puts the location before the content.
    partitions: see ``by_document``.
    """
    within = inside(classified(lines, markers, partitions), markers)
    starts = F.col("cls") != "text"
    within = within.withColumn("title", (F.col("cls") == "article") & F.coalesce(F.lead("cls").over(_doc()).isin("clause", "point"), F.lit(False)))
    within = within.withColumn("ord", (F.sum(F.when(starts & ~F.col("title"), 1).otherwise(0)).over(_doc()) - 1).cast("int"))
    within = within.withColumn("seq", F.col("chunk_seq") + F.col("title").cast("int"))
    # what a chunk's first line says, which after a title is the second one
    head = F.when(starts & ~F.col("title"), F.struct("article", "article_seq", F.col("cls").alias("opens"), "clause", "point", "ord"))
    made = within.groupBy("doc_id", "seq").agg(
        F.first(head, True).alias("m"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    made = made.select("doc_id", "seq", "m", "content", "m.article", "m.article_seq").withColumn("occurrence", occurrence()).withColumn("article_id", article_id())
    kind = F.when(F.col("m.opens") == "article", "dieu_preamble").when(F.col("m.opens") == "clause", "khoan").otherwise("diem")
    clause = F.when(F.col("m.clause").isNotNull() & (F.col("m.opens") != "article"), F.concat(F.lit("_K"), F.col("m.clause"))).otherwise("")
    point = F.when(F.col("m.opens") == "point", F.concat(F.lit("_P"), F.col("m.point"))).otherwise("")
    base = F.concat(F.col("article_id"), F.when(F.col("m.opens") == "article", F.lit("_preamble")).otherwise(F.concat(clause, point)))
    made = made.withColumn("chunk_type", kind).withColumn("base", base)
    nth = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("seq"))
    made = made.withColumn("nth", nth)
    head = F.concat(F.lit("["), F.when(F.col("chunk_type") == "diem", F.concat(F.lit("Điểm "), "m.point", F.lit(", "))).otherwise(""), F.when((F.col("chunk_type") != "dieu_preamble") & F.col("m.clause").isNotNull(), F.concat(F.lit("Khoản "), "m.clause", F.lit(", "))).otherwise(""), F.lit("Điều "), "m.article", F.lit(", "), F.col("doc_id").cast("string"), F.lit("] "))
    return made.select(
        F.concat("base", F.when(F.col("nth") > 1, F.concat(F.lit("_C"), F.col("nth").cast("string"))).otherwise("")).alias("chunk_id"), "doc_id", "article_id", "chunk_type", "m.ord",
        F.concat("article_id", F.lit("_PARENT")).alias("parent_id"), (F.concat(head, "content") if prefixed else F.col("content")).alias("content"),
    )


def parents(chunks: DataFrame) -> DataFrame:
    """A row for each article: its chunks' contents in order, joined by line feeds, and the first one's type."""
    return chunks.groupBy("doc_id", "article_id", "parent_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n").alias("content"), F.min_by("chunk_type", "ord").alias("first_type"), F.count("*").alias("n_chunks"),
    )


def expand_parents(hits: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """hits (query_id, rank, chunk_id): the parents that they lie in, each once, in the order of the first hit."""
    first = hits.join(chunks.select("chunk_id", "parent_id"), "chunk_id").groupBy("query_id", "parent_id").agg(F.min("rank").alias("first_rank"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", "parent_id"))
    return first.join(parents.select("parent_id", "content"), "parent_id").withColumn("pos", order)


def first_parents(ranked: DataFrame, n: int) -> DataFrame:
    """Chunks with their rank in the document, which is the query: the parents of its n first chunks, each once, in the order of the first one.

    As ``expand_parents``, but all of it lies with the document, so that chunks that are dealt by document are read once and not shuffled again.
    """
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n")
    of = ranked.groupBy("doc_id", "article_id", "parent_id").agg(F.min("rank").alias("first_rank"), whole.alias("content")).filter(F.col("first_rank") <= n)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_rank", "parent_id"))
    return of.select(F.col("doc_id").alias("query_id"), "parent_id", "first_rank", order.alias("pos"), "content")


def canonical(article: Column) -> Column:
    """Article id without the mark of a repeated number."""
    return F.regexp_replace(article, "_O[0-9]+$", "")


def article_parts(chunks: DataFrame) -> DataFrame:
    """How many chunks a canonical article has, over all articles of its number."""
    return chunks.groupBy(canonical(F.col("article_id")).alias("article_id")).agg(F.countDistinct("chunk_id").alias("parts"))


def article_lookup(parents: DataFrame) -> DataFrame:
    """Text of a canonical article: that of the last one of its number."""
    nth = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("article_id", "_O([0-9]+)$", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(1))
    return parents.groupBy(canonical(F.col("article_id")).alias("article_id")).agg(F.max_by("content", nth).alias("content"))


def source_map(parents: DataFrame) -> DataFrame:
    """Lower-case article id to text: those of all articles that share it, in order."""
    lowered = F.lower(canonical(F.col("article_id")))
    return parents.groupBy(lowered.alias("article_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_id", "content"))), lambda x: x["content"]), "\n").alias("content"))
