"""Completeness critic: what a retrieval missed, for all queries at once. Verdicts of a model are rows of a judgments table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.graph_query import closure, hop, joined
from lexmill.session import cut

#: The order in which kinds of gaps are looked at.
PRIORITY = {"reference": 0, "compound": 1, "structural": 2}


def article_of(node: Column) -> Column:
    return F.regexp_extract(node, r"^(.+_D\d+[a-zA-Z]*)(?:_K\d+)?(?:_P[a-zA-Z0-9]+)?$", 1)


def article_edges(edges: DataFrame) -> DataFrame:
    """References lifted to articles, without those of an article to itself."""
    e = edges.filter("rel = 'THAM_CHIEU'").select(article_of(F.col("src")).alias("a"), article_of(F.col("dst")).alias("b"))
    return e.filter("a <> '' AND b <> '' AND a <> b").distinct()


def missing_references(focus: DataFrame, hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Articles that a query's focus refers to, or that refer to it, and that it hasn't retrieved at all: one row each, outgoing before incoming."""
    e = article_edges(edges)
    out = focus.join(e.withColumnRenamed("a", "article_id"), "article_id").select("query_id", F.col("b").alias("missing"), F.lit(0).alias("dir"), F.col("article_id").alias("related"))
    back = focus.join(e.withColumnRenamed("b", "article_id"), "article_id").select("query_id", F.col("a").alias("missing"), F.lit(1).alias("dir"), F.col("article_id").alias("related"))
    have = hits.select("query_id", F.col("article_id").alias("missing")).distinct()
    lost = out.unionByName(back).join(have, ["query_id", "missing"], "left_anti")
    first = lost.groupBy("query_id", "missing").agg(F.min(F.struct("dir", "related")).alias("m"))
    return first.select("query_id", F.col("missing").alias("article_id"), F.when(F.col("m.dir") == 0, "outgoing").otherwise("incoming").alias("direction"), F.col("m.related").alias("related"))


def compound_penalties(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """Behaviours up to four structure steps below an article that have a main and an additional penalty."""
    lists = None
    for rel, name in (("CHE_TAI_CHINH", "main"), ("CHE_TAI_BO_SUNG", "additional")):
        own = hop(edges, rel).groupBy(F.col("src").alias("behaviour")).agg(joined("dst").alias(name))
        lists = own if lists is None else lists.join(own, "behaviour")
    below = closure(edges, articles, 4)
    regulated = edges.filter("rel = 'QUY_DINH_HANH_VI'").select(F.col("src").alias("node_id"), F.col("dst").alias("behaviour"))
    # only behaviours with both lists are carried on
    return below.join(regulated.join(lists, "behaviour"), "node_id").select("article_id", "behaviour", "main", "additional").distinct()


def structural_gaps(hits: DataFrame, focus: DataFrame, totals: DataFrame) -> DataFrame:
    """Articles of the focus with over one part (totals: article_id, parts) of which fewer were retrieved."""
    got = hits.groupBy("query_id", "article_id").agg(F.countDistinct("chunk_id").alias("retrieved"))
    of = focus.join(totals, "article_id").join(got, ["query_id", "article_id"], "left")
    return of.select("query_id", "article_id", "parts", F.coalesce("retrieved", F.lit(0)).cast("long").alias("retrieved")).filter("parts > 1 AND retrieved < parts")


def total_parts(graph: DataFrame, chunks: DataFrame) -> DataFrame:
    """Parts of each article: the larger count of the graph's and the chunk index's (each article_id, parts), as either may lack some."""
    return graph.unionByName(chunks).groupBy("article_id").agg(F.max("parts").alias("parts"))


def gaps(refs: DataFrame, compound: DataFrame, structural: DataFrame) -> DataFrame:
    """All gaps of all queries: query_id, gap_type, article_id."""
    one = lambda df, kind: df.select("query_id", F.lit(kind).alias("gap_type"), "article_id").distinct()
    return one(refs, "reference").unionByName(one(compound, "compound")).unionByName(one(structural, "structural"))


def suggestions(found: DataFrame) -> DataFrame:
    """A suggestion for each gap; a structural one only if the article has no compound one."""
    compound = found.filter("gap_type = 'compound'").select("query_id", "article_id")
    structural = found.filter("gap_type = 'structural'").join(compound, ["query_id", "article_id"], "left_anti").select("query_id", "gap_type", "article_id")
    return found.filter("gap_type <> 'structural'").unionByName(structural)


def _said(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def reason_of_reference() -> Column:
    """Of a row of ``missing_references``. The sentences."""
    article, related = F.col("article_id"), F.col("related")
    outgoing = _said("Đã lấy '", related, "' nhưng nó tham chiếu tới '", article, "' (Điều ", article, ") chưa được lấy.")
    incoming = _said("'", article, "' (Điều ", article, ") tham chiếu áp dụng vào '", related, "' đã lấy, nhưng ", article, " chưa được lấy — có thể chứa hình phạt bổ sung/điều kiện liên quan.")
    return F.when(F.col("direction") == "outgoing", outgoing).otherwise(incoming)


def reason_of_compound() -> Column:
    """Of a row of ``compound_penalties``. The sentence."""
    return _said("Hành vi '", F.col("behaviour"), "' trong Điều ", F.col("article_id"), " có CẢ hình phạt chính lẫn bổ sung trong tri thức đồ thị — 2 phần này thường nằm ở 2 Khoản khác nhau nên top-k dễ chỉ lấy được 1 phần, cần lấy lại toàn văn Điều.")


def reason_of_structure() -> Column:
    """Of a row of ``structural_gaps``. The sentence."""
    parts, got = F.col("parts").cast("string"), F.col("retrieved").cast("string")
    return _said("Điều ", F.col("article_id"), " có ", parts, " Khoản/Điểm trong graph nhưng chỉ retrieve được ", got, " phần — nội dung liên quan có thể nằm ở Khoản/Điểm khác chưa lấy được, cần lấy lại toàn văn Điều.")


def reasons(refs: DataFrame, compound: DataFrame, structural: DataFrame) -> DataFrame:
    """query_id, kind (0 to 2), article_id, behaviour and reason of each suggestion; a structural one only if the article has no compound one."""
    rest = structural.join(compound.select("query_id", "article_id").distinct(), ["query_id", "article_id"], "left_anti")
    one = lambda df, kind, behaviour, reason: df.select("query_id", F.lit(kind).alias("kind"), "article_id", behaviour.alias("behaviour"), reason.alias("reason"))
    return one(refs, 0, F.lit(""), reason_of_reference()).unionByName(one(compound, 1, F.col("behaviour"), reason_of_compound())).unionByName(one(rest, 2, F.lit(""), reason_of_structure()))


def reader_report(queries: DataFrame, articles: DataFrame, why: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id and report, the text that a reader is shown: which articles were added and which were turned down, and why any were looked at.

    queries: query_id and is_complete; articles: query_id, article_id and accepted; why: see ``reasons``; labels:
    query_id, article_id and label, names that stand for ids, also within reasons, longer ids first. Queries with neither
    articles nor reasons have an empty report.
    """
    names = labels.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("article_id")).alias("size"), "article_id", "label"))).alias("names"))
    named = articles.join(labels, ["query_id", "article_id"], "left").select("query_id", "accepted", "article_id", F.coalesce("label", "article_id").alias("name"))
    of = named.groupBy("query_id").agg(*(F.array_sort(F.collect_list(F.when(cond, F.struct("article_id", "name")))).alias(c) for c, cond in (("added", F.col("accepted")), ("refused", ~F.col("accepted")))))
    told = why.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("kind", "article_id", "behaviour", "reason"))).alias("told"))
    all_of = queries.select("query_id", "is_complete").distinct().join(of, "query_id", "left").join(told, "query_id", "left").join(names, "query_id", "left")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    listed = lambda c, line: F.array_join(F.transform(c, line), "")

    def plain(text: Column) -> Column:
        replaced = F.aggregate("names", text, lambda t, x: F.replace(F.replace(t, F.concat(F.lit("Điều "), x["article_id"]), x["label"]), x["article_id"], x["label"]))
        return F.when(F.col("names").isNull(), text).otherwise(replaced)

    # The sentences of the report
    name_line, count = lambda x: _said("\n- ", x["name"]), lambda c: F.size(c).cast("string")
    added = _said("**Tìm kiếm ban đầu CHƯA ĐỦ → Critic Agent đã tự bổ sung.**\n\n✅ **Đã bổ sung toàn văn (", count("added"), " Điều):**", listed("added", name_line))
    refused = _said("\n\n⛔ **Đã loại vì không liên quan tới câu hỏi (", count("refused"), " Điều):**", listed("refused", name_line))
    signs = _said("\n\n📌 **Dấu hiệu thiếu mà Knowledge Graph phát hiện:**", listed("told", lambda x: _said("\n- ", plain(x["reason"]))))
    flag = F.when(F.col("is_complete"), "True").when(~F.col("is_complete"), "False").otherwise("None")
    note = _said("\n\n_Ghi chú kỹ thuật: is_complete=", flag, " — cờ này chấm bước tìm kiếm top-k BAN ĐẦU, không phải câu trả lời cuối, và không được tính lại sau khi Critic Agent bổ sung xong._")
    text = F.concat(F.when(some("added"), added).otherwise("**Tìm kiếm ban đầu đã đủ — Critic Agent không phải bổ sung gì.**"), F.when(some("refused"), refused).otherwise(""), F.when(some("told"), signs).otherwise(""), note)
    return all_of.select("query_id", F.when(some("added") | some("refused") | some("told"), text).otherwise("").alias("report"))


def report_text(queries: DataFrame, refs: DataFrame, compound: DataFrame) -> DataFrame:
    """query_id and report, the text that a model is given: what is missing by references (see ``missing_references``), behaviours with two kinds of penalties (query_id and ``compound_penalties``), and what to fetch."""
    article = F.col("article_id")
    # The sentences of the report
    detail = _said("• Điều ", article, " - Hành vi: ", F.col("behaviour"), "\n  Chính: ", F.coalesce("main", F.lit("(không có trong graph)")), "\n  Bổ sung: ", F.coalesce("additional", F.lit("(không có trong graph)")))
    lines = refs.select("query_id", F.struct(F.lit(0).alias("kind"), article.alias("article"), F.lit("").alias("behaviour"), reason_of_reference().alias("reason"), F.lit("").alias("detail")).alias("line"))
    lines = lines.unionByName(compound.select("query_id", F.struct(F.lit(1).alias("kind"), article.alias("article"), "behaviour", reason_of_compound().alias("reason"), detail.alias("detail")).alias("line")))
    of = lines.groupBy("query_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    missed, both = F.filter("lines", lambda x: x["kind"] == 0), F.filter("lines", lambda x: x["kind"] == 1)

    def part(title: str, some: Column) -> Column:
        return F.when(F.size(some) > 0, F.concat(F.lit(f"\n\n--- {title} ---\n"), F.array_join(some, "\n"))).otherwise("")

    advice = F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". [retrieve] "), x["reason"], F.lit(" (Điều: "), x["article"], F.lit(")")))
    found = F.concat(F.lit("⚠️ Phát hiện "), F.size(missed).cast("string"), F.lit(" Điều cần retrieve thêm, "), F.size(both).cast("string"), F.lit(" hành vi có chế tài kép (chính+bổ sung) cần lấy lại toàn văn Điều:\n"))
    found = F.concat(found, part("Các tham chiếu bị thiếu", F.transform(missed, lambda x: F.concat(F.lit("• "), x["reason"]))), part("Hành vi có chế tài kép chính+bổ sung (cần lấy lại toàn văn Điều)", F.transform(both, lambda x: x["detail"])), part("Khuyến nghị", advice))
    complete = F.lit("✅ Retrieval đầy đủ: Không phát hiện thông tin bị thiếu từ graph.\n")
    said = F.concat(F.lit("=== KNOWLEDGE GRAPH ANALYSIS ===\n\n"), F.when(F.col("lines").isNull(), complete).otherwise(found))
    return queries.select("query_id").distinct().join(of, "query_id", "left").select("query_id", said.alias("report"))


def report(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Of each query: whether its retrieval is complete, its gaps by kind, and how many suggestions follow."""
    by = found.groupBy("query_id").agg(*(joined(F.when(F.col("gap_type") == k, F.col("article_id"))).alias(k) for k in PRIORITY))
    n = suggestions(found).groupBy("query_id").agg(F.count("*").alias("n_suggestions"))
    out = queries.select("query_id").distinct().join(by, "query_id", "left").join(n, "query_id", "left")
    return out.select("query_id", F.coalesce(*PRIORITY).isNull().alias("is_complete"), *PRIORITY, F.coalesce("n_suggestions", F.lit(0)).cast("long").alias("n_suggestions"))


def gated(candidates: DataFrame, judgments: DataFrame, texts: DataFrame) -> DataFrame:
    """candidates (query_id, article_id) with accepted: the verdict on it, true without one, false without a text."""
    verdict = judgments.select("query_id", F.col("unit_id").alias("article_id"), "relevant").groupBy("query_id", "article_id").agg(F.max("relevant").alias("relevant"))
    have = texts.filter("content <> ''").select("article_id").distinct().withColumn("has_text", F.lit(True))
    of = candidates.join(verdict, ["query_id", "article_id"], "left").join(have, "article_id", "left")
    return of.withColumn("accepted", F.col("has_text").isNotNull() & F.coalesce("relevant", F.lit(True))).drop("relevant", "has_text")


def any_relevant(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """query_id, article_id and whether any of its retrieved chunks passes; chunks without a verdict pass."""
    verdict = judgments.select("query_id", F.col("unit_id").alias("chunk_id"), "relevant")
    return hits.join(verdict, ["query_id", "chunk_id"], "left").groupBy("query_id", "article_id").agg(F.max(F.coalesce("relevant", F.lit(True))).alias("passes"))


def round_one(found: DataFrame, hits: DataFrame, judgments: DataFrame, texts: DataFrame) -> DataFrame:
    """Which gaps are filled: references if the article's text is relevant, others if a retrieved chunk is, or the text where none was retrieved. One row for each query and article, by the first kind accepted; without a cap."""
    by_text = gated(found, judgments, texts)
    by_chunk = any_relevant(hits, judgments)
    ok = by_text.join(by_chunk, ["query_id", "article_id"], "left").withColumn("ok", F.when(F.col("gap_type") == "reference", F.col("accepted")).otherwise(F.coalesce("passes", "accepted")))
    rank = F.when(F.col("gap_type") == "reference", 0).when(F.col("gap_type") == "compound", 1).otherwise(2)
    w = Window.partitionBy("query_id", "article_id").orderBy(F.desc("ok"), rank)
    return ok.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "article_id", "gap_type", F.col("ok").alias("accepted"))


def multi_hop(fetched: DataFrame, hits: DataFrame, edges: DataFrame, judgments: DataFrame, texts: DataFrame, most: int, hops: int = 2) -> DataFrame:
    """Articles that the fetched ones refer to, over up to hops steps: query_id, article_id, hop, accepted.

    Each step looks at references out of what the step before accepted, except what the query knows already (retrieved,
    fetched or rejected). A query takes no more once it has 2 x most fetched articles.
    """
    e, fetched = cut(article_edges(edges)), cut(fetched)  # read by each step; plans would double with every hop
    known = hits.select("query_id", "article_id").unionByName(fetched.select("query_id", "article_id")).distinct()
    counts = fetched.groupBy("query_id").agg(F.count("*").alias("had"))
    frontier, out = fetched.select("query_id", "article_id"), None
    for h in range(1, hops + 1):
        new = frontier.join(e.withColumnRenamed("a", "article_id"), "article_id").select("query_id", F.col("b").alias("article_id")).distinct().join(known, ["query_id", "article_id"], "left_anti")
        judged = gated(new, judgments, texts)
        before = F.coalesce(F.sum(F.col("accepted").cast("int")).over(Window.partitionBy("query_id").orderBy("article_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        step = judged.join(counts, "query_id", "left").withColumn("before", before + F.coalesce("had", F.lit(0))).filter(F.col("before") < 2 * most).select("query_id", "article_id", F.lit(h).alias("hop"), "accepted")
        step = cut(step)
        out = step if out is None else out.unionByName(step)
        known = known.unionByName(step.select("query_id", "article_id"))
        frontier = step.filter("accepted").select("query_id", "article_id")
        counts = counts.unionByName(frontier.groupBy("query_id").agg(F.count("*").alias("had"))).groupBy("query_id").agg(F.sum("had").alias("had"))
    return out


def mixed_document_guard(hits: DataFrame, fetched: DataFrame) -> DataFrame:
    """Queries that fetched nothing although two documents or more were retrieved: their first article is repeated."""
    docs = hits.groupBy("query_id").agg(F.countDistinct("van_ban_id").alias("n_documents"), F.min_by("article_id", "rank").alias("article_id"))
    return docs.filter("n_documents >= 2").join(fetched.select("query_id"), "query_id", "left_anti")


def critic_context(accepted: DataFrame, texts: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Texts of the accepted articles of each query under headers by kind, in order of kind and id."""
    head = F.create_map(*(F.lit(x) for kv in headers.items() for x in kv))
    rank = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    of = accepted.filter("accepted").join(texts, "article_id").select("query_id", F.struct(rank[F.col("gap_type")].alias("r"), "article_id", F.concat(head[F.col("gap_type")], F.lit("\n"), "content").alias("t")).alias("x"))
    return of.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("context"))


def mode_contexts(naive: DataFrame, expanded: DataFrame, critic: DataFrame) -> DataFrame:
    """The contexts of three modes; only the critic's, where it has one, makes a new answer necessary."""
    c = naive.select("query_id", "context").join(critic.select("query_id", F.col("context").alias("more")), "query_id", "left")
    c = c.select("query_id", F.lit("critic").alias("mode"), F.concat_ws("\n\n", "context", "more").alias("context"), (F.coalesce("more", F.lit("")) != "").alias("regenerate"))
    plain = lambda df, m: df.select("query_id", F.lit(m).alias("mode"), "context", F.lit(False).alias("regenerate"))
    return plain(naive, "naive").unionByName(plain(expanded, "article_expand")).unionByName(c)


def trace_evidence(found: DataFrame, decided: DataFrame, hits: DataFrame) -> DataFrame:
    """Of each query: kinds of gaps, candidates in order of their first kind, accepted and rejected articles, and what it ends with."""
    rank = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    cand = found.groupBy("query_id", "article_id").agg(F.min(rank[F.col("gap_type")]).alias("r"))
    listed = cand.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "article_id"))), lambda x: x["article_id"]), ",").alias("candidates"))
    kinds = found.groupBy("query_id").agg(joined("gap_type").alias("gap_types"))
    verdicts = decided.groupBy("query_id").agg(joined(F.when(F.col("accepted"), F.col("article_id"))).alias("accepted"), joined(F.when(~F.col("accepted"), F.col("article_id"))).alias("rejected"))
    final = hits.select("query_id", "article_id").unionByName(decided.filter("accepted").select("query_id", "article_id")).groupBy("query_id").agg(joined("article_id").alias("final"))
    return final.join(kinds, "query_id", "left").join(listed, "query_id", "left").join(verdicts, "query_id", "left")


def required_citations(items: DataFrame) -> DataFrame:
    """items (query_id, pos, article_id, label, reason): the first of each article."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "article_id").orderBy("pos"))).filter("_n = 1 AND article_id <> ''").drop("_n")


def missing_citations(required: DataFrame, answers: DataFrame) -> DataFrame:
    """Required articles that an answer doesn't name: by whole number, or by label for ids without one."""
    number = F.regexp_extract("article_id", r"_D(\d+[A-Za-z]*)$", 1)
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])Điều\s+"), number, F.lit(r"(?![\p{L}\p{N}_])"))
    named = F.when(number != "", F.rlike("answer", pattern)).otherwise(F.contains(F.lower("answer"), F.lower("label")))
    of = required.join(answers, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    return of.filter(~named).drop("answer")


def citation_contract(required: DataFrame, head: str) -> DataFrame:
    """Of each query, the articles that its answer must name, one a line."""
    line = F.concat(F.lit("- "), "label", F.lit(": "), "reason")
    of = required.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))).alias("x"))
    return of.select("query_id", F.concat(F.lit(head + "\n"), F.array_join(F.transform("x", lambda x: x["t"]), "\n")).alias("contract"))
