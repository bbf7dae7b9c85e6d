"""Line dedup with levelled sorted runs of line hashes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import columns, cut
from lexmill.llm.simhash import lower_ascii

EDGE = " \t\n\u000b\f\r"
HASH = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """Keys of a text's lines in order: ASCII whitespace stripped at both ends, A-Z in lower case."""
    return F.transform(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n"), lambda line: F.btrim(line, F.lit(EDGE)))


def hashes(key: Column) -> list[Column]:
    """128 bits of a key in two longs."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """In how many documents each line hash was found, as levels of sorted runs.

    ``add`` takes a batch. Hashes that the runs already have in min_docs documents are settled: the batch is
    merge-anti-joined with them, and what is left of it is added as a run of level 0. When a level has fanout runs,
    they are merged into one of the next level. So a batch of a table of n batches is rewritten about log(n) times, and
    lines that everyone has cost nothing after their first batch. Runs are checkpointed: each is sorted and dealt by
    hash.
    """

    def __init__(self, min_docs: int = 10, fanout: int = 4) -> None:
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return both.groupBy(*HASH).agg(F.sum("n").alias("n"))

    def settled(self) -> DataFrame:
        """Hashes found in min_docs documents or more."""
        return self.merged(self.runs()).filter(F.col("n") >= self.min_docs).select(*HASH)

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, a row for each document and hash of it."""
        run = batch.groupBy(*HASH).agg(F.count("*").alias("n"))
        if self.runs():
            run = run.join(self.settled().hint("merge"), HASH, "left_anti")
        self._put(0, run)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(cut(run.sortWithinPartitions(*HASH)))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self.merged(full))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 6) -> DataFrame:
    """Drops each line whose key has min_chars code points or more and is found in min_docs documents or more, in all of them.

    A key is a line without ASCII whitespace at its ends, A-Z lower-cased. Documents (rows) are added to the runs in
    batches; each line is judged against the runs of all of them. Returns a row for each row of docs: doc_id, n_lines,
    n_dropped, kept_sha256 and text (the kept lines, joined by a line feed).

    Defined cases: a null or empty text has one empty line; empty keys stay; a text that loses all its lines is empty;
    repeated rows are documents of their own; rows with a null doc_id are cleaned like others; a very long text is split and joined as a whole, by one task;
    an empty table gives an
    empty table; other columns are ignored.
    """
    docs = columns(docs, doc_id="long", text="string")
    found = docs.select("doc_id", F.explode(F.array_distinct(line_keys(F.col("text")))).alias("key")).filter(F.length("key") >= min_chars)
    found = cut(found.select("doc_id", *hashes(F.col("key")), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("part")))
    runs = LineRuns(min_docs)
    for b in range(batches):
        runs.add(found.filter(F.col("part") == b).select(*HASH))
    common = cut(runs.settled())
    of_doc = found.join(common, HASH).groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("h1").alias("common"))
    cleaned = docs.join(of_doc, docs["doc_id"].eqNullSafe(of_doc["id"]), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    cleaned = cleaned.select("doc_id", F.col("common").isNull().alias("whole"), F.coalesce("text", F.lit("")).alias("text"), lines.alias("lines"), F.when(F.col("common").isNotNull(), F.transform(line_keys(F.col("text")), lambda key: (F.length(key) >= min_chars) & F.array_contains("common", F.xxhash64(key)))).alias("gone"))
    cleaned = cleaned.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("whole"), F.lit(0)).otherwise(F.size(F.filter("gone", lambda g: g))).cast("long").alias("n_dropped"), F.when(F.col("whole"), F.col("text")).otherwise(F.array_join(F.filter("lines", lambda _, i: ~F.get("gone", i)), "\n")).alias("text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text")


ORACLE = r"""
WITH lines AS (
  SELECT rowid AS row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), keys AS (
  SELECT row, doc_id, k, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keys WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM keys LEFT JOIN common ON keys.key = common.key
GROUP BY row, doc_id
"""
