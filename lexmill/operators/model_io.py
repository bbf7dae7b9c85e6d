"""Model output as data: parsing of raw answers, verdicts, audits, and a scorer that users plug in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_text(output: Column) -> Column:
    """The JSON object or array in a model's output: after its thinking, in the last fence if there is one, else from the first brace on."""
    bare = F.regexp_replace(output, r"(?s)<thinking>.*?</thinking>", "")
    fenced = F.regexp_extract(bare, r"(?s).*```(?:json)?\s*(.*?)\s*```", 1)
    loose = F.regexp_extract(bare, r"(?s)([\{\[].*)", 1)
    return F.trim(F.when(fenced != "", fenced).otherwise(loose))


def closed(text: str, most: int = 400) -> str | None:
    """A JSON text whose end is missing, closed after its last whole value; null if its last most characters don't hold the end of one."""
    for end in range(len(text), max(0, len(text) - most), -1):
        part, stack, quoted, skip = text[:end].rstrip().rstrip(","), [], False, False
        for c in part:
            if skip or (quoted and c == "\\"):
                skip = not skip
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{[":
                stack.append("}" if c == "{" else "]")
            elif not quoted and c in "}]" and stack:
                stack.pop()
        if quoted or not part or part[-1] in "{[":
            continue
        whole = part + "".join(reversed(stack))
        try:
            json.loads(whole)
        except ValueError:
            continue
        return whole
    return None


def parsed_outputs(outputs: DataFrame) -> DataFrame:
    """outputs (id, text): id, json and status (parsed, repaired or failed). Spark reads what is whole; only the rest goes to Python."""
    tried = outputs.select("id", json_text(F.coalesce("text", F.lit(""))).alias("json"))
    tried = tried.withColumn("whole", (F.col("json") != "") & F.try_parse_json("json").isNotNull())
    good = tried.filter("whole").select("id", "json", F.lit("parsed").alias("status"))

    def repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fixed = [closed(x) if x else None for x in b.json]
            yield pd.DataFrame({"id": b.id, "json": fixed, "status": ["failed" if x is None else "repaired" for x in fixed]})

    return good.unionByName(tried.filter("NOT whole").select("id", "json").mapInPandas(repaired, "id long, json string, status string"))


def verdicts(answers: DataFrame, text: str = "text") -> DataFrame:
    """answers with relevant: whether the text says yes."""
    return answers.withColumn("relevant", F.contains(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("yes")))


def unknown_ids(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Of each chunk: how many relations, and how many have an end that is no entity of the chunk."""
    ids = entities.select("chunk_id", "id").distinct()
    s, d = ids.select("chunk_id", F.col("id").alias("src"), F.lit(True).alias("s")), ids.select("chunk_id", F.col("id").alias("dst"), F.lit(True).alias("d"))
    of = relations.join(s, ["chunk_id", "src"], "left").join(d, ["chunk_id", "dst"], "left")
    return of.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if(F.col("s").isNull() | F.col("d").isNull()).alias("unknown"))


def scored(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], name: str, kind: str) -> DataFrame:
    """rows with a column that scorer gives for each batch of them."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{name}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: scorer(b)})

    return rows.mapInPandas(run, schema)
