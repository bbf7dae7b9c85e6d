"""Scalar functions over ids and texts, as Column expressions."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented letters by the letter that replaces them in folded ids.
FOLDED = {
    "a": "àáảãạăắặẳẵằâấậẩẫầ", "e": "èéẻẽẹêếệểễề", "i": "ìíỉĩị", "o": "òóỏõọôốộổỗồơớợởỡờ", "u": "ùúủũụưứựửữừ",
    "y": "ỳýỷỹỵ", "d": "đ", "D": "Đ", "A": "ÀÁẢÃẠ",
}
ACCENTED = "".join(FOLDED.values())
PLAIN = "".join(k * len(v) for k, v in FOLDED.items())

#: Fixed values: ``[Điểm p, Khoản k, Điều d, document] `` before a chunk's text.
LOCATION = r"(?iu)^\[(?:Điểm\s+([a-zđ]),\s*)?(?:Khoản\s+(\d+),\s*)?Điều\s+(\d+[a-zA-Z]*),[^\]]*\]\s*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")


def slug_id(name: Column | str) -> Column:
    """File name without its extension, every run of other characters than ASCII letters and digits as one underscore."""
    return _slug(F.regexp_replace(_col(name), r"(?<=.)\.[^./]*$", ""))


def graph_document_id(name: Column | str) -> Column:
    """Document id of the graph: a slug in lower case; only ``.docx`` counts as an extension."""
    return F.lower(_slug(F.regexp_replace(_col(name), r"(?i)\.docx$", "")))


def fold_id(text: Column | str) -> Column:
    """Snake-case id without accents. Accented capitals beyond the folded ones become underscores."""
    plain = F.lower(F.translate(_col(text), ACCENTED, PLAIN))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9_]+|_+", "_"), "^_+|_+$|(?<=_)_+", "")


def article_no(raw_id: Column | str) -> Column:
    """Article number (text, as ``25a``) of an article or parent id; null if it has none."""
    return F.nullif(F.regexp_extract(_col(raw_id), r"_D(\d+[a-zA-Z]*)(?:_O\d+)?(?:_PARENT)?$", 1), F.lit(""))


def canonical_article(document: Column | str, raw_id: Column | str) -> Column:
    """Article id of the graph for an id of the index; null without an article number."""
    return F.concat(graph_document_id(document), F.lit("_D"), article_no(raw_id))


def owning_article(node_id: Column | str, label: Column | str, chunk_id: Column | str, document: Column | str) -> Column:
    """The article that a node belongs to: by its own id for articles, clauses and points, by its chunk for others."""
    own = F.nullif(F.regexp_extract(_col(node_id), r"^(.+_D\d+[a-zA-Z]*)(?:_K\d+)?(?:_P[a-zA-Z0-9]+)?$", 1), F.lit(""))
    return F.when(_col(label).isin("Dieu", "Khoan", "Diem"), own).otherwise(canonical_article(document, chunk_id))


def point_id(raw: Column | str) -> Column:
    """UUID version 5 of an id in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(_col(raw), "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def location(content: Column | str) -> dict[str, Column]:
    """article, clause and point that the prefix of a chunk's text names; null where it doesn't."""
    c = _col(content)
    part = lambda k: F.nullif(F.regexp_extract(c, LOCATION, k), F.lit(""))
    return {"point": part(1), "clause": part(2), "article": part(3)}


def strip_location(content: Column | str) -> Column:
    return F.regexp_replace(_col(content), LOCATION, "")


def node_id(document: Column | str, article: Column | str, clause: Column | str, point: Column | str) -> Column:
    return F.concat(_col(document), F.lit("_D"), _col(article), F.when(_col(clause).isNotNull(), F.concat(F.lit("_K"), _col(clause))).otherwise(""), F.when(_col(point).isNotNull(), F.concat(F.lit("_P"), _col(point))).otherwise(""))


def article_label(article_id: Column | str, content: Column | str) -> Column:
    """``Điều n — document`` from the prefix of a text, else the id."""
    pattern = r"^\s*\[[^\]]*?Điều\s+([^,\]]+),\s*([^\]]+)\]"
    c = F.coalesce(_col(content), F.lit(""))
    found = F.concat(F.lit("Điều "), F.trim(F.regexp_extract(c, pattern, 1)), F.lit(" — "), F.trim(F.regexp_extract(c, pattern, 2)))
    return F.when(c.rlike(pattern), found).otherwise(_col(article_id))


def citation_label(article_id: Column | str) -> Column:
    """``Điều n`` for a canonical article id, else the id."""
    number = F.regexp_extract(_col(article_id), r"_D(\d+[A-Za-z]*)$", 1)
    return F.when(number != "", F.concat(F.lit("Điều "), number)).otherwise(_col(article_id))


def shorten(text: Column | str, n: int = 200) -> Column:
    """Whitespace runs as one space, cut after n characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(_col(text), r"[\s]+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n)), F.lit("..."))).otherwise(flat)


def humanize(text: Column | str, labels: Column | str) -> Column:
    """text with ids replaced by labels. labels: array of structs (id, label); longer ids first, so that none is cut by its own prefix."""
    ordered = F.array_sort(_col(labels), lambda a, b: F.when(F.length(a["id"]) != F.length(b["id"]), F.length(b["id"]) - F.length(a["id"])).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return F.aggregate(ordered, _col(text), lambda t, x: F.replace(t, x["id"], x["label"]))


#: Runs of letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores of any script, in Unicode form NFKC."""
    return F.regexp_extract_all(F.lower(normalized(text)), F.lit(TOKEN), F.lit(0))


@F.pandas_udf(StringType())
def _normal(text: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form, strict=True)], dtype=object)


#: Characters that NFC and NFKC leave alone, whatever stands beside them: ASCII, letters of Latin-1, composed Vietnamese ones, dashes and quotes.
STABLE = r"^[\x00-\x7F\u00C0-\u00FF\u0102\u0103\u0110\u0111\u0128\u0129\u0168\u0169\u01A0\u01A1\u01AF\u01B0\u1EA0-\u1EF9\u2013\u2014\u2018\u2019\u201C\u201D]*$"


def is_stable(text: Column | str) -> Column:
    """Whether NFC and NFKC leave a text alone; so they do a null."""
    return F.coalesce(_col(text).rlike(STABLE), F.lit(True))


def stable_tokens(text: Column | str) -> Column:
    """``tokens`` of a text that is stable, without Python."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0))


def normalized(text: Column | str, form: str = "NFKC") -> Column:
    """Unicode normal form (NFC or NFKC). Spark has no such function; of texts that both leave alone Python sees a null."""
    c = _col(text)
    other = ~c.rlike(STABLE)
    return F.when(other, _normal(F.when(other, c), F.lit(form))).otherwise(c)
