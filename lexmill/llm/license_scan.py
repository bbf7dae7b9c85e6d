"""License scans by ordered signature rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.common import ALNUM, LOWER, batch, columns, pieces, utf8, words
from lexmill.llm.license_rules import BASE, rules

OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.string()))])
#: One of these is in every text that any rule or phrase can match. Each is looked for first, in one pass for each.
TRIGGERS = (b"licen", b"rights reserved", b"reserved", b"copyright", b"(c)", b"\xc2\xa9", b"public domain", b"proprietary", b"prohibited", b"commercial", b"hereby granted", b"redistribution", b"warranty", b"creative", b"cc", b"wtfpl", b"://", b".org", b"spdx", b"mit no attribution", b".net", b"joinup")
WORD, GAP = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"


@cache
def compiled() -> tuple[list[tuple], list[bytes], list[tuple[re.Pattern, bytes, str]]]:
    """Rules with their gates as indexes into the list of keywords, and the phrases."""
    rs = rules()
    keywords = sorted({k for r in rs for k in r.needs})
    at = {k: i for i, k in enumerate(keywords)}
    sig = [(re.compile(r.pattern.encode("latin-1")), [at[k] for k in r.needs], r.label, r.priority, r.confidence, no) for no, r in enumerate(rs)]
    base = [(re.compile(rb"(?<!" + WORD + rb")" + GAP.join(w.encode() for w in phrase.split()) + rb"(?!" + WORD + rb")"), phrase.split()[0].encode(), label) for phrase, label in BASE]
    return sig, [k.encode() for k in keywords], base


def suppressed(found: list[tuple]) -> list[tuple]:
    """found: (start, end, priority, rule, label, confidence). By priority, then length, then rule, without those that lie within one taken before."""
    taken: list[tuple] = []
    for x in sorted(set(found), key=lambda x: (-x[2], x[0] - x[1], x[3], x[0])):
        if not any(t[0] <= x[0] and x[1] <= t[1] for t in taken):
            taken.append(x)
    return sorted(taken)


def detections(low: bytes) -> list[tuple]:
    """Of a text in lower case: runs of whitespace count as one space."""
    sig, keywords, _ = compiled()
    have = [k in low for k in keywords]
    return suppressed([(m.start(), m.end(), priority, no, label, confidence) for pattern, needs, label, priority, confidence, no in sig if all(have[k] for k in needs) for m in pattern.finditer(low)])


def phrases(low: bytes) -> list[tuple[int, str]]:
    """Byte offsets and labels of all places of the base phrases."""
    return sorted((m.start(), label) for pattern, first, label in compiled()[2] if first in low for m in pattern.finditer(low))


def license_scan(docs: DataFrame) -> DataFrame:
    """Licences and rights notices in each text.

    A-Z are lower-cased; words are runs of digits, letters a-z and anything beyond ASCII. Base labels come from phrases
    whose words stand consecutively. The signature rules add labels: hundreds of regular expressions, each tried only
    where its keywords are; a detection within the interval of one of higher priority is suppressed, so ``licensed under
    the X License, version 3`` isn't also ``X License``. Returns a row for each row of docs: doc_id, n_words, n_base,
    first_word, last_word, base_labels, labels, score (how sure it is that there is any notice) and detections
    (``label@first byte+bytes`` in the text with whitespace runs as one space).

    Defined cases: null and empty texts have no words, empty label strings and score 0; rows with a null doc_id and
    repeated rows are scanned like others; a very long text is scanned as a whole, by one task;
    an empty table gives an empty table; other columns are ignored.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, off = utf8(rows.column("text"))
            for i, j in pieces(off):
                part, edges = LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
                starts, _, first = words(part, edges, ALNUM)
                whole = part.tobytes()
                out: list[tuple] = []
                for r in range(j - i):
                    low = whole[edges[r] : edges[r + 1]]
                    if not any(t in low for t in TRIGGERS):
                        out.append((0, None, None, "", "", 0.0, []))
                        continue
                    base = phrases(low)
                    at = (np.searchsorted(starts, edges[r] + np.array([p for p, _ in base], np.int64)) - first[r]).tolist()
                    found = detections(b" ".join(low.split()))
                    labels = {label for _, label in base}
                    doubt = 1.0
                    for c in {x[4]: x[5] for x in sorted(found, key=lambda x: x[5])}.values():
                        doubt *= 1 - c
                    doubt *= 0.5 ** bool(base)
                    out.append((len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[4] for x in found})), 1 - doubt, [f"{x[4]}@{x[0]}+{x[1] - x[0]}" for x in found]))
                yield batch(OUT, rows.column("doc_id").slice(i, j - i), np.diff(first), *zip(*out, strict=True))

    return columns(docs, doc_id="long", text="string").mapInArrow(scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<string>")
