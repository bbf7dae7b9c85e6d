"""Collocations: phrases counted in HAT-tries, level by level, and scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import LOWER, batch, columns, cut, mix, pieces, utf8, word_hashes, words

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~BREAK
INSIDE[[0x20, 0x09]] = False
ODD = np.uint64(0xD6E8FEB86659FD93)
RUNS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("part", pa.int32()), ("phrases", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
HASHES = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])
BITS = pa.schema([("block", pa.int64()), ("bits", pa.binary())])
COUNTS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
#: Bytes of text that are looked at together.
PIECE = 1 << 20
#: Two to this many bits are in the filter of a level, 8 MB, whatever the input.
FILTER_BITS = 26
#: Two to this many prefix partitions; 32 parts that the phrases of a language are dealt to.
PART_BITS = 10
SALTS = 32


def phrase_hash(of_words: np.ndarray, langs: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words with its language. of_words and langs: a hash for each word."""
    first = mix(of_words + mix(langs))
    h = first
    for j in range(1, k):
        h = mix(h[: len(first) - j] * ODD + first[j:])
    return h[: max(len(first) - k + 1, 0)]


class HatTrie:
    """Counts phrases of k words: nodes by language and word id above, hash containers of the remaining ids below.

    A container that grows over ``burst`` phrases becomes a node, with a container for each next word. ``shrink`` lets the
    largest subtrees leave as sorted runs until half of the phrases are left; where words take as much room as phrases,
    everything leaves, words too. ``spilled`` has the runs that left.
    """

    def __init__(self, k: int, burst: int = 4096) -> None:
        self.k, self.burst = k, burst
        self.spilled: list[pa.RecordBatch] = []
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.root: dict[str, dict] = {}
        self.nodes: set[int] = set()
        self.size = 0

    def word_ids(self, found: list[bytes]) -> np.ndarray:
        out = []
        for w in found:
            i = self.ids.get(w)
            if i is None:
                i = self.ids[w] = len(self.words)
                self.words.append(w)
            out.append(i)
        return np.array(out, np.uint32)

    def add(self, lang: str, ids: np.ndarray, counts: np.ndarray) -> None:
        """ids: rows of k word ids; counts: how often each row was found."""
        width = ids.itemsize
        top = self.root.setdefault(lang, {})
        for key, n in zip(np.ascontiguousarray(ids).view(f"V{width * self.k}").ravel().tolist(), counts.tolist(), strict=True):
            at = top
            while id(at) in self.nodes:
                head, key = key[:width], key[width:]
                below = at.get(head)
                if below is None:
                    below = at[head] = {}
                at = below
            have = at.get(key)
            if have is None:
                at[key] = n
                self.size += 1
                if len(at) > self.burst and len(key) > width:
                    self._split(at, width)
            else:
                at[key] = have + n

    def _split(self, container: dict, width: int) -> None:
        entries = list(container.items())
        container.clear()
        for key, n in entries:
            container.setdefault(key[:width], {})[key[width:]] = n
        self.nodes.add(id(container))

    def held(self) -> int:
        return self.size + len(self.words)

    def shrink(self) -> None:
        """To be called when no ids are held outside."""
        if len(self.words) >= self.size:
            self.flush()
            return
        half = self.size // 2
        subtrees = [(len(run := list(self._entries(child, head))), lang, head, run) for lang, top in self.root.items() for head, child in self._children(top)]
        leaving: dict[str, list[tuple[bytes, int]]] = {}
        for n, lang, head, run in sorted(subtrees, key=lambda s: -s[0]):
            if self.size <= half:
                break
            leaving.setdefault(lang, []).extend(run)
            self._drop(lang, head)
            self.size -= n
        for lang, run in leaving.items():
            self._leave(lang, run)

    def flush(self) -> None:
        for lang, top in self.root.items():
            self._leave(lang, list(self._entries(top, b"")))
        self.clear()

    def _children(self, top: dict) -> list[tuple[bytes, dict]]:
        return list(top.items()) if id(top) in self.nodes else [(b"", top)]

    def _entries(self, at: dict, prefix: bytes) -> Iterator[tuple[bytes, int]]:
        for key, below in at.items():
            if id(at) in self.nodes:
                yield from self._entries(below, prefix + key)
            else:
                yield prefix + key, below

    def _drop(self, lang: str, head: bytes) -> None:
        top = self.root[lang]
        gone = [top.pop(head)] if head else [self.root.pop(lang)]
        while gone:
            at = gone.pop()
            if id(at) in self.nodes:
                self.nodes.discard(id(at))
                gone += at.values()

    def _leave(self, lang: str, run: list[tuple[bytes, int]]) -> None:
        if not run:
            return
        ids = np.frombuffer(b"".join(key for key, _ in run), np.uint32).reshape(-1, self.k)
        # phrases meet by their first two words: that is the prefix partition
        heads = np.unique(ids[:, :2])
        data = np.frombuffer(b"".join(self.words[i] for i in heads), np.uint8)
        ends = np.cumsum([len(self.words[i]) for i in heads])
        h = np.zeros(len(run), np.uint64)
        of = word_hashes(data, np.r_[0, ends[:-1]], ends)
        for j in range(min(self.k, 2)):
            h = mix(h * ODD + of[np.searchsorted(heads, ids[:, j])])
        part = (h >> np.uint64(64 - PART_BITS)).astype(np.int64)
        phrases = [b" ".join([self.words[i] for i in row]) for row in ids.tolist()]
        order = sorted(range(len(run)), key=phrases.__getitem__)
        order = np.array(order)[np.argsort(part[order], kind="stable")]
        numbers, first = np.unique(part[order], return_index=True)
        ends = pa.array(np.r_[first, len(order)].astype(np.int32))
        texts, n = pa.array([phrases[i] for i in order.tolist()], pa.binary()).cast(pa.string()), pa.array([run[i][1] for i in order.tolist()], pa.int64())
        self.spilled.append(batch(RUNS, pa.array([lang] * len(numbers), pa.string()), [self.k] * len(numbers), numbers, pa.ListArray.from_arrays(ends, texts), pa.ListArray.from_arrays(ends, n)))


@dataclass
class Tokens:
    """Words of some texts: their bytes, hashes, languages (by number in names, and as a hash) and whether the next word follows within the same piece."""

    part: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    h: np.ndarray
    names: list[str]
    lang: np.ndarray
    lang_hash: np.ndarray
    follows: np.ndarray

    def places(self, k: int, good: np.ndarray) -> np.ndarray:
        """First words of the phrases of k words within a piece that are good."""
        for j in range(k - 1):
            good = good & self.follows[j : j + len(good)]
        return np.flatnonzero(good)


def tokenised(rows: pa.RecordBatch) -> Iterator[Tokens]:
    langs = rows.column("lang").dictionary_encode()
    names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    of_lang = hashes_of(names)
    data, off = utf8(rows.column("text"))
    for i, j in pieces(off, PIECE):
        part, edges = LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, first = words(part, edges, INSIDE)
        if not len(starts):
            continue
        breaks = np.cumsum(BREAK[part], dtype=np.int32)
        follows = np.zeros(len(starts), bool)
        follows[:-1] = breaks[starts[1:] - 1] == breaks[ends[:-1] - 1]
        follows[first[1:][first[1:] > 0] - 1] = False
        lang = np.repeat(code[i:j], np.diff(first))
        yield Tokens(part, starts, ends, word_hashes(part, starts, ends), names, lang, of_lang[lang], follows)


def hashes_of(names: list[str]) -> np.ndarray:
    raw = [n.encode() for n in names]
    ends = np.cumsum([len(n) for n in raw], dtype=np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends) if raw else np.zeros(0, np.uint64)


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through."""
    at = h >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys, each once and in order, with the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def packed(keys: np.ndarray, counts: np.ndarray, most: int) -> pa.RecordBatch:
    """Sorted 32-bit keys and their counts, a row for each block of 2**20 keys: how many there are in each sixteenth of the block, their last 16 bits, and counts up to most."""
    block = (keys >> np.uint64(20)).astype(np.int64)
    numbers, first = np.unique(block, return_index=True)
    ends = np.r_[first[1:], len(keys)][: len(first)]
    sixteenth = ((keys >> np.uint64(16)) & np.uint64(15)).astype(np.int64)
    low, n = (keys & np.uint64(0xFFFF)).astype(np.uint16), np.minimum(counts, most).astype(np.uint32 if most > 255 else np.uint8)
    places = [np.bincount(sixteenth[i:j], minlength=16).astype(np.uint32).tobytes() + low[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
    return batch(HASHES, numbers, pa.array(places, pa.binary()), pa.array([n[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary()))


def unpacked(places: bytes, counts: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block, and counts."""
    head = np.frombuffer(places, np.uint32, 16).astype(np.int64)
    return (np.repeat(np.arange(16), head) << 16) + np.frombuffer(places, np.uint16, offset=64), np.frombuffer(counts, np.uint32 if most > 255 else np.uint8)


def filter_of(parts: DataFrame, least: int) -> np.ndarray:
    """The filter of the keys whose counts in all parts (see ``packed``) add up to least or more.

    Blocks are dealt to tasks, which have the counts of one block at a time before them, 8 MB. At most 2 ** FILTER_BITS bits reach the
    driver.
    """
    wide = FILTER_BITS - 12  # bits of the filter for one of 4096 blocks, as a power of two

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(1 << 20, np.int64)

        def finished() -> pa.RecordBatch:
            bits = (total >= least).reshape(1 << wide, -1).any(1)
            return batch(BITS, [at], pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()))

        for rows in batches:
            for block, places, counts in zip(*(rows.column(c).to_pylist() for c in ("block", "places", "counts")), strict=True):
                if block != at:
                    if at is not None:
                        yield finished()
                    at, total[:] = block, 0
                place, n = unpacked(places, counts, least)
                total[place] += n
        if at is not None:
            yield finished()

    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts.repartition("block").sortWithinPartitions("block").mapInArrow(summed, "block long, bits binary").collect():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[r["block"] * len(own) : (r["block"] + 1) * len(own)] = own
    return bits


def frequent_hashes(texts: DataFrame, k: int, known: Broadcast | None, least: int, room: int = 1 << 21) -> np.ndarray:
    """The filter of level k: a bit for each hash that at least so many phrases of k words have.

    A phrase is hashed if the filter of level k - 1 (known) lets both its parts through; the first 32 bits count. A task
    holds up to room hashes with their counts, then hands them on. Where the filter fills up, or hashes are equal, other
    phrases pass too, and are counted in vain; none is lost.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for rows in batches:
            for t in tokenised(rows):
                h = phrase_hash(t.h, t.lang_hash, k)
                if k > 1:
                    parts = passing(known.value, phrase_hash(t.h, t.lang_hash, k - 1))
                    h = h[t.places(k, parts[:-1] & parts[1:])]
                key, n = np.unique(h >> np.uint64(32), return_counts=True)
                keys.append(key)
                counts.append(n)
                size += len(key)
                if size > room:
                    key, n = merged(keys, counts)
                    if 2 * len(key) > room:
                        yield packed(key, n, least)
                        key, n = key[:0], n[:0]
                    keys, counts, size = [key], [n], len(key)
        if keys:
            yield packed(*merged(keys, counts), least)

    return filter_of(texts.mapInArrow(hashed, "block long, places binary, counts binary"), least)


def words_within(found: DataFrame) -> np.ndarray:
    """The filter of the words that lie in phrases (lang, phrase)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not len(rows):
                continue
            for t in tokenised(pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("phrase")], names=["lang", "text"])):
                yield packed(*np.unique(phrase_hash(t.h, t.lang_hash, 1) >> np.uint64(32), return_counts=True), 1)

    return filter_of(found.select("lang", "phrase").mapInArrow(hashed, "block long, places binary, counts binary"), 1)


def sorted_runs(texts: DataFrame, filters: dict[int, Broadcast], room: int = 400_000) -> DataFrame:
    """Sorted runs of the phrases that pass their length's filter, with their counts: lang, k, part (their prefix partition), phrases and n. And all words of a language, with k = 0 and an empty phrase. The tries of a task hold room phrases and words at most, besides those of a piece of text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, total = [HatTrie(k) for k in sorted(filters)], {}
        for rows in batches:
            for t in tokenised(rows):
                for c, n in zip(*np.unique(t.lang, return_counts=True), strict=True):
                    total[t.names[c]] = total.get(t.names[c], 0) + int(n)
                raw = t.part.tobytes()
                for trie in tries:
                    k = trie.k
                    h = phrase_hash(t.h, t.lang_hash, k)
                    at = t.places(k, passing(filters[k].value, h))
                    if not len(at):
                        break  # parts of longer phrases would have passed
                    # words first: each once by its bytes, then phrases as rows of ids
                    used = np.unique((at[:, None] + np.arange(k)).ravel())
                    _, one, number = np.unique(t.h[used], return_index=True, return_inverse=True)
                    ids = np.zeros(len(t.h), np.uint32)
                    ids[used] = trie.word_ids([raw[a:b] for a, b in zip(t.starts[used[one]].tolist(), t.ends[used[one]].tolist(), strict=True)])[number]
                    _, one, n = np.unique(h[at], return_index=True, return_counts=True)
                    at = at[one]
                    phrases = ids[at[:, None] + np.arange(k)]
                    for c in np.unique(t.lang[at]).tolist():
                        own = t.lang[at] == c
                        trie.add(t.names[c], phrases[own], n[own])
                # tries share the room
                while sum(trie.held() for trie in tries) > room:
                    trie = max(tries, key=HatTrie.held)
                    trie.shrink()
                    while trie.spilled:
                        yield trie.spilled.pop()
        for trie in tries:
            trie.flush()
            yield from trie.spilled
        yield batch(RUNS, pa.array(list(total), pa.string()), [0] * len(total), [0] * len(total), pa.array([[""]] * len(total), RUNS.field("phrases").type), [[n] for n in total.values()])

    return texts.mapInArrow(counted, "lang string, k int, part int, phrases array<string>, n array<long>")


def merged_runs(runs: DataFrame, least: int, most: int = 1 << 20) -> DataFrame:
    """lang, k, phrase and f of the phrases whose counts in all runs add up to least or more, and the words of each language (k = 0).

    Runs meet by prefix partition. A task merges one partition after the other, and has the different phrases of one of
    them before it, and up to most entries of runs that aren't merged yet.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, size = None, [], 0

        def together() -> pa.Table:
            return pa.concat_tables(waiting).group_by(["lang", "k", "phrase"]).aggregate([("f", "sum")]).rename_columns(COUNTS.names)

        def finished() -> Iterator[pa.RecordBatch]:
            whole = together()
            keep = [f >= least or k == 0 for f, k in zip(whole.column("f").to_pylist(), whole.column("k").to_pylist(), strict=True)]
            yield from whole.filter(pa.array(keep, pa.bool_())).cast(COUNTS).to_batches()

        for rows in batches:
            for i in range(len(rows)):
                own = rows.column("part")[i].as_py()
                if own != part:
                    if waiting:
                        yield from finished()
                    part, waiting, size = own, [], 0
                phrases, n = rows.column("phrases")[i].values, rows.column("n")[i].values
                count = len(phrases)
                waiting.append(pa.table([pa.repeat(rows.column("lang")[i], count), pa.repeat(rows.column("k")[i], count), phrases, n], schema=COUNTS))
                size += count
                if size > most:
                    waiting, size = [together().cast(COUNTS)], 0
        if waiting:
            yield from finished()

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "lang string, k int, phrase string, f long")


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k and f of all phrases of two to longest words found at least so often, and of the words in them; and lang and n, all words of a language.

    A phrase can't be more frequent than its parts, so hashes are counted level by level, each level among what the one
    before lets through. What passes is counted word by word in the tries of the tasks, in one pass for all phrases and in one for the
    words that these have; tries leave sorted runs, which meet by prefix partition and are merged there.
    """
    texts = columns(docs, lang="string", text="string").filter("text IS NOT NULL").withColumn("lang", F.coalesce("lang", F.lit("und")))
    send = docs.sparkSession.sparkContext.broadcast
    filters: dict[int, Broadcast] = {}
    for k in range(1, longest + 1):
        filters[k] = send(frequent_hashes(texts, k, filters.get(k - 1), least))
    filters.pop(1).destroy()

    def counted(known: dict[int, Broadcast]) -> DataFrame:
        kept = cut(merged_runs(sorted_runs(texts, known), least).select("lang", "phrase", "k", "f"))
        for b in known.values():
            b.destroy()
        return kept

    found = counted(filters).filter("k > 0")
    single = counted({1: send(words_within(found))})
    return single.filter("k > 0").unionByName(found), single.filter("k = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, most: int = 2000, inside: int = 100) -> DataFrame:
    """The most strongly bound phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts, A-Z in lower case, are split into pieces at ``.,;:!?`` and line breaks, and these into words at spaces and
    tabs. Candidates are phrases of 2 to longest words within a piece that are found at least least times. A cut of a
    candidate (a times) into two parts (l and r times) has the score floor(1000 a n / (l r)), n being all words of the language; the
    lowest counts, of equal ones the first. Candidates that lie in a longer one which is found inside per cent as often are dropped. Each language's first most are
    returned, by score, then a, then phrase.

    Defined cases: null and empty texts have no words; a null lang is ``und``; rows count by themselves, whatever their
    doc_id; a very long text is one piece of work for a task; an empty table gives an empty table; other columns are
    ignored. Products are exact up to 38 digits.
    """
    counts, totals = phrase_counts(docs, longest, least)
    found = counts.filter("k > 1")
    ws = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c"))
    cuts = cuts.select("*", F.array_join(F.slice(ws, F.lit(1), F.col("c")), " ").alias("left"), F.array_join(F.slice(ws, F.col("c") + 1, F.size(ws)), " ").alias("right"))
    of = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    # one language may have most phrases: its total is joined in parts
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS))).join(totals, ["lang", "salt"]).drop("salt")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("x", F.lit(1000) * wide("a") * wide("n")).withColumn("y", wide("l") * wide("r")).withColumn("score", F.expr("x div y"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "c", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.*").drop("c")
    # with the words of a longer one lie those of all between, which are as frequent at least: one word more is enough
    sub = F.explode(F.array(F.array_join(F.slice(ws, F.lit(1), F.size(ws) - 1), " "), F.array_join(F.slice(ws, F.lit(2), F.size(ws) - 1), " ")))
    longer = found.filter("k > 2").select("lang", sub.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM lists, range(1, 6) AS ks(k)
), counts AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, i,
         array_to_string(string_split(c.phrase, ' ')[1:i], ' ') AS lp, array_to_string(string_split(c.phrase, ' ')[i + 1:], ' ') AS rp
  FROM counts c, range(1, 5) AS s(i) WHERE c.k > 1 AND i < c.k
), scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, i
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp
  JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), kept AS (
  SELECT * FROM weakest w WHERE NOT EXISTS (
    SELECT 1 FROM counts c WHERE c.lang = w.lang AND c.k > w.k AND 100 * c.f >= 100 * w.a AND contains(' ' || c.phrase || ' ', ' ' || w.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept QUALIFY rank <= 2000
"""
