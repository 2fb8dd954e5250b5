r"""Substring dedup: passages of WINDOW words that an earlier document has too, found by sharded Aho-Corasick automata.

Words are [^\x20\x09-\x0D]+. A window is WINDOW consecutive words of one document; a word is removed if a window that covers
it also starts in a document with a smaller doc_id.

1. Equal texts are one text (the first id); a copy with a larger id loses all its words, if they make a window at all.
2. Every window belongs to the smallest of its GRAM-word hashes, its key; neighbouring windows with one key are a segment,
   so equal windows always stand in segments with equal keys. Only (key, id) is shuffled: a key that two ids
   have is recurring. About one word in twenty starts a segment.
3. Segments with recurring keys are made distinct by their words, with the smallest id. A copy with a larger id is covered as a whole;
   the distinct ones travel by key. A shard, some keys' segments, numbers its words by their bytes, confirms recurring windows by these
   numbers, joins those that always follow each other to passages, compiles the passages to an automaton (pyahocorasick)
   and streams all its segments through it. An occurrence whose passage occurs in a document with a smaller id is covered.
4. The distinct segments of one key may exceed HOT bytes, more than one automaton is made for. Their windows go another exact way, as rows: by
   a digest of the window's words to the smallest id (partial sums, no group in memory) and back, where Spark can split what is skewed.
   Both ways compare the words themselves (or 128 bits of BLAKE2b), so they cover the same.

Defined cases: null and empty texts have no words; a null doc_id counts as larger than any other, and as equal to other
nulls; rows that repeat a doc_id never remove words from each other; an empty table gives no rows; long texts are read
whole; extra columns are ignored (passages) or kept (remove_passages).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objekta.llm import wordhash as wh
from objekta.llm.common import cut, partitions, table, unused

WINDOW = 50
GRAM = 10
#: Bytes of distinct segments up to which a key's segments meet in one shard.
HOT = 4 << 20
#: Bytes of segments that one automaton is made for (a key's segments stay together).
SHARD_BYTES = 2 << 20
NO_ID = (1 << 63) - 1

_SEGMENTS = "key long, id long, digest binary, start int, n_words int, segment binary, text binary"
_COVERED = "segment binary, start int, end int"


def _sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """Minimum of the n values from each place on, where there are n."""
    width, out = 1, g
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(g) - n + 1], out[n - width : len(g) - width + 1]) if n > width else out


def segments(step: wh.Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row (from the step's first), key, first window and last window (as word numbers of the step) of each segment."""
    none = np.zeros(0, dtype=np.int64)
    if len(step.starts) < window:
        return none, none, none, none
    grams = wh.windows(wh.prefix(step.hashes()), GRAM)
    keys = _sliding_min(grams, window - GRAM + 1)
    at = np.flatnonzero(step.room(window)[: len(keys)])
    if not len(at):
        return none, none, none, none
    row, key = np.searchsorted(step.first, at, side="right") - 1, keys[at]
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
    begin = np.flatnonzero(new)
    return row[begin], key[begin].view(np.int64), at[begin], at[np.r_[begin[1:] - 1, len(at) - 1]]


def _keys(window: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for step in wh.word_steps(batch.column(1)):
                row, key, _, _ = segments(step, window)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[step.rows.start :][row] if len(row) else key)], ["key", "id"])

    return keys


def _short_digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _cutter(window: int):
    """The segments of a text whose keys are in its list of recurring ones; their words are joined by one space."""
    kinds = {"key": pa.int64(), "id": pa.int64(), "digest": pa.binary(), "start": pa.int32(), "n_words": pa.int32(), "segment": pa.binary(), "text": pa.binary()}

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, wanted = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(3)
            for step in wh.word_steps(batch.column(2), wh.NOT_SPACE):
                row, key, first, last = segments(step, window)
                if not len(row):
                    continue
                bounds = np.searchsorted(row, np.arange(len(step.rows) + 1))
                out = [[] for _ in kinds]
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    a, b, r = int(bounds[k]), int(bounds[k + 1]), step.rows[k]
                    recurring = np.isin(key[a:b], wanted[r].values.to_numpy(zero_copy_only=False))
                    for i in (np.flatnonzero(recurring) + a).tolist():
                        s, e = int(first[i]), int(last[i]) + window
                        words = b" ".join(step.data[step.starts[s] : step.ends[e - 1]].tobytes().split())
                        row_of = (int(key[i]), int(ids[r]), digests[r].as_py(), s - int(step.first[k]), e - s, _short_digest(words), words)
                        for column, value in zip(out, row_of, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds.values(), strict=True)], [*kinds])

    return cut_out


def window_ranks(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for the n values from each place on, where there are n: equal for equal values and only for those (by doubling, without hashes)."""
    rank, width = numbers.astype(np.int64), 1

    def pairs(offset: int) -> np.ndarray:
        both = rank[: len(rank) - offset] * (int(rank.max(initial=0)) + 1) + rank[offset:]
        return np.unique(both, return_inverse=True)[1].astype(np.int64)

    if len(numbers) < n:
        return np.zeros(0, dtype=np.int64)
    while width * 2 <= n:
        rank, width = pairs(width), width * 2
    return pairs(n - width) if n > width else rank


class Shard:
    """Distinct segments in the order of key and id: their words as numbers (one for each different word of the shard), and where each begins."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.window = window
        words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        self.first = words.offsets.to_numpy().astype(np.int64)
        self.codes = words.values.dictionary_encode().indices.to_numpy()
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def passages(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(first word, words) of one occurrence of each recurring passage: windows that always stand together, joined."""
        at = np.flatnonzero(np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.codes)) >= self.window)
        if not len(at):
            return []
        distinct, first, inverse, count = np.unique(window_ranks(self.codes, self.window)[at], return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(inverse, kind="stable")
        ends = np.cumsum(count)
        id_of = ids[self.row[at]]
        recurring = id_of[order[ends - count]] < id_of[order[ends - 1]]  # ids rise within a key, and equal windows have one key
        follows = np.r_[(at[1:] == at[:-1] + 1) & (self.row[at[1:]] == self.row[at[:-1]]), False]
        here = np.flatnonzero(follows)
        pair, pair_of, pairs = np.unique(inverse[here].astype(np.int64) * len(distinct) + inverse[here + 1], return_inverse=True, return_counts=True)
        u, v = pair // len(distinct), pair % len(distinct)
        together = (pairs == count[u]) & (pairs == count[v]) & recurring[u] & recurring[v]
        joined = np.zeros(len(at), dtype=bool)
        joined[here] = together[pair_of]
        head = np.zeros(len(at), dtype=bool)
        head[first[recurring]] = True
        head &= ~np.r_[False, joined[:-1]]
        stops = np.flatnonzero(~joined)
        heads = np.flatnonzero(head)
        last = stops[np.searchsorted(stops, heads)]
        return list(zip(at[heads].tolist(), (at[last] - at[heads] + self.window).tolist(), strict=True))

    def covered(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(segment, first word, word after) of the occurrences that a document with a smaller id has too."""
        import ahocorasick

        found = self.passages(ids)
        if not found:
            return
        numbers = self.codes.tolist()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, (a, n) in enumerate(found):
            automaton.add_word(tuple(numbers[a : a + n]), k)
        automaton.make_automaton()
        rows, ends, which = [], [], []
        for r in range(len(ids)):
            for end, k in automaton.iter(tuple(numbers[self.first[r] : self.first[r + 1]])):
                rows.append(r)
                ends.append(end + 1)
                which.append(k)
        rows, ends, which = np.array(rows, dtype=np.int64), np.array(ends, dtype=np.int64), np.array(which, dtype=np.int64)
        least = np.full(len(found), NO_ID, dtype=np.int64)
        np.minimum.at(least, which, ids[rows])
        lengths = np.array([n for _, n in found], dtype=np.int64)[which]
        late = ids[rows] > least[which]
        yield from zip(rows[late].tolist(), (ends - lengths)[late].tolist(), ends[late].tolist(), strict=True)


def _locator(window: int):
    """Rows (key, id, segment, text) come sorted by key and id."""

    def one(ids: list, names: list, texts: list) -> pa.RecordBatch:
        found = [*Shard(texts, window).covered(np.array(ids, dtype=np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([names[r] for r, _, _ in found], pa.binary()), pa.array([a for _, a, _ in found], pa.int32()), pa.array([b for _, _, b in found], pa.int32())], ["segment", "start", "end"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, last, held = 0, None, ([], [], [])
        for batch in batches:
            for key, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != last and size > SHARD_BYTES:
                    yield one(*held)
                    size, held = 0, ([], [], [])
                last = key
                size += len(row[2])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if held[0]:
            yield one(*held)

    return locate


def _windows_of(window: int):
    """(window, id, segment, start) of each window of a distinct segment (id, segment, text): a digest of its words."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in wh.word_steps(batch.column(2).cast(pa.string())):
                raw, at = step.data.tobytes(), np.flatnonzero(step.room(window))
                own = np.searchsorted(step.first, at, side="right") - 1
                for a in range(0, len(at), 1 << 16):
                    some = at[a : a + (1 << 16)]
                    digests = [_short_digest(raw[x:y]) for x, y in zip(step.starts[some].tolist(), step.ends[some + window - 1].tolist(), strict=True)]
                    rows = pa.array(own[a : a + (1 << 16)] + step.rows.start)
                    start = some - step.first[own[a : a + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32))], ["window", "id", "segment", "start"])

    return explode


def _covered_hot(hot: DataFrame, window: int) -> DataFrame:
    rows = hot.select("id", "segment", "text").mapInArrow(_windows_of(window), "window binary, id long, segment binary, start int")
    least = rows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("window", "least")
    return rows.join(least, "window").where("id > least").select("segment", "start", (F.col("start") + window).cast("int").alias("end"))


def _remover(window: int, texts: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, starts, ends = [[], [], [], []], batch.column("starts"), batch.column("ends")
            for step in wh.word_steps(batch.column("text")):
                for k, r in enumerate(step.rows):
                    a, b = int(step.first[k]), int(step.first[k + 1])
                    keep = np.ones(b - a, dtype=bool)
                    if starts[r].is_valid and len(starts[r]):
                        edge = np.zeros(b - a + 1, dtype=np.int64)
                        np.add.at(edge, starts[r].values.to_numpy(), 1)
                        np.add.at(edge, ends[r].values.to_numpy(), -1)
                        keep = np.cumsum(edge[:-1]) <= 0
                    rest = np.flatnonzero(keep) + a
                    kept = b" ".join([step.data[s:e].tobytes() for s, e in zip(step.starts[rest].tolist(), step.ends[rest].tolist(), strict=True)])
                    columns[0].append(b - a)
                    columns[1].append(b - a - len(rest))
                    columns[2].append(hashlib.sha256(kept).hexdigest())
                    columns[3].append(kept if texts else None)
            out = [batch.column("digest"), batch.column("first_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["digest", "first_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return remove


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def covered(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(digest, start, end): word ranges of distinct texts (digest, first_id, text) that an earlier document has too."""
    n = partitions(texts.sparkSession)
    keys = cut(texts.select("first_id", "text").mapInArrow(_keys(window), "key long, id long").distinct(), "phrase-keys")
    recurring = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    own = keys.join(recurring, "key").groupBy("id").agg(F.collect_list("key").alias("keys"))
    found = texts.join(own, texts.first_id == own.id).select("first_id", "digest", "text", "keys").mapInArrow(_cutter(window), _SEGMENTS)
    found = cut(found, "phrase-segments", keys)
    distinct = found.groupBy("key", "segment").agg(F.min("id").alias("id"), F.first("n_words").alias("n_words"), F.first("text").alias("text"))
    distinct = cut(distinct, "phrase-distinct")
    hot = distinct.groupBy("key").agg(F.sum(F.octet_length("text")).alias("size")).where(F.col("size") > HOT).select("key")
    dealt = distinct.join(hot, "key", "left_anti").select("key", "id", "segment", "text").repartition(n, "key").sortWithinPartitions("key", "id")
    located = dealt.mapInArrow(_locator(window), _COVERED).unionByName(_covered_hot(distinct.join(hot, "key", "left_semi"), window))
    located = located.groupBy("segment").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    plan = distinct.select("segment", F.col("id").alias("least"), "n_words").join(located, "segment", "left")
    plan = cut(plan, "phrase-plan", distinct)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    rows = found.select("segment", "digest", "id", F.col("start").alias("at")).join(plan, "segment")
    rows = rows.select("digest", "at", F.explode(F.when(F.col("id") > F.col("least"), whole).otherwise(F.col("ranges"))).alias("r"))
    return cut(rows.select("digest", (F.col("at") + F.col("r.start")).alias("start"), (F.col("at") + F.col("r.end")).alias("end")), "phrase-covered", found, plan)


def passages(documents: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """One row per distinct text: digest, first_id, n_words, n_removed, kept_sha256, and with texts kept (the words left)."""
    rows = documents.select(_id().alias("id"), _text().alias("text")).withColumn("digest", _digest(F.col("text")))
    distinct = cut(rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.first("text").alias("text")), "phrase-texts")
    hits = covered(distinct, window)
    ranges = hits.groupBy("digest").agg(F.collect_list(F.struct("start", "end")).alias("r"))
    ranges = ranges.select("digest", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))
    schema = "digest binary, first_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    out = distinct.join(ranges, "digest", "left").mapInArrow(_remover(window, texts), schema)
    return cut(out if texts else out.drop("kept"), "phrase-results", distinct, hits)


def _copy(window: int) -> Column:
    """A text of at least one window whose row is not of the first id."""
    return (F.col("row_id") > F.col("first_id")) & (F.col("n_words") >= window)


def digest(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    found = passages(documents, window)
    rows = documents.select(F.col("doc_id").cast("long"), _id().alias("row_id"), _digest(_text()).alias("digest")).join(found, "digest")
    return rows.select(
        "doc_id", "n_words", F.when(_copy(window), F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(_copy(window), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def remove_passages(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns; text is what is left (words joined by one space where words were removed)."""
    found = passages(documents, window, texts=True)
    name = unused(documents, "passages")
    found = found.select(F.struct(*found.columns).alias(name))
    joined = documents.join(found, _digest(_text()) == F.col(f"{name}.digest"))
    field = lambda c: F.col(f"{name}.{c}")
    copy = (_id() > field("first_id")) & (field("n_words") >= window)
    text = F.when(copy, F.lit("")).when(field("n_removed") > 0, field("kept")).otherwise(F.col("text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns])


def op6_phrase_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT rid, doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
c AS (SELECT DISTINCT rid, unnest(range(s, s + 50)) AS p FROM h JOIN m ON h.h = m.h WHERE doc_id > least),
k AS (SELECT e.rid, string_agg(x, ' ' ORDER BY e.p) AS kept, count(*) AS n FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) e LEFT JOIN c ON e.rid = c.rid AND e.p = c.p WHERE c.p IS NULL GROUP BY e.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""
