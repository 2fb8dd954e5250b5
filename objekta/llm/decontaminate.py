"""Benchmark decontamination: broadcast hash set of normalised benchmark windows, scanned over every document.

A window is WINDOW consecutive words of a benchmark item; an item of fewer words (but not none) is one window. Words
are [0-9a-z and all non-ASCII]+ after A-Z became a-z. A document word inside any occurrence of a window is hit.

The windows go to the executors as one hash set. Its size is checked first, in bytes: distinct (window, item) rows are made and counted on the
executors, and where they have more than BLOCK_BYTES they are dealt by hash to blocks that stay below it, however long an item is or how often
it is repeated. Each block is then a job of its own over the input texts, which writes what it hits by the text's digest; so one set is in memory at a time.
The blocks' hits are united by digest and applied to the input text together. No window is left out.

Defined cases: a null or empty text has no words and is clean; an item without words has no window; repeated rows
and repeated items are each judged alike; null item ids name no item but their windows count as hits; an empty
benchmark leaves every document clean; extra columns of either table are ignored (scan) or kept (decontaminate).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objekta.llm import wordhash as wh
from objekta.llm.common import cut, table, unused

WINDOW = 10
#: Bytes of (window, item) rows that one broadcast may hold; its hash set takes about 4 times that.
BLOCK_BYTES = 32 << 20
#: Bytes that a row counts for besides its window and item.
ROW_BYTES = 24
_SLOTS = 1 << 22

_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _window_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in wh.word_steps(batch.column(1), wh.ALPHANUMERIC, lower=True):
                hashes = step.hashes()
                for k, row in enumerate(step.rows):
                    a, b = int(step.first[k]), int(step.first[k + 1])
                    n = min(window, b - a)
                    for at in range(a, b - n + 1 if n else a, 1 << 16):
                        stop = min(b, at + (1 << 16) + n - 1)
                        h = wh.windows(wh.prefix(hashes[at:stop]), n).view(np.int64)
                        words = [step.text(s, s + n) for s in range(at, stop - n + 1)]
                        item = pa.array([batch.column(0)[row].as_py()] * len(h), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, dtype=np.int32)), pa.array(h), pa.array(words, pa.binary()), item], ["n", "h", "words", "item"])

    return rows


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (n, h, words, item): each window of each item, its number of words and hash; items that are alike count once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    return items.mapInArrow(_window_rows(window), "n int, h long, words binary, item string").distinct()


def _blocks(rows: DataFrame) -> int:
    size = F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + ROW_BYTES
    return int((rows.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES) + 1


def _parts(benchmark: DataFrame, window: int = WINDOW) -> int:
    return _blocks(windows(benchmark, window))


def _sets(rows: DataFrame) -> Iterator[WindowSet]:
    """One block of the windows after the other."""
    parts = _blocks(rows)
    for k in range(parts):
        yield WindowSet(rows.where(F.pmod(F.xxhash64("words", "item"), F.lit(parts)) == k).collect())


class WindowSet:
    """Hashes of a block's windows, and their words for the check that follows a hash hit."""

    def __init__(self, rows: Iterable[tuple]):
        self.owners: dict[bytes, set] = defaultdict(set)
        found: dict[int, set] = defaultdict(set)
        for n, h, words, item in rows:
            self.owners[bytes(words)].add(item)
            found[n].add(h % (1 << 64))
        self.hashes = {n: np.sort(np.fromiter(v, dtype=np.uint64)) for n, v in found.items()}
        self.slots: dict[int, np.ndarray] = {}

    def occurrences(self, step: wh.Words) -> Iterator[tuple[int, int, set]]:
        """(first word, words, items) of each verified occurrence in the step."""
        if not len(step.starts):
            return
        if not self.slots:  # made where it is used: the hash set itself is what travels
            for n, v in self.hashes.items():
                self.slots[n] = np.zeros(_SLOTS, dtype=bool)
                self.slots[n][v % np.uint64(_SLOTS)] = True
        sums = wh.prefix(step.hashes())
        for n, known in self.hashes.items():
            h = wh.windows(sums, n)
            may = np.flatnonzero(self.slots[n][h % np.uint64(_SLOTS)])
            if not len(may):
                continue
            at = np.searchsorted(known, h[may])
            may = may[known[np.minimum(at, len(known) - 1)] == h[may]]
            for s in may[step.room(n)[may]].tolist():
                if (owners := self.owners.get(step.text(s, s + n))) is not None:
                    yield s, n, owners


def _spans(starts: np.ndarray, lengths: np.ndarray, size: int) -> list[dict]:
    """Union of word ranges."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    covered = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
    turn = np.diff(covered)
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)]


def _found(known: WindowSet, step: wh.Words) -> dict[int, tuple[list, list, set]]:
    """By row of the step: starts (from the row's first word), lengths and items of the occurrences."""
    out: dict[int, tuple[list, list, set]] = {}
    for s, n, owners in known.occurrences(step):
        k = int(np.searchsorted(step.first, s, side="right")) - 1
        starts, lengths, items = out.setdefault(k, ([], [], set()))
        starts.append(s - int(step.first[k]))
        lengths.append(n)
        items.update(owners)
    return out


_FOUND = "hits array<struct<start:int,end:int>>, items array<string>"


def _digest_of_text(documents: DataFrame):
    return F.unhex(F.sha2(F.coalesce(documents["text"].cast("string"), F.lit("")).cast("binary"), 256))


def _scanner(known: WindowSet | None, hit_only: bool):
    """Rows (key, text) give (key, n_words, hits, items); hit_only: (digest of the text, hits, items) of texts with hits alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n_words, hits, items = [], [], [], []
            for step in wh.word_steps(batch.column(1), wh.ALPHANUMERIC, lower=True):
                sizes = np.diff(step.first).tolist()
                found = _found(known, step) if known else {}
                for k in found if hit_only else range(len(sizes)):
                    starts, lengths, names = found.get(k, ([], [], set()))
                    n_words.append(sizes[k])
                    hits.append(_spans(np.array(starts), np.array(lengths), sizes[k]) if starts else [])
                    items.append(sorted(x for x in names if x is not None))
                    if hit_only:
                        keys.append(hashlib.sha256((batch.column(1)[step.rows[k]].as_py() or "").encode("utf-8", "surrogatepass")).digest())
            out = {"digest": pa.array(keys, pa.binary())} if hit_only else {batch.schema.names[0]: batch.column(0), "n_words": pa.array(n_words, pa.int64())}
            out |= {"hits": pa.array(hits, _HITS), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([*out.values()], [*out])

    return scan


def _hits_by_digest(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(digest, hits, items) of the texts that hold a window of any block: a job for each block, so that memory does not grow with their number. Hits may overlap."""
    texts = documents.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string"))
    found = [cut(texts.mapInArrow(_scanner(known, True), "digest binary, " + _FOUND).dropDuplicates(["digest"]), "benchmark-hits") for known in _sets(rows)]
    every = reduce(DataFrame.unionAll, found).groupBy("digest")
    return cut(every.agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "benchmark-hits", *found)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [_spans(np.array([x["start"] for x in h]), np.array([x["end"] - x["start"] for x in h]), n) if h else [] for h, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, _HITS), batch.column(3)], ["doc_id", "n_words", "hits", "items"])


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, n_words, hits (word ranges), items (their ids as strings, sorted)."""
    rows = cut(windows(benchmark, window), "benchmark-windows")
    schema = f"doc_id long, n_words long, {_FOUND}"
    if _blocks(rows) == 1:
        [known] = _sets(rows)
        return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scanner(known, False), schema)
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), _digest_of_text(documents).alias("digest")).alias("key")
    sizes = documents.select(key, F.col("text").cast("string")).mapInArrow(_scanner(None, False), f"key struct<doc_id:long,digest:binary>, n_words long, {_FOUND}")
    merged = _hits_by_digest(documents, rows)
    joined = sizes.select("key.*", "n_words").join(merged, "digest", "left")
    return joined.select("doc_id", "n_words", F.coalesce("hits", F.array()).alias("hits"), F.coalesce("items", F.array()).alias("items")).mapInArrow(_united, schema)


def _cleaner(known: WindowSet, at: int):
    """Drops contaminated rows."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for step in wh.word_steps(batch.column(at), wh.ALPHANUMERIC, lower=True):
                keep[[step.rows[k] for k in _found(known, step)]] = False
            yield batch.filter(pa.array(keep))

    return clean


def _cutter(known: WindowSet | None, at: int):
    """Drops the hit words (with what stands between them) from their text. Without a set the last column brings the hits."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            brought = None if known else batch.columns[-1].to_pylist()
            columns, names = (batch.columns, batch.schema.names) if known else (batch.columns[:-1], batch.schema.names[:-1])
            texts = {}
            for step in wh.word_steps(batch.column(at), wh.ALPHANUMERIC, lower=True):
                if known:
                    found = {k: (starts, lengths) for k, (starts, lengths, _) in _found(known, step).items()}
                else:
                    found = {k: ([x["start"] for x in h], [x["end"] - x["start"] for x in h]) for k, row in enumerate(step.rows) if (h := brought[row])}
                for k, (starts, lengths) in found.items():
                    row, a, size = step.rows[k], int(step.first[k]), int(step.first[k + 1] - step.first[k])
                    raw, base = batch.column(at)[row].as_py().encode(), int(step.bounds[k])
                    pieces, last = [], 0
                    for span in _spans(np.array(starts), np.array(lengths), size):
                        pieces.append(raw[last : int(step.starts[a + span["start"]]) - base])
                        last = int(step.ends[a + span["end"] - 1]) - base
                    texts[row] = b"".join([*pieces, raw[last:]]).decode()
            if texts:
                changed = pa.array([texts.get(i, v) for i, v in enumerate(batch.column(at).to_pylist())], batch.schema.field(at).type)
                columns = [changed if i == at else c for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return clean


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """The documents with all their columns, without those that hold a window (remove="documents") or without the hit words (remove="spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove!r}")
    at, schema = documents.columns.index("text"), documents.schema
    rows = cut(windows(benchmark, window), "benchmark-windows")
    if _blocks(rows) == 1:
        [known] = _sets(rows)
        return documents.mapInArrow((_cleaner if remove == "documents" else _cutter)(known, at), schema)
    name = unused(documents, "hits_of_digest")
    merged = _hits_by_digest(documents, rows).select(F.struct("digest", "hits").alias(name))
    same = _digest_of_text(documents) == F.col(f"{name}.digest")
    if remove == "documents":
        return documents.join(merged, same, "left_anti")
    joined = documents.join(merged, same, "left").select(*[F.col(f"`{c}`") for c in documents.columns], F.col(f"{name}.hits").alias(name))
    return joined.mapInArrow(_cutter(None, at), schema)


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document from scan()'s rows."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return scanned.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items",
    )


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("items")


OP9_SQL = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS rid, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, rid, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
x AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
f AS (SELECT x.rid, x.s, x.n, i.item_id FROM x JOIN i ON x.n = i.n AND x.k = i.k),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM f) GROUP BY rid),
o AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM f GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN o ON d.rid = o.rid
"""
