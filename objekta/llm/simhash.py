"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: A-Z becomes a-z; words [^\x20\x09-\x0D]+; shingles of SHINGLE words joined by one blank, repeats included
(fewer words: the whole sequence; none: fingerprint zero); h = XXH64 of a shingle (UTF-8, seed 42); a bit is 1 if it is set
in over half the h. Fingerprints link at LIMIT or fewer differing bits, and documents form components over links.

Pigeonring: 64 bits in five segments on a ring, at most 4 differences. Some segment then starts a chain in which the
first l segments together differ in at most floor(4 l / 5) bits, for each l: 0, 1, 2, 3, 4. Candidates are therefore pairs
that agree in a segment and differ in at most one bit of the next: every distinct fingerprint is filed under its 5 pairs
of consecutive segments, and under those with one zero bit of the second segment set. Rows with one key stand together
after one shuffle; chains of three and four segments prune them before the full Hamming check.

Only distinct fingerprints are filed, so exact copies of a text meet once. A partition passes on just the links that
join two of its sets (a spanning forest), so a group of near copies gives as many rows as it has fingerprints, not pairs.

A key with over LARGE rows is never held: its rows are linked to its smallest fingerprint as they pass, and go on. After a first union-find only
those keys are left whose rows are still in several components; they are compared completely, in pairs of blocks of LARGE rows that any task
can take, between components. So a dense group of near copies costs its rows, and unrelated fingerprints under one key their pairs.

Defined cases: null and empty texts have fingerprint zero and link like any other; rows with a null doc_id are linked but
never name a component (null if it has no other); rows that repeat a doc_id are judged by their own texts; an empty table gives no
rows; extra columns are ignored (components) or kept (deduplicate).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objekta.llm import wordhash as wh
from objekta.llm.common import cut, partitions, table, unused
from objekta.llm.components import connected_components

SHINGLE = 4
SEED = 42
LIMIT = 4
#: Widths of the segments, from the lowest bit on.
SEGMENTS = (13, 13, 13, 13, 12)
_STARTS = tuple(int(x) for x in np.cumsum((0, *SEGMENTS)))
_MASKS = tuple(((1 << w) - 1) << s for w, s in zip(SEGMENTS, _STARTS, strict=False))
#: Groups of up to this many rows are paired by shifting the sorted column, larger ones row by row.
SMALL_GROUP = 64
#: Rows of one key that a task holds.
LARGE = 4096
#: Fingerprints whose sets a task remembers in order to pass on no link twice.
REMEMBERED = 500_000


def _fingerprint(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            ones += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        out = np.zeros(batch.num_rows, dtype=np.uint64)
        for step in wh.word_steps(batch.column(1), lower=True):
            for k, row in enumerate(step.rows):
                a, b = int(step.first[k]), int(step.first[k + 1])
                if a == b:
                    continue
                text = step.text(a, b)
                lengths = step.ends[a:b] - step.starts[a:b]
                ends = np.cumsum(lengths + 1) - 1
                begins = ends - lengths
                n = min(SHINGLE, b - a)
                h = [digest(text[s:e], SEED) for s, e in zip(begins[: b - a - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
                out[row] = _fingerprint(np.array(h, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(out.view(np.int64))], ["doc_id", *batch.schema.names[2:], "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed number."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _digest(documents: DataFrame):
    """Tells apart the rows of one doc_id."""
    return F.xxhash64(documents["text"].cast("string"))


def _chain(i: int, length: int) -> np.uint64:
    return np.uint64(sum(_MASKS[(i + j) % 5] for j in range(length)))


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each fingerprint: the start of a chain and its first two segments. base: no bit was set for it."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(5):
            second = (i + 1) % 5
            base = fp & _chain(i, 2)
            for bit in (None, *range(SEGMENTS[second])):
                if bit is None:
                    key, own = base, fp
                else:
                    flip = np.uint64(1 << (_STARTS[second] + bit))
                    may = (fp & flip) == 0
                    key, own = base[may] | flip, fp[may]
                columns = (np.full(len(key), i, dtype=np.int8), key.view(np.int64), own.view(np.int64), np.full(len(key), bit is None))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["start", "key", "fp", "base"])


def _near(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Pigeonring on chains of three and four segments, then all 64 bits."""
    x = a ^ b
    ok = np.ones(len(x), dtype=bool)
    for length in (3, 4):
        masks = np.array([_chain(i, length) for i in range(5)])
        ok &= np.bitwise_count(x & masks[start]) <= LIMIT * length // 5
    return ok & (np.bitwise_count(x) <= LIMIT)


class _Forest:
    """Sets of this partition's fingerprints; a link is new if it joins two of them."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        if len(self.up) > REMEMBERED:
            self.up = {}
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _pairs(own: np.ndarray, base: np.ndarray, start: int, sets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links among fingerprints of one key, enough to join its sets (numbers, changed here) that are near; one of each pair has no bit set for it."""
    for k in np.flatnonzero(base).tolist():
        good = np.flatnonzero((sets != sets[k]) & _near(own[k], own, np.full(len(own), start)))
        if len(good):
            merged = np.unique(sets[good])
            for x in {int(sets[x]): int(x) for x in good[::-1].tolist()}.values():
                yield int(own[k]), int(own[x])
            sets[np.isin(sets, merged)] = sets[k]


def _link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    none = pa.nulls(len(pairs), pa.int64())
    ends = [pa.array(np.array([p[k] for p in pairs], dtype=np.uint64).view(np.int64)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([none.cast(pa.int8()), none, *ends, none.cast(pa.bool_())], ["start", "key", "a", "b", "base"])


def _linker(large: int):
    """Rows (start, key, fp, base) come sorted by (start, key, fp). Gives (start, key, a, b, base): links a, b, and the rows of keys with over large rows (b null)."""

    def groups(forest, i, key, fp, base, bounds) -> list[tuple[int, int]]:
        out = []
        sizes = np.diff(bounds)
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        for o in range(1, min(SMALL_GROUP, int(sizes.max(initial=1)))):
            same = np.flatnonzero((key[o:] == key[:-o]) & (i[o:] == i[:-o]) & small[o:] & (base[o:] | base[:-o]))
            if len(same):
                good = same[_near(fp[same], fp[same + o], i[same])]
                out += [(a, b) for a, b in zip(fp[good].tolist(), fp[good + o].tolist(), strict=True) if a != b and forest.join(a, b)]
        for g in np.flatnonzero(sizes > SMALL_GROUP).tolist():
            a, b = int(bounds[g]), int(bounds[g + 1])
            own = fp[a:b]
            out += [(x, y) for x, y in _pairs(own, base[a:b], int(i[a]), np.unique(own, return_inverse=True)[1]) if forest.join(x, y)]
        return out

    def passed_on(forest, center, i, key, fp, base) -> Iterator[pa.RecordBatch]:
        near = np.flatnonzero((fp != center) & (np.bitwise_count(fp ^ center) <= LIMIT))
        if pairs := [(int(center), x) for x in fp[near].tolist() if forest.join(int(center), x)]:
            yield _link_batch(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(base)], ["start", "key", "a", "b", "base"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, hot = _Forest(), None, None
        for batch in batches:
            part = [batch.column("start").to_numpy(zero_copy_only=False), *(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp")), batch.column("base").to_numpy(zero_copy_only=False)]
            if hot is not None:
                other = np.flatnonzero((part[0] != hot[0]) | (part[1] != hot[1]))
                n = int(other[0]) if len(other) else len(part[0])
                if n:
                    yield from passed_on(forest, hot[2], *(x[:n] for x in part))
                    part = [x[n:] for x in part]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            i, key, fp, base = part
            if not len(key):
                continue
            held = hot = None
            bounds = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]), True])
            wide = np.flatnonzero(np.diff(bounds) > large)
            for g in wide.tolist():
                yield from passed_on(forest, fp[bounds[g]], *(x[bounds[g] : bounds[g + 1]] for x in part))
            last = int(bounds[-2])
            if len(wide) and wide[-1] == len(bounds) - 2:
                hot = (i[last], key[last], fp[last])
            else:
                held = [x[last:] for x in part]
            keep = np.repeat(np.diff(bounds) <= large, np.diff(bounds))
            keep[last:] = False
            rest = [x[keep] for x in part]
            if len(rest[0]):
                own = np.flatnonzero(np.r_[True, (rest[1][1:] != rest[1][:-1]) | (rest[0][1:] != rest[0][:-1]), True])
                if pairs := groups(forest, *rest, own):
                    yield _link_batch(pairs)
        if held is not None and (pairs := groups(forest, *held, np.array([0, len(held[0])]))):
            yield _link_batch(pairs)

    return run


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (start, key, low, high, fp, component, base) come sorted by the first four: two blocks at most."""
    place, held = None, []
    names = ["a", "b"]

    def links() -> pa.RecordBatch:
        fp, component, base = (np.array(c) for c in zip(*held, strict=True))
        pairs = [*_pairs(fp.astype(np.int64).view(np.uint64), base.astype(bool), place[0], np.unique(component, return_inverse=True)[1])]
        return pa.RecordBatch.from_arrays([pa.array(np.array([p[k] for p in pairs], dtype=np.uint64).view(np.int64)) for k in (0, 1)], names)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:4] != place:
                if len(held) > 1:
                    yield links()
                place, held = row[:4], []
            held.append(row[4:])
    if len(held) > 1:
        yield links()


def links(distinct: DataFrame, large: int = LARGE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of a column fp, enough of them to connect all that are near. A result of cut()."""
    n = partitions(distinct.sparkSession)
    filed = distinct.select("fp").mapInArrow(_file, "start byte, key long, fp long, base boolean")
    dealt = filed.repartition(n, "start", "key").sortWithinPartitions("start", "key", "fp")
    out = cut(dealt.mapInArrow(_linker(large), "start byte, key long, a long, b long, base boolean"), "simhash-links")
    found = out.where("start is null").select("a", "b").distinct()
    passed = out.where("start is not null").select("start", "key", F.col("a").alias("fp"), "base")
    if passed.isEmpty():
        return found
    sets = connected_components(found)
    named = passed.join(sets, passed.fp == sets.node, "left").select("start", "key", "fp", "base", F.coalesce("component", "fp").alias("component"))
    split = named.groupBy("start", "key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y")
    rest = named.join(split.select("start", "key", F.ceil(F.col("n") / large).cast("int").alias("blocks")), ["start", "key"])
    rest = rest.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("start", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp", "component", "base")
    more = rest.repartition(n, "start", "key", "low", "high").sortWithinPartitions("start", "key", "low", "high").mapInArrow(_block_links, "a long, b long")
    return cut(found.unionByName(more.distinct()), "simhash-links", sets, out)


def _linked(prints: DataFrame) -> DataFrame:
    """fp, least (its smallest doc_id) and component (a fingerprint) for every distinct fp."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = connected_components(links(classes))
    return classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def components(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable)."""
    prints = cut(fingerprints(documents), "simhash")
    linked = _linked(prints)
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = cut(linked.join(named, "component").select("fp", "component_id"), "simhash-components")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _judged(documents: DataFrame) -> DataFrame:
    """doc_id, digest, n (rows with both) and stays: these are the ones their component keeps, of the smallest id (nulls last) and digest."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _digest(documents).alias("digest"))
    prints = cut(rows.mapInArrow(_fingerprints, "doc_id long, digest long, fp long"), "simhash")
    linked = _linked(prints).select("fp", "component")
    keys = cut(prints.groupBy("doc_id", "digest", "fp").agg(F.count(F.lit(1)).alias("n")), "simhash-keys")
    least = keys.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "digest")).alias("first"))
    linked = cut(linked.join(least, "fp"), "simhash-least")
    best = linked.groupBy("component").agg(F.min("first").alias("best"))
    ids = cut(linked.join(best, "component").select("fp", "best"), "simhash-best")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    return cut(keys.join(ids, "fp").select("doc_id", "digest", "n", stays.alias("stays")), "simhash-judged")


def deduplicate(documents: DataFrame, nameless: bool = True) -> DataFrame:
    """One row of each component, with all its columns: of its smallest doc_id, and any one of rows equal in doc_id and text.

    Rows with a null doc_id all stay; with nameless=False one of them stays, and only where no other row is in its component.
    """
    judged = _judged(documents)
    named = judged.where("doc_id is not null")
    ids = cut(named.groupBy("doc_id").agg((F.sum("n") > 1).alias("shared"), F.max("stays").alias("stays")), "simhash-ids")
    again = named.where("stays").join(ids.where("shared"), "doc_id", "left_semi")
    if not nameless:
        again = again.unionByName(judged.where("doc_id is null and stays"))
    name, digest = unused(documents, "copy_of_another"), unused(documents, "digest_of_text")
    own = documents["doc_id"].cast("long")
    # Ids of one row are told by the id alone, which keeps the joined table small; rows of shared ids and of none by their text, too.
    gone = cut(ids.where("shared or not stays").select(F.col("doc_id").alias(name)), "simhash-copies")
    once = documents.where(own.isNotNull()).join(gone, own == F.col(name), "left_anti")
    keys = cut(again.select(F.col("doc_id").alias(name), F.col("digest").alias(digest)), "simhash-again")
    more = documents.join(keys, own.eqNullSafe(F.col(name)) & (_digest(documents) == F.col(digest)), "left_semi")
    more = more.withColumns({name: own, digest: _digest(documents)}).dropDuplicates([name, digest]).drop(name, digest)
    out = once.unionByName(more)
    return out.unionByName(documents.where(own.isNull())) if nameless else out


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
