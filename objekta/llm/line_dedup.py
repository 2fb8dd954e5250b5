r"""Line dedup: fuzzy lines by MinHash, one line kept per component.

Lines are what stands between \n, without outer white space; lines without a word are no lines and always stay.
Two lines are near if the sets of their SHINGLE-character shingles (a shorter line is one shingle) have a Jaccard similarity of
SIMILARITY or more; components are taken over near and equal lines of all documents. The first line of each component stays:
that of the smallest doc_id, then the first in its text.

1. Equal lines are met once, by 128 bits of hash (high, low), with the smallest id: first in each batch of documents, then in a shuffle.
   Each different line then has a number of its own (ref), so that from here on no two are ever taken for one.
2. MinHash signatures of BANDS x ROWS values; each band is a key of 8 bytes. At a similarity of 0.8 a pair shares a band
   with odds of 1 - (1 - 0.8^4)^14 = 0.9994. Only (band, ref) is shuffled, many in a row; bands with two lines or more are kept.
3. Each line is compared with one line of each of its bands (a star, salted where it has over STAR lines), by exact Jaccard
   similarity, and a distributed union-find follows. Lines of a band that are then still in two components are
   compared completely, in blocks of BLOCK lines, so that no link within a band is missed. What that finds joins components, by a union-find of these.
   Tables are deleted once their successors are written.
4. Only lines that repeat or are linked travel back, as a list of verdicts for each document.

Defined cases: null and empty texts have no lines; a null doc_id counts as larger than any other; rows that repeat a doc_id
are judged alike (each keeps what is first in it); an empty table gives no rows; long texts and lines are used whole; extra
columns are ignored (digest) or kept (deduplicate_lines).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objekta.llm.common import cut, partitions, remove, solid, table, unused
from objekta.llm.components import connected_components
from objekta.llm.wordhash import mix

SHINGLE = 7
SIMILARITY = 0.8
ROWS = 4
BANDS = 14
STAR = 1000
BLOCK = 512
#: Rows (band, ref) that a task holds at a time: 16 MB, some 100 while they are sorted.
HELD = 1 << 20
#: Bits of the bitmap that thins lines before a shuffle: 16 MB, however many lines there are.
SLOTS = 1 << 27
#: Characters that are hashed at a time, few enough to stay in a core's cache.
STEP_CHARS = 1 << 15
NO_ID = (1 << 63) - 1
_OUTER = " \t\v\f\r\n"

_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P2, _P3 = np.uint64(0x9E3779B97F4A7C15**2 % 2**64), np.uint64(0x9E3779B97F4A7C15**3 % 2**64)


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all lines, one after the other, and where each line begins (one more at the end)."""
    pad = "\0" * (SHINGLE - 1)
    codes = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    n = np.array([len(x) for x in lines], dtype=np.int64)
    begins = np.cumsum(n + SHINGLE - 1) - n - SHINGLE + 1
    two = mix(codes[:-1] * _P + codes[1:])
    four = two[:-2] * _P2 + two[2:]
    seven = mix(four[:-3] * _P3 + four[3:])
    counts = np.maximum(1, n - SHINGLE + 1)
    first = np.r_[0, np.cumsum(counts)]
    return seven[np.arange(first[-1]) + np.repeat(begins - first[:-1], counts)], first


def _steps(lines: list[str]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, x in enumerate(lines):
        if size and size + len(x) > STEP_CHARS:
            yield a, i
            a, size = i, 0
        size += len(x) + SHINGLE
    if a < len(lines):
        yield a, len(lines)


def _split(text: str | None) -> list[tuple[str, str]]:
    """(as written, without outer white space) of each \\n-split line."""
    return [(x, x.strip(_OUTER)) for x in (text or "").split("\n")]


def _ref(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    a, b = h >> 64, h & ((1 << 64) - 1)
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def _rows_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (high, low, id, n, line) of each different line of a batch of (id, text): its smallest id and how often it stands there."""
    for batch in batches:
        own: dict[str, list] = {}
        for doc, text in zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
            for _, line in _split(text):
                if line:
                    known = own.get(line)
                    if known is None:
                        own[line] = [doc, 1]
                    else:
                        known[0], known[1] = min(doc, known[0]), known[1] + 1
        refs = [_ref(line) for line in own]
        columns = {"high": [r for r, _ in refs], "low": [r for _, r in refs], "id": [d for d, _ in own.values()], "n": [n for _, n in own.values()]}
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns.values()), pa.array([*own], pa.string())], [*columns, "line"])


def _lines_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (high, low, doc) of each different line of each (doc, text)."""
    for batch in batches:
        docs, refs = [], []
        for doc, text in zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
            own = {line for _, line in _split(text) if line}
            refs += [_ref(line) for line in own]
            docs += [doc] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([r for r, _ in refs], [r for _, r in refs], docs)], ["high", "low", "doc"])


def signatures(lines: list[str]) -> np.ndarray:
    """ROWS * BANDS minima for each line. The hashes are mixed already, so that odd factors permute them well enough."""
    h, first = shingles(lines)
    h = (h >> np.uint64(32)).astype(np.uint32)
    out, room = np.empty((ROWS * BANDS, len(lines)), dtype=np.uint32), np.empty_like(h)
    for k in range(ROWS * BANDS):
        np.multiply(h, _A[k], out=room)
        np.minimum.reduceat(room, first[:-1], out=out[k])
    return out.T


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        refs, lines = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).tolist()
        if not lines:
            continue
        signature = np.concatenate([signatures(lines[a:b]) for a, b in _steps(lines)])
        keys = []
        for k in range(BANDS):
            key = np.full(len(lines), k + 1, dtype=np.uint64)
            for j in range(ROWS):
                key = mix(key * _P + signature[:, k * ROWS + j].astype(np.uint64))
            keys.append(key.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(refs, BANDS))], ["band", "ref"])


def _packs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, bands, refs): what HELD rows (band, ref) have for one of n parts, as two runs of 8-byte numbers. A shuffle of fewer rows."""
    for band, ref in _held(batches, lambda: HELD):
        part = (band.view(np.uint64) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        band, ref = band[order], ref[order]
        parts, first = np.unique(part[order], return_index=True)
        ends = np.append(first[1:], len(band))
        runs = [pa.array([x[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary()) for x in (band, ref)]
        yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *runs], ["part", "bands", "refs"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bands, refs in zip(batch.column(1), batch.column(2), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), dtype=np.int64)) for x in (bands, refs)], ["band", "ref"])


def _held(batches: Iterator[pa.RecordBatch], most: Callable[[], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two columns of batches, joined until they have most() rows or more."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
        if size >= most():
            yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held, size = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, center, ref) of bands with two refs or more, from rows (band, ref) in any order, all those of a band in one call.

    HELD rows are met at a time; of a band that goes on later only its center is kept, so that a band of any size fits. The center is
    the least ref of those that came first: lines that share several bands nearly always have the same center in each, and a pair is met once.
    """
    known, centers, met = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    for band, ref in _held(batches, lambda: max(HELD, len(known))):
        old = len(known)
        band, ref = np.concatenate([known, band]), np.concatenate([centers, ref])
        order = np.argsort(band, kind="stable" if old else None)  # stable: what is known stands first in its band
        band, ref = band[order], ref[order]
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        sizes = np.diff(np.append(starts, len(band)))
        least = np.minimum.reduceat(ref, starts)
        keep = np.repeat(sizes > 1, sizes)
        told = np.zeros(len(starts), dtype=bool)
        if old:
            first = order[starts]
            is_old = first < old
            least[is_old] = ref[starts[is_old]]
            told[is_old] = met[first[is_old]]
            keep[starts[told]] = False
        known, centers, met = band[starts], least, told | (sizes > 1)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (band, np.repeat(least, sizes), ref)], ["band", "center", "ref"])


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of different values."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0
    all_of = np.concatenate((a, b))
    all_of.sort()
    both = int(np.count_nonzero(all_of[1:] == all_of[:-1]))
    return both / (len(all_of) - both)


def _sets(lines: list[str]) -> Iterator[np.ndarray]:
    """The different shingles of each line, sorted: each line is sorted by itself, then repeats go from many lines at once."""
    for a, b in _steps(lines):
        h, first = shingles(lines[a:b])
        places = first.tolist()
        for i, j in zip(places, places[1:], strict=False):
            h[i:j].sort()
        new = np.r_[True, h[1:] != h[:-1]]
        new[first[:-1]] = True
        places = np.r_[0, np.cumsum(new)][first].tolist()
        h = h[new]
        for i, j in zip(places, places[1:], strict=False):
            yield h[i:j]


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def _verify_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (center, salt, member, ref, line) come sorted, the center itself first. One center is held."""
    center, held = None, None
    for batch in batches:
        links = []
        for c, member, ref, own in zip(batch.column(0).to_numpy().tolist(), batch.column(2).to_pylist(), batch.column(3).to_numpy().tolist(), _sets(batch.column(4).to_numpy(zero_copy_only=False).tolist()), strict=True):
            if not member:
                center, held = c, own
            elif c == center and _jaccard(held, own) >= SIMILARITY:
                links.append((c, ref))
        yield _link_batch(links)


def _most_common(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(k, bounds) for runs of rows from k on: no two sets have more values in common than their bound.

    Bits stand for values by their last digits. Common values whose bits fall together are at most the values of either set that share one.
    """
    sizes = np.array([len(s) for s in sets])
    width = 1 << int(max(10, min(16, np.ceil(np.log2(8 * sizes.mean())))))
    bits = np.zeros((len(sets), width), dtype=bool)
    bits[np.repeat(np.arange(len(sets)), sizes), (np.concatenate(sets) & np.uint64(width - 1)).astype(np.int64)] = True
    shared = sizes - bits.sum(axis=1)
    words = np.packbits(bits, axis=1).view(np.uint64)
    step = max(1, (1 << 17) // words.size)
    for k in range(0, len(sets), step):
        common = np.bitwise_count(words[k : k + step, None] & words[None]).sum(axis=2, dtype=np.int64)
        yield k, common + np.minimum(shared[k : k + step, None], shared[None])


def block_links(components: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the components of lines (as sets), enough to connect all that have near lines."""
    near, group = [], list(components)
    if len(set(group)) < 2:
        return near
    sizes = np.array([len(s) for s in sets])
    names = np.unique(np.array(group, dtype=np.int64), return_inverse=True)[1]
    for k, bounds in _most_common(sets):
        rows = np.arange(k, k + len(bounds))
        total = sizes[rows, None] + sizes[None]
        possible = (bounds * (1 + SIMILARITY) >= SIMILARITY * total - 1e-6) & (names[rows, None] != names[None]) & (rows[:, None] < np.arange(len(sets)))
        for i, j in zip(*[x.tolist() for x in np.nonzero(possible)], strict=True):
            x, y = group[k + i], group[j]
            if x != y and _jaccard(sets[k + i], sets[j]) >= SIMILARITY:
                near.append((x, y))
                group = [x if c == y else c for c in group]
    return near


def _verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, low, high, component, line) come sorted by the first three; a group has 2 * BLOCK lines at about most."""
    last, components, sets = None, [], []
    for batch in batches:
        links = []
        places = zip(*[batch.column(k).to_numpy().tolist() for k in range(3)], strict=True)
        for place, component, own in zip(places, batch.column(3).to_numpy().tolist(), _sets(batch.column(4).to_numpy(zero_copy_only=False).tolist()), strict=True):
            if place != last:
                links += block_links(components, sets)
                last, components, sets = place, [], []
            components.append(component)
            sets.append(own)
        yield _link_batch(links)
    yield _link_batch(block_links(components, sets))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _likely(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """The lines whose ref may be among refs, by a bitmap of hashed refs (bounded by SLOTS, so it is broadcast); none that is goes missing."""
    slot = F.pmod(F.xxhash64("ref"), F.lit(SLOTS))
    bits = refs.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (place % 8).cast("int")) == 1
    # solid: else the semi join that follows is pushed below this one, and meets all lines after all.
    return solid(lines.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("bucket")).where(is_set), *lines.columns)


def line_links(lines: DataFrame) -> DataFrame:
    """(node, component) of the lines (ref, line) that are near others, a result of cut()."""
    n = partitions(lines.sparkSession)
    packs = lines.select("ref", "line").mapInArrow(lambda batches: _packs(_bands(batches), n), "part int, bands binary, refs binary")
    members = cut(packs.repartitionById(n, "part").mapInArrow(lambda batches: _members(_unpacked(batches)), "band long, center long, ref long"), "line-bands")
    refs = members.select("ref").distinct()
    texts = cut(_likely(lines.select("ref", "line"), refs).join(refs, "ref", "left_semi"), "line-texts")

    stars = members.where("ref != center").select("center", "ref").distinct()
    sizes = stars.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
    rows = stars.join(sizes, "center").select("center", F.pmod(F.xxhash64("ref"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), "ref")
    rows = rows.unionByName(sizes.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("center").alias("ref")))
    rows = rows.join(texts, "ref").select("center", "salt", "member", "ref", "line").repartition(n, "center", "salt").sortWithinPartitions("center", "salt", "member")
    links = cut(rows.mapInArrow(_verify_stars, "a long, b long"), "line-links")
    found = connected_components(links)

    # Centers have met all lines of their bands; the others of a band meet each other if they are still apart, once for each set of them.
    named = members.where("ref != center").select("band", "ref").join(found, members.ref == found.node, "left").select("band", "ref", F.coalesce("component", "ref").alias("component"))
    wide = lambda seed: F.bit_xor(F.xxhash64("ref", F.lit(seed)))
    split = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"), wide(1).alias("set1"), wide(2).alias("set2")).where("x < y")
    split = split.groupBy("n", "set1", "set2").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = named.join(split, "band").withColumn("block", F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "ref", "component").join(texts, "ref")
    rest = rest.select("band", "low", "high", "component", "line").repartition(n, "band", "low", "high").sortWithinPartitions("band", "low", "high")
    more = cut(rest.mapInArrow(_verify_blocks, "a long, b long"), "line-links", members, texts, links)
    if more.isEmpty():
        remove(more)
        return found
    # Links between components: few nodes. Lines that were in none stand for themselves.
    joined = connected_components(more)
    renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
    last = found.join(renamed, "component", "left").select("node", F.coalesce("least", "component").alias("component")).unionByName(joined).distinct()
    return cut(last, "line-components", more, found, joined)


def verdicts(documents: DataFrame) -> DataFrame:
    """(high, low, component, first_id) of every line that repeats or is near another."""
    rows = documents.select(_id().alias("id"), _text().alias("text")).mapInArrow(_rows_of_lines, "high long, low long, id long, n long, line string")
    # Dealt before they are summed: they are sorted once, and what repeats within a batch is summed already.
    dealt = rows.repartition(partitions(documents.sparkSession), "high", "low")
    lines = dealt.groupBy("high", "low").agg(F.min("id").alias("first_id"), F.sum("n").alias("n"), F.first("line").alias("line"))
    lines = cut(lines.withColumn("ref", F.monotonically_increasing_id()), "lines", codec="snappy")
    found = line_links(lines)
    each = lines.join(found, lines.ref == found.node, "left").where("n > 1 or component is not null").select("high", "low", "first_id", F.coalesce("component", "ref").alias("component"))
    each = cut(each, "line-each", lines, found)
    first = each.groupBy("component").agg(F.min("first_id").alias("first_id"))
    return cut(each.drop("first_id").join(first, "component").select("high", "low", "component", "first_id"), "line-verdicts", each)


def _verdicts_of_rows(known: pa.Array) -> Iterator[dict[tuple[int, int], tuple[int, int]]]:
    """(component, first_id) by (high, low) for each row of a column of lists of verdicts; without a Python object for each struct."""
    flat = known.flatten()
    fields = [flat.field(k).to_numpy().tolist() for k in ("high", "low", "component", "first_id")]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(known), 0).to_numpy()).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        high, low, component, first = (f[a:b] for f in fields)
        yield dict(zip(zip(high, low, strict=True), zip(component, first, strict=True), strict=True))


def _keep(doc: int, text: str | None, by: dict[tuple[int, int], tuple[int, int]]) -> tuple[list[str], int, int]:
    """The lines left as written, how many there were and how many went."""
    out, n, gone, seen = [], 0, 0, set()
    for raw, line in _split(text):
        if line:
            n += 1
            found = by.get(_ref(line)) if by else None
            if found:
                if found[1] != doc or found[0] in seen:
                    gone += 1
                    continue
                seen.add(found[0])
        out.append(raw)
    return out, n, gone


_KNOWN = "array<struct<high:bigint,low:bigint,component:bigint,first_id:bigint>>"


def _judged(documents: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column (its name comes too) that holds id and verdicts of their lines."""
    key = F.xxhash64(_id(), _text())
    rows = documents.select(key.alias("doc"), _text().alias("text")).mapInArrow(_lines_of_rows, "high long, low long, doc long")
    known = rows.join(verdicts(documents), ["high", "low"]).groupBy("doc").agg(F.collect_set(F.struct("high", "low", "component", "first_id")).alias("known"))
    name = unused(documents, "line_verdicts")
    known = known.select(F.struct("doc", "known").alias(name))
    return documents.join(known, key == F.col(f"{name}.doc"), "left"), name


def deduplicate_lines(documents: DataFrame) -> DataFrame:
    """The documents with all their columns; text is without the lines that go."""
    judged, name = _judged(documents)
    names = documents.columns
    at = names.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, doc, known in zip(batch.column(at).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 2).to_numpy().tolist(), _verdicts_of_rows(batch.columns[-1]), strict=True):
                kept, _, gone = _keep(doc, text, known)
                texts.append("\n".join(kept) if gone else text)
            columns = [pa.array(texts, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns[:-2])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    whole = judged.select(*[F.col(f"`{c}`") for c in documents.columns], _id().alias(unused(documents, "line_id")), F.col(f"{name}.known").alias(unused(documents, "line_known")))
    return whole.mapInArrow(rewrite, documents.schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, shas = [], [], []
        for text, doc, known in zip(batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().tolist(), _verdicts_of_rows(batch.column(3)), strict=True):
            kept, a, b = _keep(doc, text, known)
            n.append(a)
            gone.append(b)
            shas.append(hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])


def digest(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 (of the text that is left)."""
    judged, name = _judged(documents)
    rows = judged.select(F.col("doc_id").cast("long"), _text().alias("text"), _id().alias("id"), F.col(f"{name}.known").cast(_KNOWN).alias("known"))
    return rows.mapInArrow(_digest, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
