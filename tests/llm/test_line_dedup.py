import hashlib
import pathlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from objekta.llm import line_dedup as ld

OUTER = " \t\v\f\r\n"


def shingle_set(line):
    return {line[i : i + ld.SHINGLE] for i in range(max(1, len(line) - ld.SHINGLE + 1))}


def components(lines):
    sets = [shingle_set(x) for x in lines]
    up = list(range(len(lines)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= ld.SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    return {x: root(i) for i, x in enumerate(lines)}


def brute(docs):
    inf = float("inf")
    lines = sorted({x.strip(OUTER) for _, t in docs for x in (t or "").split("\n") if x.strip(OUTER)})
    of, first = components(lines), {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if x.strip(OUTER):
                c = of[x.strip(OUTER)]
                first[c] = min(first.get(c, inf), inf if d is None else d)
    out = []
    for d, t in docs:
        seen, kept, n = set(), [], 0
        for x in (t or "").split("\n"):
            if x.strip(OUTER):
                n += 1
                c = of[x.strip(OUTER)]
                if first[c] != (inf if d is None else d) or c in seen:
                    continue
                seen.add(c)
            kept.append(x)
        out.append((d, n, n - sum(bool(x.strip(OUTER)) for x in kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop éñ日"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip() or "x"

    def change(line):
        w = list(line)
        for _ in range(rng.choice([0, 1, 1, 2, len(w) // 3])):
            w[rng.randrange(len(w))] = rng.choice(letters)
        return "".join(w).strip() or "y"

    pool = [make(rng.choice([1, 5, 7, 30, 120, 300])) for _ in range(60)]
    chain = [make(150)]
    for _ in range(25):  # neighbours are near, the ends are not
        chain.append(chain[-1][5:] + make(5))
    docs = []
    for i in range(80):
        own = [rng.choice([change(rng.choice(pool)), rng.choice(pool), make(rng.choice([3, 60, 200])), "", "  ", rng.choice(chain)]) for _ in range(rng.randrange(0, 12))]
        docs.append((i // 2 if i % 5 else None, "\n".join(rng.choice(["", " ", "\t"]) + x + rng.choice(["", "\r"]) for x in own)))
    return docs + [(900, None), (901, ""), (902, docs[1][1]), (902, docs[1][1]), (903, "q" * 40000 + "\n" + "q" * 40001)]


@pytest.mark.parametrize("star, block", [(ld.STAR, ld.BLOCK), (2, 3)])
def test_against_brute_force(spark, monkeypatch, star, block):
    monkeypatch.setattr(ld, "STAR", star)
    monkeypatch.setattr(ld, "BLOCK", block)
    docs = corpus(star)
    frame = spark.createDataFrame([(d, t, "n", 0) for d, t in docs], "doc_id long, text string, ref string, line_verdicts int").repartition(3)
    want = brute(docs)
    assert sum(r[2] for r in want.elements()) > 100
    assert Counter(tuple(r) for r in ld.digest(frame).collect()) == want
    left = ld.deduplicate_lines(frame)
    assert left.columns == frame.columns
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in left.collect()) == Counter((r[0], r[3]) for r in want.elements())


def test_lines_whose_hashes_share_a_half(spark, monkeypatch):
    """Lines are told apart by all 128 bits, also within bands, stars and components."""
    real = ld._ref

    def forced(rows, half):
        def run(batches):
            monkeypatch.setattr(ld, "_ref", lambda line: (7, real(line)[1]) if half == 0 else (real(line)[0], 7))
            try:
                yield from rows(batches)
            finally:
                monkeypatch.setattr(ld, "_ref", real)

        return run

    docs = corpus(8)[:60]
    texts = pa.RecordBatch.from_arrays([pa.array([ld.NO_ID if d is None else d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], ["id", "text"])
    for half in (0, 1):
        [batch] = forced(ld._rows_of_lines, half)(iter([texts]))
        lines = {x.strip(OUTER) for _, t in docs for x in t.split("\n") if x.strip(OUTER)}
        assert sorted(batch.column("line").to_pylist()) == sorted(lines) and len({(a, b) for a, b in zip(*[batch.column(k).to_pylist() for k in (0, 1)], strict=True)}) == len(lines)
        frame = spark.createDataFrame(batch.to_pandas()).selectExpr("high", "low", "line", "monotonically_increasing_id() ref")
        found = ld.line_links(ld.cut(frame, "test-lines"))
        assert found.groupBy("node").count().where("count > 1").count() == 0
        named = frame.count() and {r.line: r.component for r in frame.join(found, frame.ref == found.node).select("line", "component").collect()}
        want = components(sorted(lines))
        groups = Counter(want[x] for x in lines)
        assert {x for x in lines if groups[want[x]] > 1} == set(named)
        assert len({(want[x], named[x]) for x in named}) == len({want[x] for x in named}) == len(set(named.values()))


def test_spent_tables_are_deleted(spark):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    tables = lambda: {x.name for x in folder.iterdir()}
    before, docs = tables(), corpus(5)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(tuple(r) for r in ld.digest(frame).collect()) == brute(docs)
    assert len(tables() - before) == 1


def test_empty(spark):
    assert ld.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    b = a[:2400] + "".join(rng.choice("abcdefghij ") for _ in range(600))
    x, y = ld.signatures([a, b])
    truth = len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))
    assert abs((x == y).mean() - truth) < 0.2


def test_members_over_batches():
    rows = sorted([(b, r) for b in range(40) for r in range(b % 4)])
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows[i : i + size]], pa.int64()), pa.array([r for _, r in rows[i : i + size]], pa.int64())], ["band", "ref"]) for i in range(0, len(rows), size)]
        got = [(r["band"], r["center"], r["ref"]) for x in ld._members(iter(batches)) for r in x.to_pylist()]
        assert sorted(got) == sorted((b, 0, r) for b, r in rows if b % 4 > 1)


def test_bitmap_lets_all_wanted_lines_through(spark, monkeypatch):
    lines = spark.range(-3000, 3000).selectExpr("id * 7919 as ref", "'x' as line")
    wanted = spark.range(-200, 200).selectExpr("id * 7919 * 3 as ref")
    for slots, most in ((1 << 27, 400), (1 << 10, 6000)):
        monkeypatch.setattr(ld, "SLOTS", slots)
        got = {r.ref for r in ld._likely(lines, wanted).collect()}
        assert {r.ref for r in wanted.collect()} <= got and len(got) <= most


def band_batches(rows, size):
    return [pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows[i : i + size]], pa.int64()), pa.array([r for _, r in rows[i : i + size]], pa.int64())], ["band", "ref"]) for i in range(0, len(rows), size)]


def test_lines_that_share_bands_have_one_center():
    """Whatever order they come in: so a pair is compared once, not once for each center."""
    rows = [(b, r) for b, refs in enumerate([(5, 3, 9), (9, 5, 3), (3, 9, 5), (9, 3), (8,)]) for r in refs]
    got = [(r["band"], r["center"], r["ref"]) for x in ld._members(iter(band_batches(rows, 100))) for r in x.to_pylist()]
    assert sorted(got) == sorted((b, 3, r) for b, r in rows if b < 4)


@pytest.mark.parametrize("held", [1, 3, 50, 1 << 20])
def test_packed_bands_come_whole(monkeypatch, held):
    monkeypatch.setattr(ld, "HELD", held)
    rng = random.Random(held)
    bands = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)]
    rows = [(b, i * 100 + r) for i, b in enumerate(bands) for r in range(rng.choice([1, 1, 2, 3, 40]))]
    rng.shuffle(rows)
    parts = {}
    for x in ld._packs(iter(band_batches(rows, 7)), 5):
        for row in x.to_pylist():
            parts.setdefault(row["part"], []).append(row)
    assert set(parts) <= set(range(5)) and len(parts) > 1
    schema = pa.schema([("part", pa.int32()), ("bands", pa.binary()), ("refs", pa.binary())])
    got = [r for own in parts.values() for x in ld._members(ld._unpacked(iter([pa.RecordBatch.from_pylist(own, schema)]))) for r in x.to_pylist()]
    sizes = Counter(b for b, _ in rows)
    assert Counter((r["band"], r["ref"]) for r in got) == Counter((b, r) for b, r in rows if sizes[b] > 1)
    centers = {(r["band"], r["center"]) for r in got}
    assert len(centers) == len({b for b, _ in centers}) and centers <= set(rows)


def test_block_links_against_brute_force():
    rng = random.Random(11)
    for n in (2, 7, 30, 200):
        base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([9, 80, 900]))) for _ in range(max(1, n // 6))]
        lines = []
        for _ in range(n):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice("abcdefgh ")
            lines.append("".join(w))
        sets = list(ld._sets(lines))
        assert [len(s) for s in sets] == [len(shingle_set(x)) for x in lines]
        common = [[len(shingle_set(x) & shingle_set(y)) for y in lines] for x in lines]
        bounds = [row for _, b in ld._most_common(sets) for row in b.tolist()]
        assert len(bounds) == n and all(a <= b for x, y in zip(common, bounds, strict=True) for a, b in zip(x, y, strict=True))
        up = list(range(n))  # the links join exactly what is near
        for a, b in ld.block_links(list(range(n)), sets):
            assert up[a] != up[b]
            up = [up[a] if c == up[b] else c for c in up]
        near = {(i, j) for i in range(n) for j in range(i) if common[i][j] >= ld.SIMILARITY * (len(sets[i]) + len(sets[j]) - common[i][j])}
        want = components(lines)
        assert near and all((up[i] == up[j]) == (want[lines[i]] == want[lines[j]]) for i in range(n) for j in range(i))
        assert ld.block_links([4] * n, sets) == []
