import hashlib
import random
import re

from objekta.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= who
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = ["The", "ré", "x1", "né", "Dog", "runs", "far", "ÄÖ", "b", "c"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([3, 4, 10, 11, 30]))) for i in range(12)] + [(50, None), (51, " .. "), (3, make(15))]
    docs = [(i, make(rng.randrange(0, 40))) for i in range(40)]
    docs += [(100 + i, make(5) + "-- " + t.upper().replace(" ", ",\n") + " ." + make(4)) for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "."), (203, docs[45][1]), (203, docs[45][1]), (None, docs[46][1]), (204, make(40000))]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "x", 7) for d, t in docs], "doc_id long, text string, n_words string, items int"), spark.createDataFrame(items, "item_id long, text string")


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_against_brute_force(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    got = [tuple(r)[:6] for r in dc.digest(dc.scan(d, b)).collect()]
    assert key(got) == key(brute(docs, items))


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    docs, items = cases()
    d, b = frames(spark, docs, items)
    assert dc._parts(b) > 2
    got = [tuple(r)[:6] for r in dc.digest(dc.scan(d, b)).collect()]
    assert key(got) == key(brute(docs, items))


def test_items_above_a_block_and_repeated_items(spark, monkeypatch):
    """One item fills many blocks by itself, equal items count once, and no set is larger than a block."""
    rng = random.Random(5)
    long = " ".join(f"v{rng.randrange(500)}" for _ in range(600))
    items = [(1, long), (2, "one two three"), (3, " ".join(f"u{i}" for i in range(12)))] + [(4, "same words again and again")] * 300
    docs = [(i, " ".join(long.split()[7 * i : 7 * i + rng.randrange(8, 14)])) for i in range(80)] + [(100, "x one two three y"), (101, "Same words, again and AGAIN!"), (102, None), (103, "clean")]
    d, b = frames(spark, docs, items)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 4000)
    sizes = [sum(len(w) + dc.ROW_BYTES + len(o) for w, o in known.owners.items()) for known in dc._sets(dc.windows(b))]
    assert len(sizes) > 10 and max(sizes) < 2 * 4000
    got = [tuple(r)[:6] for r in dc.digest(dc.scan(d, b)).collect()]
    assert key(got) == key(brute(docs, items))
    bad = {r[0] for r in brute(docs, items) if r[5]}
    assert sorted(r.doc_id for r in dc.decontaminate(d, b).collect()) == sorted(x for x, _ in docs if x not in bad)


def test_empty_tables(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    assert dc.scan(d.limit(0), b).count() == 0
    assert dc.digest(dc.scan(d, b.limit(0))).where("contaminated").count() == 0


def test_removal(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    bad = {r[0] for r in brute(docs, items) if r[5]}
    kept = dc.decontaminate(d, b)
    assert kept.schema == d.schema
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(x for x, _ in docs if x is not None and x not in bad)
    cleaned = dc.decontaminate(d, b, "spans").collect()
    assert len(cleaned) == len(docs)
    before = {r[0]: r for r in brute(docs, items)}
    for r in cleaned:
        assert len(words(r.text)) == before[r.doc_id][1] - before[r.doc_id][2]


def test_spans_of_several_blocks_are_those_of_the_input_text(spark, monkeypatch):
    docs, items = cases()
    chain = [f"q{i}" for i in range(40)]
    items += [(60 + i, " ".join(chain[i : i + 14])) for i in range(0, 26, 5)] + [(70, " ".join([*chain[:5], *"stuvwxyz"]))]
    docs += [(300, " ".join(["s", *chain, "t"])), (301, " ".join([*chain[:5], *chain[5:19], *"stuvwxyz"]))]
    d, b = frames(spark, docs, items)
    one = sorted((str(r.doc_id), r.text or "") for r in dc.decontaminate(d, b, "spans").collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    assert dc._parts(b) > 2
    cleaned = dc.decontaminate(d.withColumnRenamed("items", "hits"), b, "spans")
    assert cleaned.schema == d.withColumnRenamed("items", "hits").schema
    cleaned = cleaned.collect()
    assert sorted((str(r.doc_id), r.text or "") for r in cleaned) == one
    before = {r[0]: r for r in brute(docs, items)}
    for r in cleaned:
        assert len(words(r.text)) == before[r.doc_id][1] - before[r.doc_id][2] and r.hits == 7
