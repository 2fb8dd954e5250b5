import hashlib
import random
import re

from objekta.llm import secret_scan as s

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return sorted(out)


def texts():
    rng = random.Random(4)
    pieces = ["password", "PassWd", "secret", "token", "Api_Key", "apikey", "api__key", "AKIA", '"', "'", " ", ":", "=", "==", "\n", "é", "日", "😀", "K", "toKen", "abcdef0123456789", "ABCDEFGH123456", "x/y+z.w-v_u=", "0123", "deadbeef" * 3, "AKIAAKIA" + "A1" * 7, ", ", "gh", "p_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return [*out, None, "", "token: secret: abcdefghijklmn", "token=token=abcdefghijkl", "a" * 40000, "password=" + "k" * 30000, "f" * 15 + "g", "word " * 20000 + "token=abcdefghijklm"]


def test_trigram_queries():
    q = {r.kind: s.trigram_query(r.pattern) for r in s.RULES}
    assert q["hex"] == s.ANY
    assert q["access"] == frozenset([frozenset(["aki", "kia"])])
    assert frozenset(["tok", "oke", "ken"]) in q["assign"] and frozenset(["sec", "ecr", "cre", "ret"]) in q["assign"] and len(q["assign"]) == 6
    assert s.trigram_query("ab|cde") == s.ANY and s.trigram_query("(abc)*x") == s.ANY
    assert s.trigram_query("abc+d[0-9]*efg") == frozenset([frozenset(["efg"])])
    for r in s.RULES:  # no match may lack its trigrams
        pattern = re.compile(r.pattern)
        for t in texts():
            for m in pattern.finditer(t or ""):
                if r.kind != "assign" or m[0].isascii():
                    assert any(all(g in m[0].lower() for g in a) for a in q[r.kind])


def test_many_matches_in_one_text(spark):
    """More matches than a chunk has, at its edges too."""
    texts = [" ".join(f"{i:016x}" if i % 3 else "no" for i in range(n)) for n in (s.CHUNK, s.CHUNK + 1, 2 * s.CHUNK, 30000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in s.scan(frame).collect():
        assert [(x.start, x.order, x.kind, x.end) for x in r.spans] == base(texts[r.doc_id])


def test_spans_against_plain_search(spark):
    docs = [(i, t, "k") for i, t in enumerate(texts())] + [(None, "token=abcdefghijklmnop", "k"), (3, "token=abcdefghijklmnop", "k"), (3, "token=abcdefghijklmnop", "k")]
    frame = spark.createDataFrame(docs, "doc_id int, text string, key string").repartition(4)
    got = s.digest(s.scan(frame)).collect()
    want = []
    for d, t, _ in docs:
        b = base(t)
        written = ",".join(f"{k}:{x}:{y}" for x, _, k, y in b)
        want.append((d, *[sum(k == kind for _, _, k, _ in b) for kind in ("assign", "access", "hex")], hashlib.sha256(written.encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {d: t for d, t, _ in docs if d is not None}
    for r in got:
        found = r.spans.split(",") if r.spans else []
        assert len(found) >= r.n_assign + r.n_access + r.n_hex
        for x in found:
            kind, a, b = x.split(":")
            if r.doc_id is not None and r.doc_id != 3:
                rule = next(y for y in s.RULES if y.kind == kind)
                assert re.fullmatch(rule.pattern, by[r.doc_id][int(a) : int(b)])
    assert s.digest(s.scan(frame.limit(0))).count() == 0
    assert s.scan(frame, (s.BASE[2],)).count() == len(docs)
