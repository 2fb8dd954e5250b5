r"""Secret scans by a trigram inverted index. DataFrame functions only.

A rule is a regular expression. Its Boolean trigram query is derived from the expression's parse tree: the finite strings
that must occur give AND of their trigrams, alternatives give OR. postings() is the inverted index restricted to the
trigrams that some query names: rows (gram, key) with key a 64-bit hash of id and text. Postings are intersected per key,
and only the documents that satisfy a rule's query are searched with its expression. A rule without mandatory trigrams
(hex) searches every text. Two rows with one key only make each other candidates, which the search then settles.

Spans are in code points, end exclusive. They come from the gaps and lengths of the matches, leftmost and
non-overlapping for each kind.

Rules: assign, access and hex are the base; pem, github and jwt are added by this module.

Defined cases: null and empty texts have no spans; each repeated row gets its own result; null ids are fine; an empty
table gives no rows; texts are searched whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as kinds
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objekta.llm.common import table

#: Strings that one step of the derivation enumerates at most; beyond that it asks for less, never for more.
MOST_STRINGS = 16
_CHARACTERS = 8
#: Matches whose places are summed up at a time.
CHUNK = 512


@dataclass(frozen=True)
class Rule:
    """kind; a Java regular expression without look-around; the group whose code points must be least or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules. [...]{n,} finds what [...]+ with a length test finds where the class holds the whole match.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

Query = frozenset[frozenset[str]]
#: A query that every text satisfies.
ANY: Query = frozenset([frozenset()])


def _simple(query: Query) -> Query:
    return frozenset(q for q in query if not any(other < q for other in query))


def _and(a: Query, b: Query) -> Query:
    return _simple(frozenset(x | y for x, y in product(a, b)))


def _grams(strings: frozenset[str]) -> Query:
    return _simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _item(op, value) -> tuple[frozenset[str] | None, Query]:
    """The lower-case strings of a node where they are few, else None; and its query."""
    if op is kinds.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if op is kinds.IN:
        found: set[str] = set()
        for kind, v in value:
            span = (v, v) if kind is kinds.LITERAL else v if kind is kinds.RANGE else None
            if span is None or span[1] - span[0] >= _CHARACTERS:
                return None, ANY
            found |= {chr(c).lower() for c in range(span[0], span[1] + 1)}
        return (frozenset(found), ANY) if len(found) <= _CHARACTERS else (None, ANY)
    if op is kinds.SUBPATTERN:
        return _sequence(value[3])
    if op is kinds.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and len(strings := frozenset().union(*[s for s, _ in parts])) <= MOST_STRINGS:
            return strings, ANY
        return None, _simple(frozenset().union(*[_and(q, _grams(s)) if s is not None else q for s, q in parts]))
    if op is kinds.MAX_REPEAT or op is kinds.MIN_REPEAT:
        least, most, inner = value
        strings, query = _sequence(inner)
        if (least, most) == (1, 1):
            return strings, query
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        return None, (_and(query, _grams(strings)) if strings is not None else query) if least else ANY
    if op is kinds.AT:
        return frozenset([""]), ANY
    return None, ANY


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    current, query, whole = frozenset([""]), ANY, True
    for op, value in items:
        strings, inner = _item(op, value)
        query = _and(query, inner)
        if strings is not None and len(current) * len(strings) <= MOST_STRINGS:
            current = frozenset(a + b for a, b in product(current, strings))
        else:
            query, whole = _and(query, _grams(current)), False
            current = strings if strings is not None else frozenset([""])
    return (current, query) if whole else (None, _and(query, _grams(current)))


def trigram_query(pattern: str) -> Query:
    """Alternatives, each a set of lower-case trigrams of which a lower-cased text with a match has all. ANY: no trigram is mandatory."""
    strings, query = _sequence(_parser.parse(pattern))
    return query if strings is None else _and(query, _grams(strings))


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), text)


def postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: (gram, key) for each of the grams that the text has. keyed: key, text."""
    low = keyed.select("key", F.lower("text").alias("low"))
    have = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("key", F.explode(have).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, rules): intersects the postings of each key. A key has as many grams as the rules name at most."""
    has = lambda alternative: F.size(F.array_intersect("grams", F.array(*[F.lit(g) for g in sorted(alternative)]))) == len(alternative)
    rules = []
    for kind, query in queries.items():
        holds = F.lit(False)
        for alternative in sorted(query, key=sorted):
            holds = holds | has(alternative)
        rules.append(F.when(holds, F.lit(kind)))
    found = index.groupBy("key").agg(F.collect_set("gram").alias("grams"))
    return found.select("key", F.array_compact(F.array(*rules)).alias("rules")).where(F.size("rules") > 0)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, order, end, kind>> of the rule's matches that are long enough.

    Starts are running sums, which DataFrame functions only have as arrays that grow by copies: so first over sums of CHUNK matches, then within each chunk.
    """
    pattern = F.lit(rule.pattern)
    gaps, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    own = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    lengths = F.zip_with(gaps, matches, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("len")))
    lengths = F.zip_with(lengths, own, lambda x, y: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), F.length(y).alias("own")))
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"
    whole = lambda x: x["gap"] + F.coalesce(x["len"], F.lit(0))

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))).cast(kind)
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["own"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def within(chunk, at):
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"])

    def starts(chunks):
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        after = lambda acc, chunk: acc["at"] + F.aggregate(chunk, F.lit(0), lambda n, x: n + whole(x))
        return F.aggregate(chunks, nothing, lambda acc, chunk: F.struct(after(acc, chunk).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    split = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda k: F.slice(a, k * CHUNK + 1, CHUNK))
    return _let(lengths, lambda a: _let(split(a), lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), within))))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, spans (array of start, order, end, kind; ordered by start, then by the rules' order)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.select("doc_id", text.alias("text")).withColumn("key", _key(F.col("doc_id"), F.col("text")))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    found = F.array().cast("array<string>")
    if queries:
        grams = sorted(frozenset().union(*[a for q in queries.values() for a in q]))
        keyed = keyed.join(candidates(postings(keyed, grams), queries), "key", "left")
        found = F.coalesce("rules", found)
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    each = keyed.select("doc_id", "text", found.alias("found"))
    parts = [F.when(F.array_contains("found", r.kind), _spans(r, i, F.col("text"))).otherwise(none) if r.kind in queries else _spans(r, i, F.col("text")) for i, r in enumerate(rules)]
    return each.select("doc_id", F.sort_array(F.concat(*parts)).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def _sql(rules: tuple[Rule, ...]) -> str:
    """The same spans in DuckDB, with plain scans of every text."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: struct_pack(
      "start" := (list_sum(list_transform(string_split_regex(t, '{p}')[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[:i - 1], lambda x: length(x))), 0))::INT,
      ord := {i}, len := length(regexp_extract_all(t, '{p}')[i])::INT, kind := '{r.kind}', own := length(regexp_extract_all(t, '{p}', {r.group})[i])::INT)), lambda s: s.own >= {r.least})""")
    written = "array_to_string(list_transform(s, lambda x: x.kind || ':' || x.start || ':' || (x.start + x.len)), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(list_concat({", ".join(parts)})) AS s FROM d),
b AS (SELECT doc_id, {written} AS spans, list_filter(s, lambda x: x.ord < {len(BASE)}) AS s FROM f)
SELECT doc_id, {", ".join(f"len(list_filter(s, lambda x: x.kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce({written}, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM b"""


OP1_SQL = _sql(RULES)
