import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from objekta.llm import token_counts, token_files, tokenizer_files

JSON = tokenizer_files.public_path("word_bpe_49k.json")
MODEL = tokenizer_files.public_path("piece_bpe_32k.model")


def odd_texts(n=300, seed=1):
    rng = random.Random(seed)
    bits = ["The", "thé", "THE", "don't", "we'LL", "it's.", "x1", "42", "²", "½a", "...", "!!", "a_b", "_", "<|endoftext|>", "a<|startoftext|>b", "<|", "ß", "Σας", "ΟΔΟΣ", "İ", "é", "́x", "日本語", "word,", "(word)", "|", "'", "'s", " ", " ", "\x85", "\x1c", "\x0b", "\x0c", "\x00", "K", "Å", "ﬁ", "👍🏽", "end.", "un|deux", "▁", "a‍b", "résumé.", "naïve;"]
    space = [" ", " ", "\n", "\t", "  ", "\r\n", "", "\x0b", "\x0c"]
    return ["".join(rng.choice(bits) + rng.choice(space) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def rows():
    texts = odd_texts()
    docs = [(i * 3 % 301, t) for i, t in enumerate(texts)]
    return docs + [(7, None), (7, ""), (7, "again"), (None, "no id"), (None, None), (9000, "Very long thé text. " * 60000), (9001, texts[4]), (9002, texts[4])]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "f") for d, t in docs], "doc_id long, text string, n_tokens int, file string").repartition(6)


def test_chunks_give_what_whole_texts_give():
    library = tokenizer_files.load(JSON)
    texts = odd_texts(1500, 9)
    encoder = token_files.ChunkEncoder(JSON, remembered=40)
    for a in range(0, len(texts), 50):
        got = encoder([t.encode() for t in texts[a : a + 50]])
        for text, ids in zip(texts[a : a + 50], got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_hold_all_ids_in_order(spark, tmp_path):
    docs = rows()
    library = tokenizer_files.load(JSON)
    token_files.write_tokens(frame(spark, docs), JSON, str(tmp_path / "t"))
    want, at = [], 0
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.token_digests(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    meta = token_files.read_metadata(spark, str(tmp_path / "t")).where("doc_id = 9000")
    assert meta.collect()[0].n_tokens > 200000
    plan = meta._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan and "EqualTo(doc_id,9000)" in plan
    column = {}
    for p in (tmp_path / "t/tokens").glob("*.parquet"):
        group = pq.ParquetFile(p).metadata.row_group(0)
        column |= {group.column(i).path_in_schema: (group.column(i).encodings, group.column(i).has_offset_index) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in column["doc_id"][0] and "DELTA_BINARY_PACKED" in column["file_start"][0]
    assert any("DICTIONARY" in e for e in column["token_ids.list.element"][0]) and all(v[1] for v in column.values())


def test_no_documents(spark, tmp_path):
    token_files.write_tokens(frame(spark, rows()).limit(0), JSON, str(tmp_path / "t"))
    assert token_files.token_digests(spark, str(tmp_path / "t")).count() == 0
    assert token_counts.token_counts(frame(spark, rows()).limit(0), MODEL, str(tmp_path / "c")).count() == 0


@pytest.mark.parametrize("path", [JSON, MODEL])
def test_counts_and_cache(spark, tmp_path, path):
    docs = [(d, t and t[:200000]) for d, t in rows()]
    library = tokenizer_files.load(path)
    count = (lambda t: len(library.encode(t, add_special_tokens=False).ids)) if path == JSON else (lambda t: len(library.encode(t)))
    want = Counter((d, len((t or "").encode()), n := count(t or ""), n > 4096) for d, t in docs)
    cache = str(tmp_path / "cache")
    some = frame(spark, docs[:100])
    token_counts.token_counts(some, path, cache).collect()
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in docs[:100]})
    got = token_counts.token_counts(frame(spark, docs), path, cache)
    assert Counter(map(tuple, got.collect())) == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in docs})
    token_counts.token_counts(frame(spark, docs), path, cache).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in docs})
