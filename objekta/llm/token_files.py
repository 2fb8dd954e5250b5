"""Token-ID output: Parquet files with a list column of ids, in ascending doc_id order.

Layout of a folder that write_tokens() makes: tokens/ has one file for each range of doc_id, with the columns doc_id,
file_start (ids of the file before this document), n_tokens and token_ids. Ids are dictionary encoded (a vocabulary of
under 65,536 entries takes 16 bits an id at most); doc_id and file_start only rise and are delta encoded; row groups have
ROW_GROUP_BYTES, pages PAGE_BYTES, and every column has a page index. Reading doc_id and n_tokens never touches the
ids, and a filter on doc_id reads the row groups and pages that may hold it. files/ has a row per file: its path, the ids
before it and its number of ids.

Ids are those of the tokenizers library for the whole text. Encoding is by chunk between ASCII white space, of which the
pre-tokenizers of this family never keep anything, and each worker remembers the ids of recent pieces of chunks in a bounded
store: the library encodes what the store does not have. Checked against whole-text encoding in the tests.

Defined cases: null and empty texts give the end id alone; null ids come first; rows alike in doc_id are ordered by their
text; an empty table gives a folder with no rows; long texts are one list; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from objekta.llm import tokenizer_files
from objekta.llm.common import fresh_path, partitions, table
from objekta.llm.wordhash import text_bytes

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Pieces that a worker remembers; when there are more, those of the last step stay.
REMEMBERED = 300_000
#: Bytes of text that are encoded together (one longer text is a step of its own).
STEP_BYTES = 4 << 20
#: Marks that the pre-tokenizer parts from letters before them, whatever follows (not ' < > |, which may begin something longer).
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"

TOKENS_SCHEMA = "doc_id long, file_start long, n_tokens long, token_ids array<int>"
_WRITE = {
    "parquet.block.size": ROW_GROUP_BYTES,
    "parquet.page.size": PAGE_BYTES,
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#file_start": "false",
    "compression": "snappy",
}

_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in MARKS]] = True
#: Bytes that a piece of letters may have.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_ONLY_MARKS = re.compile("[" + re.escape(MARKS) + "]+")


def _letters(text: str) -> bool:
    """Letters alone, also after the tokenizer's normalisation (which can split a mark off a letter)."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


def _parts(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words without the marks behind their letters, and these marks (up to 7 ASCII bytes, lowest first); other words stay whole."""
    data, offsets = text_bytes(words)
    ends = offsets[1:].copy()
    size = np.diff(offsets)
    tail, count, active = np.zeros(len(words), dtype=np.uint64), np.zeros(len(words), dtype=np.int64), np.flatnonzero(size > 1)
    for k in range(8):
        last = data[ends[active] - 1 - k]
        active, last = active[_MARK[last]], last[_MARK[last]]
        tail[active] = (tail[active] << np.uint64(8)) | last
        count[active] += 1
        active = active[size[active] > k + 1]
        if not len(active):
            break
    split = (count > 0) & (count < 8) & (count < size)
    other = np.r_[0, np.cumsum(_KIND[data] == 0)]
    split &= other[ends - count] == other[offsets[:-1]]
    bare = pc.utf8_rtrim(words, characters=MARKS)
    far = np.r_[0, np.cumsum(data > 127)]
    wide = np.flatnonzero(split & (far[ends] > far[offsets[:-1]]))
    if len(wide):
        split[wide] = [_letters(x) for x in bare.take(pa.array(wide)).to_numpy(zero_copy_only=False)]
    return pc.if_else(pa.array(split), bare, words), np.where(split, tail, np.uint64(0))


def _lowers(normalizer: dict | None) -> bool:
    """Whether a tokenizer's normalisation makes everything lower case."""
    return normalizer is not None and (normalizer["type"] == "Lowercase" or any(map(_lowers, normalizer.get("normalizers", ()))))


class ChunkEncoder:
    """Ids of texts. Each step's chunks are made distinct in Arrow, so that Python only meets those that are new to this worker.

    A chunk of letters with marks after them has the ids of the letters, then those of the marks; any other is one piece.
    """

    def __init__(self, path: str, end_id: int = END_ID, remembered: int = REMEMBERED):
        self.library = tokenizer_files.load(path)
        self.ends = np.zeros(self.library.get_vocab_size() + 1, dtype=bool)
        for word, i in self.library.get_vocab().items():
            self.ends[i] = word.endswith("</w>")
        #: Whether A-Z and a-z give the same ids, so that pieces are remembered in one case.
        self.lowers = _lowers(json.loads(self.library.to_str())["normalizer"])
        self.remembered = remembered
        # Piece 0 is the empty one, piece 1 the end of a text.
        self.known: dict[str, int] = {"": 0}
        self.ids = np.array([end_id], dtype=np.int32)
        self.offsets = np.array([0, 0, 1], dtype=np.int32)

    def lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.offsets), pa.array(self.ids))

    def forget_all_but(self, pieces: list[str]) -> None:
        kept = [x for x in pieces if x]
        left = self.lists().take(pa.array([0, 1, *(self.known[x] for x in kept)], pa.int32()))
        self.offsets, self.ids = left.offsets.to_numpy().copy(), left.flatten().to_numpy().copy()
        self.known = {"": 0} | {x: k for k, x in enumerate(kept, start=2)}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, one after the other, and how many each has."""
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype=np.int32), np.array([len(x) for x in found], dtype=np.int64)

    def encode_words(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pieces of letters alone, or of marks alone, give one word each: several are encoded at once and cut after word ends."""
        out = []
        parts = [words[a : a + 256] for a in range(0, len(words), 256)]
        for a in range(0, len(parts), 32):
            some = parts[a : a + 32]
            for part, found in zip(some, self.library.encode_batch_fast([" ".join(p) for p in some], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, dtype=np.int32)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part) and cuts[-1] == len(ids):
                    out.append((ids, np.diff(cuts, prepend=0)))
                else:
                    out.append(self.encode(part))
        return out

    def learn(self, new: list[str]) -> None:
        kinds = [_letters(x) or _ONLY_MARKS.fullmatch(x) is not None for x in new]
        words, whole = [x for x, k in zip(new, kinds, strict=True) if k], [x for x, k in zip(new, kinds, strict=True) if not k]
        found = self.encode_words(words) + ([self.encode(whole)] if whole else [])
        first = len(self.offsets) - 1
        for k, x in enumerate(words + whole, start=first):
            self.known[x] = k
        counts = np.concatenate([n for _, n in found])
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts).astype(np.int32)])

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Where the pieces stand in the store, which learns the missing ones first."""
        known = self.known
        if new := [x for x in pieces if x not in known]:
            self.learn(new)
        return np.array([known[x] for x in pieces], dtype=np.int32)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes, without the end."""
        counts, ids = self.column(pa.array(texts, pa.binary()).cast(pa.string()))
        flat, ends = ids.to_numpy(), np.cumsum(counts)
        return [flat[a : b - 1].astype("<i4").tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """How many ids each text has, the end included, and all ids one after the other."""
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        code = coded.indices.to_numpy()
        heads, tails = _parts(coded.dictionary)
        heads = (pc.ascii_lower(heads) if self.lowers else heads).dictionary_encode()
        pieces = heads.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()
        head = self.numbers(pieces)[heads.indices.to_numpy()]
        marks, which = np.unique(tails, return_inverse=True)
        tail = self.numbers([int(m).to_bytes(8, "little").rstrip(b"\0").decode() for m in marks])[which]
        # The distinct chunks' ids, then an end; then the chunks of all texts, each text with its end.
        pairs = np.empty(2 * len(head) + 1, dtype=np.int32)
        pairs[0:-1:2], pairs[1::2], pairs[-1] = head, tail, 1
        offsets = np.zeros(len(pairs) + 1, dtype=np.int32)
        np.cumsum(np.diff(self.offsets)[pairs], out=offsets[1:])
        offsets = np.r_[offsets[0::2], offsets[-1]]
        chunks = pa.ListArray.from_arrays(pa.array(offsets), self.lists().take(pa.array(pairs)).flatten())
        ends = bounds[1:] + np.arange(len(texts), dtype=bounds.dtype)
        places = np.ones(len(code) + len(texts), dtype=bool)
        places[ends] = False
        order = np.full(len(places), len(head), dtype=np.int32)
        order[places] = code
        until = np.cumsum(np.diff(offsets)[order], dtype=np.int64)[ends]
        ids = chunks.take(pa.array(order)).flatten()
        if len(self.known) > self.remembered:
            self.forget_all_but(pieces)
        return np.diff(until, prepend=0), ids


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def _steps(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    _, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1))
        yield at, pc.fill_null(column.slice(at, stop - at), "")
        at = stop


def _encoder(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end_id) not in _encoders:
            _encoders[path, end_id] = ChunkEncoder(path, end_id)
        before = 0
        for batch in batches:
            for at, texts in _steps(batch.column(1)) if batch.num_rows else ():
                counts, ids = _encoders[path, end_id].column(texts)
                offsets = np.r_[0, np.cumsum(counts)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(before + offsets[:-1]), pa.array(counts), lists], ["doc_id", "file_start", "n_tokens", "token_ids"])
                before += int(offsets[-1])

    return encode


def write_tokens(documents: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Writes the folder described above."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = docs.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_encoder(tokenizer_path, end_id), TOKENS_SCHEMA).write.options(**_WRITE).parquet(f"{path}/tokens")
    files = read_metadata(spark, path).groupBy("file").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_tokens").alias("n_tokens"))
    order = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files.withColumn("file_base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).write.parquet(f"{path}/files")


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, file_start, n_tokens, token_ids and file; what is not asked for is not read."""
    return spark.read.schema(TOKENS_SCHEMA).parquet(f"{path}/tokens").withColumn("file", F.col("_metadata.file_name"))


def read_metadata(spark, path: str) -> DataFrame:
    return read_tokens(spark, path).drop("token_ids")


def read_files(spark, path: str) -> DataFrame:
    return spark.read.schema("file string, first_id long, last_id long, n_tokens long, file_base long").parquet(f"{path}/files")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("token_ids")
        offsets = lists.offsets.to_numpy()
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "file", "file_start")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "file", "file_start", "n_tokens", "ids_crc32"])


def token_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    tokens = read_tokens(spark, path).select("doc_id", "file", "file_start", "token_ids")
    sums = tokens.mapInArrow(_checksums, "doc_id long, file string, file_start long, n_tokens long, ids_crc32 long")
    return sums.join(read_files(spark, path).select("file", "file_base"), "file").select("doc_id", (F.col("file_base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    path = fresh_path(spark, "token-files")
    write_tokens(documents, tokenizer_files.public_path(VOCABULARY), path)
    return token_digests(spark, path)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    return encode_and_read_back(table(spark, sf_dir, "documents"))
