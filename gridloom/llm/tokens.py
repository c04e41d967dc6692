"""Token ids of documents in a binary file format, written in the order of doc_id.

The file is a Parquet table, so that Spark's committers make writing safe against lost executors and any store can
hold it. A row is a segment: whole documents up to about `segment` ids, as patched frame-of-reference blocks (pfor.py),
with their doc_ids and lengths. Segments are ordered by (part, segment).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import pfor
from .common import map_arrow, shared_dir, table
from .units import UnitCache

SEGMENTS = "part int, segment int, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
# In texts of these characters only, a space between two other characters is where the byte-level splitter cuts.
_UNCOMMON = re.compile("[^\t\n\r\x20-\x7e\xa1\xa7\xa9\xab\xae\xb0\xbb\xbf\xc0-ſ‐-‧€]")


class UnitEncoder:
    """Encodes whole texts with the tokenizers library. Its byte-level splitter always cuts before a single space, so
    a text is cut into units that begin with a space, and each distinct unit is encoded once. Texts with characters outside the common ranges, with two spaces in a row or with the string of an added token go
    through the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a byte-level piece has a character for each
        for piece, k in vocabulary.items():
            self.width[k] = len(piece)
        self.cache = UnitCache(self._learn, self._whole)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        common: list[int] = []
        for i, text in enumerate(texts):
            if not text or "  " in text or _UNCOMMON.search(text) or self.added and self.added.search(text):
                out[i] = self._whole(text)
            else:
                common.append(i)
        for i, ids in zip(common, self.cache.encode([texts[i].encode() for i in common]), strict=True):
            out[i] = ids
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, units: list[bytes]) -> list[np.ndarray]:
        """Units that begin with a space are encoded many at once and told apart by the bytes of their ids."""
        out: list[np.ndarray | None] = [None] * len(units)
        spaced = [i for i, u in enumerate(units) if u[0] == 32 and len(u) > 1]
        for i in set(range(len(units))) - set(spaced):
            out[i] = self._whole(units[i].decode())
        for k in range(0, len(spaced), 2000):
            some = spaced[k : k + 2000]
            joined = b"".join([units[i] for i in some]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            upto = np.cumsum(self.width[ids])
            cuts = np.searchsorted(upto, np.cumsum([len(units[i]) for i in some]), "left") + 1
            for i, of in zip(some, np.split(ids, cuts[:-1]), strict=True):
                out[i] = of
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment: int = 1 << 16, share: float = 0.9) -> None:
    """Writes the ids of every document, each ended by `end_id`, to `path`. A null text counts as the empty text; null
    doc_ids come first; documents of one doc_id are ordered by a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        ids, lengths, chunks, held = [], [], [], 0

        def flush():
            nonlocal no, ids, lengths, chunks, held
            payload = pfor.encode(np.concatenate(chunks), share)
            row = [[part], [no], [held], [ids], [lengths], [payload]]
            no, ids, lengths, chunks, held = no + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _types(), strict=True)], names=_names())

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                few = batch.slice(at, 2048)
                for doc_id, found in zip(few.column(0).to_pylist(), enc.encode([t or "" for t in few.column(1).to_pylist()]), strict=True):
                    n = len(found) + 1
                    ids.append(doc_id)
                    lengths.append(n)
                    chunks += (found, end)
                    held += n
                    if held >= segment:
                        yield flush()
        if ids:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).select("doc_id", "text")
    map_arrow(rows, run, SEGMENTS).write.option("parquet.block.size", 32 << 20).parquet(path)


def _names() -> list[str]:
    return ["part", "segment", "n_tokens", "doc_ids", "lengths", "payload"]


def _types() -> list[pa.DataType]:
    return [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def document_digests(segments: DataFrame) -> DataFrame:
    """Per document, from the decoded segments: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, segment, doc_ids, lengths, payload = (batch.column(c)[k] for c in range(5))
                ids = pfor.decode(payload.as_buffer())
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                if ends[-1] != len(ids):
                    raise ValueError(f"segment {part}/{segment} holds {len(ids)} ids, its index says {ends[-1]}")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - n, ends, strict=True)]
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * size, pa.int32()), pa.array([segment.as_py()] * size, pa.int32()), doc_ids.values, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = map_arrow(segments.select("part", "segment", "doc_ids", "lengths", "payload"), run, "part int, segment int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    # A segment starts where those before it end: within its part, and the part after the parts before it.
    sums = segments.select("part", "segment", "n_tokens")
    in_part = sums.select("part", "segment", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))
    starts = in_part.join(parts, "part").select("part", "segment", (F.col("s") + F.col("p")).alias("first"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_blocks(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the written file. A null text is encoded
    as the empty text and so is the end id alone; an empty table gives no rows; other columns are not read."""
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return document_digests(read_tokens(spark, path))
