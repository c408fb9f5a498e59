"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file (about 1 MB, size-checked) is read once by the driver and
broadcast.  Long texts are cut before a lone space between two letters: no match
of the splitting pattern crosses such a place, so the ids of the parts, joined,
are the ids of the whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS_LIMIT = 64 << 20
PART_CHARS = 50_000
_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a tiktoken rank file."""
    if os.path.getsize(path) > RANKS_LIMIT:
        raise ValueError(f"{path} is larger than {RANKS_LIMIT} bytes")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cuts ``text`` at safe places into parts of about ``size`` characters."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


class Codec:
    """Encodes texts to ids and decodes ids to raw bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        out = [self.encoding.encode_ordinary(p) for p in parts(text)]
        return np.concatenate([np.asarray(x, np.uint32) for x in out])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: id, ``ids`` (array of int, if ``with_ids``), ``n_tokens`` and digests.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers and
    ``decoded_sha256`` of the decoded bytes, both in lower-case hex.  Null and empty texts
    have no ids.  Very long texts are encoded in parts cut at safe places, which gives the ids of the whole; a text
    without such a place is one part.  Rows are independent: repeated rows get equal results.  Other columns are left
    alone, whatever their names, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = Codec(shared.value, pattern)
        for batch in batches:
            number, sha, back, ids = [], [], [], []
            for t in batch.column(1):
                x = codec.encode(t.as_py() or "")
                number.append(len(x))
                sha.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(codec.decode(x)).hexdigest())
                if with_ids:
                    ids.append(x.astype(np.int32))
            arrays = [batch.column(0), pa.array(number, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``bytes`` (binary), the raw bytes of its ids (null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = Codec(shared.value, pattern)
        for batch in batches:
            raw = [codec.decode(np.asarray(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "bytes"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
