"""Operator 8, packing: power-of-two decomposition.

A document's token ids, with an end id after them, are cut into as many pieces of
max_len as fit, then pieces of falling powers of two, its binary digits. A piece is a
sequence of its own: sequences of length 2 ** b form bucket b, none crosses documents and
none is padded. So packing needs no shuffle at all; write_buckets lays the buckets out,
a folder each, from which batches of one length are read.

Null text: empty, so only the end id. Repeated rows are packed each for itself. A null
doc_id is carried as null; sequence_id tells such rows apart. It names a sequence within
one result, and depends on how that is partitioned. Empty table: empty result.
Long texts are handled one at a time and emitted in blocks. Other columns are left out.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, documents, pick, strings

MAX_LEN = 2048
END_ID = 1
#: Bytes of ids in a block of output.
BLOCK = 8 << 20
#: How byte-level tokenizers split a text before they merge (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BLANKS = re.compile(r"\s{1000}")


class Tokenizer:
    """The ids of a byte-level BPE vocabulary in a tokenizers file.

    tiktoken merges the same ranks and splits by the same pattern several times faster,
    and cuts out the marks that the file adds to the vocabulary, as the tokenizers library
    does; that takes texts with long blanks, on which tiktoken's pattern engine runs out
    of stack.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split = file["pre_tokenizer"]
        if file["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a plain byte-level tokenizer")
        of = _bytes_of()
        added = file["added_tokens"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("marks that take in what is around them are not known here")
        marks = {x["content"]: x["id"] for x in added}
        ranks = {bytes(map(of.__getitem__, piece)): k for piece, k in file["model"]["vocab"].items() if piece not in marks}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=marks)

    def ids(self, text: str) -> bytes:
        if _BLANKS.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode(text, allowed_special="all")
        return np.asarray(ids, "<u4").tobytes()


def _bytes_of() -> dict[str, int]:
    """The character that stands for each byte in such a file: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def cuts(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, bucket, ids, doc_tokens, sequence_id, offset): a row a piece; ids as little-endian unsigned 32-bit."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    slim = pick(docs, "doc_id", "text")
    kind = dict(slim.dtypes)["doc_id"]
    end = np.asarray([end_id], "<u4").tobytes()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)
        for batch in batches:
            at, rows, held = [], [], 0

            def block(keys=batch.column(0)):
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                types = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
                arrays = [keys.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))]
                return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens"])

            for i, text in enumerate(strings(batch.column(1))):
                ids = t.ids(text) + end
                start = 0
                for n in cuts(len(ids) // 4, max_len):
                    at.append(i)
                    rows.append((start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4))
                    start += n
                held += len(ids)
                if held >= BLOCK:
                    yield block()
                    at, rows, held = [], [], 0
            if rows:
                yield block()

    pieces = arrow_map(slim, work, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    bucket = F.log2("length").cast("int").alias("bucket")
    return pieces.select("doc_id", "start", "length", bucket, "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", "bucket", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences, a folder for each length: at most log2(max_len) + 1 of them."""
    packed.write.partitionBy("bucket").parquet(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir), public_path("byte_bpe_50k.json")))
