"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two (as many of the longest as fit, then the binary
digits of the rest). Each piece is a sequence of its own, so that no sequence crosses documents and none is padded;
training batches are made within a bucket of one length. The work is a map over the rows: nothing is shuffled, and a
long document is cut where it lies, so no key can be hot.
"""

from __future__ import annotations

import functools
import gc
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkferry.llm._frames import carried, ship, slices
from sparkferry.llm._split import Known, splitter

SEQUENCE = 1024
#: A sequence id holds, from the top: the length's power, the partition, the count in the partition.
POWER_SHIFT, PARTITION_SHIFT = 58, 36
#: Distinct words whose ids a worker remembers; beyond that it forgets them all.
CACHED_WORDS = 300_000
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others 256 and up in order.
BYTE_CHARACTERS = {b: chr(b if b in _SHOWN else 256 + b - sum(s < b for s in _SHOWN)) for b in range(256)}
PIECES = "piece_start long, piece_length long, ids binary, doc_tokens long, sequence_id long, bucket int"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by a byte-level tokenizers file, equal to encode(text, add_special_tokens=False).ids, as little-endian
    unsigned 32-bit.

    Words (the tokenizer's own split, made beforehand) go through the tokenizer's model once and are remembered; a text that
    has the string of an added token, or a tokenizer with a normalizer or another split, goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(200_000, 20, 20)  # the table holds no cycles; looking through it often is what costs
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.added = [x.content for x in t.get_added_tokens_decoder().values()]
        self.simple = t.normalizer is None and str(t.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in str(t.pre_tokenizer)
        self.split, self.known = splitter(), Known(self.word, CACHED_WORDS)

    def word(self, word: str) -> bytes:
        got = [x.id for x in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(BYTE_CHARACTERS))]
        return struct.pack(f"<{len(got)}I", *got)

    def __call__(self, text: str) -> bytes:
        if not self.simple or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.known.joined(self.split(text))


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker's own encoder, which its later tasks use again."""
    return Encoder(path)


def piece_lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """n as a sum of powers of two of at most `most`, in falling order."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


def pack(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None, end_id: int = 0, most: int = SEQUENCE) -> DataFrame:
    """A row for each piece: the kept columns, then piece_start (the document's ids before it), piece_length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id and bucket (the length; write with partitionBy("bucket") to
    keep equal lengths together, see `write_buckets`). Its offset in its sequence is 0.

    A document's ids are the tokenizer's, then `end_id`; so a null or empty text makes one piece of length 1. Repeated
    rows and equal ids each make their own pieces; an empty table gives an empty one; other columns may have any name.
    sequence_id is unique in a result; it depends on how the input is partitioned.
    tokenizer: a file of the tokenizers library, on every machine's disk.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("the longest sequence must be a power of two")
    ship(df.sparkSession)
    path = tokenizer or default_tokenizer()
    made = T._parse_datatype_string(PIECES)
    rows, kept, back = carried(df, text, keep, made.names)
    schema = T.StructType(kept + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end = struct.pack("<I", end_id)
        encode, part, count = encoder(path), TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for whole in batches:
            for batch in slices(whole, "in__"):
                row, start, length, ids, total, sequence = [], [], [], [], [], []
                for i, s in enumerate(batch.column("in__").to_pylist()):
                    got = encode(s or "") + end
                    at, size = 0, len(got) // 4
                    for n in piece_lengths(size, most):
                        row.append(i), start.append(at), length.append(n), total.append(size)
                        ids.append(got[4 * at : 4 * (at + n)])
                        sequence.append((n.bit_length() - 1) << POWER_SHIFT | part << PARTITION_SHIFT | count)
                        at, count = at + n, count + 1
                held = [batch.column(batch.schema.get_field_index(f.name)).take(pa.array(row, pa.int64())) for f in kept]
                new = [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(length, pa.int32())]
                yield pa.RecordBatch.from_arrays(held + new, schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*back, *schema.names[len(kept) :])


def write_buckets(pieces: DataFrame, path: str, files: int = 8, mode: str = "errorifexists") -> None:
    """Writes pieces with a folder for each length (`bucket=1024`, ...), so that a batch of one length is read from one place.

    A bucket is dealt over so many files by its sequences' hash: however many of the pieces are of one length, no task gets more than
    that share of them, and a bucket has a bounded number of files.
    """
    pieces.repartition(files * SEQUENCE.bit_length(), "bucket", F.pmod(F.xxhash64("sequence_id"), F.lit(files))).write.mode(mode).partitionBy("bucket").parquet(path)
