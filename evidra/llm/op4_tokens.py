"""Token ids in directly addressable codes: any token is read without decoding a block.

A segment holds the ids of consecutive documents. Each id is split into chunks of ``CHUNK_BITS`` bits, least
first. Level 0 has the first chunk of every id; level k has chunk k of those ids that need it. A level has
its chunks, bit-packed, a bitmap that says which of them continue on the next level, and a rank directory
(the count of ones before each 512 bits). To read token i: take its chunk; if its bit is set, its place
on the next level is rank(bitmap, i).

A segment's bytes (little-endian)::

    "DAC1" | u32 tokens | u32 documents | u32 chunk bits | u32 levels
    documents + 1 x u32: first token of each document, and the end
    for each level: u32 entries | u32 bytes of chunks | u32 words of bitmap | chunks | bitmap u64s | ranks u32s

Segments are rows of a table (``part, within, n_tokens, doc_ids, payload``) in the shared folder:
Spark's commit protocol makes the write whole even if executors are lost, and any store that Spark knows
will do. ``encode_segment`` and ``Segment`` handle the bytes alone.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import partitions, shared_dir

CHUNK_BITS = 8
MAGIC = b"DAC1"
RANK_BITS = 512
#: Bytes of text in a segment at most, but for a single longer document.
SEGMENT_BYTES = 4_000_000
#: Entries of a task's table of pieces, after which it is emptied.
PIECES = 800_000


# --- the code -----------------------------------------------------------------------------------


def encode_segment(ids: np.ndarray, lengths: np.ndarray, bits: int = CHUNK_BITS) -> bytes:
    """The bytes of a segment; ``lengths``: tokens of each document."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        chunk, up = rest & np.uint32((1 << bits) - 1), rest >> np.uint32(bits)
        more = up > 0
        if bits == 8:
            packed = chunk.astype(np.uint8).tobytes()
        else:
            packed = np.packbits(((chunk[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        words = np.zeros(-(-len(rest) // RANK_BITS) * RANK_BITS // 8, np.uint8)
        flat = np.packbits(more, bitorder="little")
        words[: len(flat)] = flat
        ones = np.bitwise_count(words.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
        levels.append(struct.pack("<3I", len(rest), len(packed), len(words) // 8) + packed + words.tobytes() + ranks.astype("<u4").tobytes())
        rest = up[more]
        if not len(rest):
            break
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype("<u4")
    return MAGIC + struct.pack("<4I", len(ids), len(lengths), bits, len(levels)) + ends.tobytes() + b"".join(levels)


class Segment:
    """Reads a segment's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        self.n, self.docs, self.bits, levels = struct.unpack_from("<4I", data, 4)
        at = 20
        self.ends = np.frombuffer(data, "<u4", self.docs + 1, at)
        at += 4 * (self.docs + 1)
        self.levels = []
        for _ in range(levels):
            n, size, words = struct.unpack_from("<3I", data, at)
            at += 12
            chunks = np.frombuffer(data, np.uint8, size, at)
            bitmap = np.frombuffer(data, np.uint8, words * 8, at + size)
            ranks = np.frombuffer(data, "<u4", words * 64 // RANK_BITS + 1, at + size + words * 8)
            at += size + words * 8 + 4 * len(ranks)
            self.levels.append((n, chunks, bitmap, ranks))

    def _chunk(self, chunks: np.ndarray, i: int) -> int:
        if self.bits == 8:
            return int(chunks[i])
        low = i * self.bits
        part = int.from_bytes(chunks[low // 8 : (low + self.bits + 7) // 8].tobytes(), "little")
        return part >> (low % 8) & ((1 << self.bits) - 1)

    def token(self, i: int) -> int:
        """Token i alone: a chunk and a rank on each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for _, chunks, bitmap, ranks in self.levels:
            value |= self._chunk(chunks, i) << shift
            shift += self.bits
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            first = i // RANK_BITS * (RANK_BITS // 8)
            before = int.from_bytes(bitmap[first : i // 8 + 1].tobytes(), "little") & ((1 << (i - first * 8)) - 1)
            i = int(ranks[i // RANK_BITS]) + before.bit_count()
        raise ValueError("the last level continues")

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = where = None
        for k, (n, chunks, bitmap, _) in enumerate(self.levels):
            if self.bits == 8:
                part = chunks.astype(np.uint32)
            else:
                part = (np.unpackbits(chunks, bitorder="little")[: n * self.bits].reshape(n, self.bits).astype(np.uint32) << np.arange(self.bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
            if out is None:
                out, where = part, np.arange(n)
            else:
                out[where] |= part << np.uint32(k * self.bits)
            where = where[np.unpackbits(bitmap, bitorder="little")[:n].astype(bool)]
        return out

    def doc(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return np.array([self.token(i) for i in range(self.ends[k], self.ends[k + 1])], np.uint32)


# --- encoding texts -----------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    Byte-level BPE never joins across the place before a blank that a visible character follows (a
    pre-token starts there), so texts are cut there and each distinct piece is encoded once for a task.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these are encoded whole: the library finds added tokens before it makes pieces.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that start with a blank
        self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces: they are encoded in one text, in which each starts with the only blank of its own."""
        for a in range(0, len(pieces), 20_000):
            part = pieces[a : a + 20_000]
            data = self._whole([" " + " ".join(part)])[0]
            edges = [*(4 * np.flatnonzero(self.blank[np.frombuffer(data, "<u4")])).tolist(), len(data)]
            if len(edges) == len(part) + 1:
                self.known.update(zip(part, map(data.__getitem__, map(slice, edges, edges[1:]))))
            else:  # a white space that only one of the two libraries knows
                self.known.update(zip(part, self._whole([" " + p for p in part])))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _runs(text: str) -> list[str]:
        """Pieces of a text in which blanks meet other white space; each but the first starts with a blank."""
        out: list[list[str]] = []
        for i, p in enumerate(text.split(" ")):
            if i == 0:
                out.append([p])
            elif p and not p[0].isspace():
                out.append([" ", p])
            else:  # this blank belongs to what stands before it
                out[-1] += (" ", p)
        return ["".join(x) for x in out]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.known) > PIECES:
            self.known.clear()
        whole = {i for i, t in enumerate(texts) if any(x in t for x in self.added)}
        cut = [[""] if i in whole else t.split(" ") for i, t in enumerate(texts)]
        need: set[str] = set()
        for c in cut:
            need.update(c[1:])
        fresh = need.difference(self.known)
        odd = [p for p in fresh if not p or p[0].isspace()]
        fresh.difference_update(odd)
        self._learn(list(fresh))
        self.known.update(dict.fromkeys(odd))
        get = self.known.__getitem__
        firsts = self._whole([c[0] for c in cut])
        out = []
        for i, (text, first, c) in enumerate(zip(texts, firsts, cut)):
            if i in whole:
                out += self._whole([text])
                continue
            try:
                out.append(first + b"".join(map(get, c[1:])))
            except TypeError:
                out.append(b"".join(self._whole(self._runs(text))))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Encode all texts, append ``end_id`` to each, and write segments to ``path`` in ascending id order.

    A part is a range of ids, and of hashes of texts among equal ids; ``within`` is a segment's first token counted from
    the part's. Null texts are empty, very long ones a segment of their own, rows with a null id stand first, rows
    that repeat an id are kept, next to each other. Other columns are ignored; an empty table writes no segments.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tasks = partitions(spark)
    # ranges of (id, hash of the text): Spark samples the bounds, so rows that share an id, or have none, are dealt too
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks, F.col("id").asc_nulls_first(), "tie").withColumn("part", F.spark_partition_id())

    def run(batches):
        coder = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        held, size, part_no, within = [], 0, None, 0

        def segment():
            ids = [r[0] for r in held]
            codes = [c + end for c in coder.encode([r[1] for r in held])]
            flat = np.frombuffer(b"".join(codes), "<u4")
            lengths = np.array([len(c) // 4 for c in codes])
            schema = pa.schema([("part", pa.int32()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
            return len(flat), pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part_no, within, len(flat), ids, encode_segment(flat, lengths)), schema)], schema=schema)

        for b in batches:
            for p, i, t in zip(*(c.to_pylist() for c in b.columns)):
                if held and (p != part_no or size + len(t) > segment_bytes):
                    n_tokens, out = segment()
                    yield out
                    within = within + n_tokens if p == part_no else 0
                    held, size = [], 0
                part_no = p
                held.append((i, t))
                size += len(t)
        if held:
            yield segment()[1]

    out = rows.sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "text").select("part", "id", "text").mapInArrow(run, "part int, within bigint, n_tokens bigint, doc_ids array<bigint>, payload binary")
    out.write.mode("overwrite").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the segments at ``path``."""
    table = spark.read.parquet(path)
    starts, total = {}, 0
    for p, n in sorted(table.groupBy("part").agg(F.sum("n_tokens")).collect()):  # three rows for each shuffle partition
        starts[p] = total
        total += n

    def run(batches):
        for b in batches:
            for p, w, ids, data in zip(*(b.column(c).to_pylist() for c in ("part", "within", "doc_ids", "payload"))):
                s = Segment(data)
                flat, ends = s.all().astype("<u4"), s.ends.astype(np.int64)
                crc = [zlib.crc32(flat[x:y]) for x, y in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start": ends[:-1] + starts[p] + w, "n_tokens": np.diff(ends), "ids_crc32": np.array(crc, np.int64)}), preserve_index=False
                )

    return table.select("part", "within", "doc_ids", "payload").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op4_token_ids(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded with the byte-level tokenizer, written and read back; rows as ``read_tokens`` has them."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_tokens(spark, path)
