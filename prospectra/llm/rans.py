"""Token files coded by a static range asymmetric numeral system (rANS).

Duda, "Asymmetric numeral systems" (2013); Giesen, "Interleaved entropy coders" (2014).
A file set is a folder of two Parquet tables:

``table``  id, frequency: one shared static model, frequencies summing to 2**SCALE.
``blocks`` one row a block of whole documents, in ascending doc_id order:
           part, block (order), first_start (ids before the block within its part),
           doc_ids, counts (ids of each document), n_ids, payload, payload_crc32,
           ids_crc32.

A payload holds L 64-bit states (little-endian), then 32-bit words; L is LANES, or
FEW_LANES in a short block. Id t of the block belongs to lane t mod L; the decoder
takes a word for each lane, in lane order, whose state falls under 2**31. Blocks need only the shared table, so each row
is a checkpoint at which decoding can begin, and the checksums show a damaged one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored
from .tokens import encode_table, id_counts

VOCABULARY = "word_bpe_49k.json"
END = 2
#: States of a block, and of one with fewer than 16 ids for each of them.
LANES, FEW_LANES = 2048, 32
SCALE = 18
#: A block is closed when it has so many ids; it ends with a whole document.
BLOCK_IDS = 1 << 18
LOW = np.uint64(1 << 31)
_32, _LOW32 = np.uint64(32), np.uint64(0xFFFFFFFF)

BLOCKS = (
    "part int, block int, first_start long, doc_ids array<long>, counts array<long>, n_ids long,"
    " payload binary, payload_crc32 long, ids_crc32 long"
)


def quantize(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale; every id with a count gets at least 1."""
    total, room = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * (room / total)).astype(np.int64), 0)
    spare = room - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if spare > 0:
        freq[order[0]] += spare
    k = 0
    while spare < 0:  # taken back from the most frequent ids, a share each
        take = min(-spare, int(freq[order[k]]) // 4)
        freq[order[k]] -= take
        spare += take
        k = (k + 1) % len(order) if freq[order[(k + 1) % len(order)]] > 4 else 0
    return freq


def lanes_of(n: int) -> int:
    return LANES if n >= 16 * LANES else FEW_LANES


def encode_block(ids: np.ndarray, freq: np.ndarray, scale: int = SCALE) -> bytes:
    lanes = lanes_of(len(ids))
    below = (np.cumsum(freq) - freq).astype(np.uint64)
    freq = freq.astype(np.uint64)
    shift, bits = np.uint64(31 - scale + 32), np.uint64(scale)
    x = np.full(lanes, LOW)
    words: list[np.ndarray] = []
    steps = -(-len(ids) // lanes)
    for t in range(steps - 1, -1, -1):
        now = ids[t * lanes : (t + 1) * lanes]
        f, state = freq[now], x[: len(now)]
        full = state >= (f << shift)
        words.append((state[full] & _LOW32).astype("<u4"))
        state = np.where(full, state >> _32, state)
        q = state // f
        x[: len(now)] = (q << bits) + (state - q * f) + below[now]
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


class Decoder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE) -> None:
        self.scale = scale
        self.freq, self.below = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.id_of = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def block(self, payload: bytes, n: int) -> np.ndarray:
        lanes = lanes_of(n)
        x = np.frombuffer(payload, "<u8", lanes).astype(np.uint64)
        words = np.frombuffer(payload, "<u4", offset=8 * lanes).astype(np.uint64)
        mask, bits, at = np.uint64((1 << self.scale) - 1), np.uint64(self.scale), 0
        out = np.empty(n, np.int32)
        for begin in range(0, n, lanes):
            state = x[: min(lanes, n - begin)]
            slot = state & mask
            now = self.id_of[slot]
            out[begin : begin + len(state)] = now
            state = self.freq[now] * (state >> bits) + slot - self.below[now]
            short = np.flatnonzero(state < LOW)
            if at + len(short) > len(words):
                raise ValueError("a payload ends early")
            state[short] = state[short] << _32 | words[at : at + len(short)]
            at += len(short)
            x[: len(state)] = state
        if at != len(words) or (n and (x != LOW).any()):
            raise ValueError("a payload does not end where its ids do")
        return out


def _block_writer(freq: np.ndarray):
    def row(part: int, block: int, first: int, doc_ids: list, docs: list[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(docs), "<u2")
        payload = encode_block(ids, freq)
        values = (
            part, block, first, doc_ids, [len(d) // 2 for d in docs], len(ids), payload, zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes()),
        )
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        block = first = size = 0
        doc_ids, docs = [], []
        for b in batches:
            for i, v in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                doc_ids.append(i)
                docs.append(v.as_py())
                size += len(docs[-1]) // 2
                if size >= BLOCK_IDS:
                    yield row(part, block, first, doc_ids, docs)
                    block, first, size, doc_ids, docs = block + 1, first + size, 0, [], []
        if docs:
            yield row(part, block, first, doc_ids, docs)

    return write


def write_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Encode ``docs`` (doc_id, text) and write the file set to ``path``.

    Rows with a null id come first; rows of one id follow each other in the order of a
    hash of their ids, equal rows in any order. A stored row number lets a range end
    between equal rows, so that an id that very many rows share is no single task.
    """
    spark = docs.sparkSession
    encoded = encode_table(docs.select(F.col("doc_id").cast("long"), "text"), vocabulary, end)
    rows = stored(encoded.withColumn("row", F.monotonically_increasing_id()), "rans-ids")
    freq = quantize(id_counts(rows))
    model = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(model, "id int, frequency int").coalesce(1).write.parquet(f"{path}/table")
    order = ["doc_id", F.xxhash64("ids"), "row"]
    (
        rows.select("doc_id", "ids", "row").repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_block_writer(freq), BLOCKS).write.parquet(f"{path}/blocks")
    )


def _block_reader(freq: np.ndarray, before: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(freq)
        for b in batches:
            for r in range(b.num_rows):
                part, first, n, crc, ids_crc = (b.column(c)[r].as_py() for c in ("part", "first_start", "n_ids", "payload_crc32", "ids_crc32"))
                payload = b.column("payload")[r].as_py()
                if zlib.crc32(payload) != crc:
                    raise ValueError(f"payload checksum differs in part {part}")
                data = decoder.block(payload, n).astype("<u4")
                if zlib.crc32(data.tobytes()) != ids_crc:
                    raise ValueError(f"id checksum differs in part {part}")
                counts = b.column("counts")[r].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(counts)
                starts = ends - counts
                sums = [zlib.crc32(data[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[r].values, pa.array(starts + (first + before[part])), pa.array(counts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from a file set, block by block."""
    freq = np.zeros(1 << 16, np.int64)
    for r in spark.read.parquet(f"{path}/table").collect():
        freq[r.id] = r.frequency
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row for each part, of which there are as many as tasks that wrote
    sizes = sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect()))
    before, total = {}, 0
    for part, n in sizes:
        before[part], total = total, total + n
    return blocks.mapInArrow(_block_reader(freq, before), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame) -> DataFrame:
    """Write the whole table as token files in the shared folder and read them back.

    A null or empty text is the end id alone, one of any length is encoded whole. Rows
    repeated with one id are documents of their own. Other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    path = scratch(spark, "rans")
    write_files(docs, path)
    return read_files(spark, path)
