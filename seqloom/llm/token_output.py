"""Token ids of whole documents in files of independently coded, checksummed blocks.

Files are Parquet, so Spark's commit protocol and any of its stores serve them. A row is a segment of whole documents:
part (long; ascending with the ids), seq (int; place in the part), doc_ids, n_tokens (arrays, one entry per document, end
id counted) and frames (array of binary: the segment's ids cut every `block_ids`, see rangecoder).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import rangecoder
from seqloom.llm.common import bound_batches, checkpointed, lean, prefix_sums, remove, scratch_folder
from seqloom.llm.token_counts import Encoder, by_bytes, tokenizer_path

SEGMENT = "part long, seq int, doc_ids array<{id}>, n_tokens array<long>, frames array<binary>"


def _encoder(path: str, end_id: int, block_ids: int, segment_ids: int, lanes: int, batch_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        bits = max(16, max(encoder.size - 1, end_id).bit_length())
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[list, list, np.ndarray]] = []  # ids of documents, their lengths, token ids
        docs, lengths, arrays, size, waiting = [], [], [], 0, 0

        def rows() -> pa.RecordBatch:
            nonlocal seq
            cut = [[ids[i : i + block_ids] for i in range(0, len(ids), block_ids)] for _, _, ids in held]
            frames = iter(rangecoder.encode_blocks([b for blocks in cut for b in blocks], bits, lanes))
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(held), pa.int64()),
                    pa.array(range(seq, seq + len(held)), pa.int32()),
                    pa.array([h[0] for h in held], pa.list_(id_type)),
                    pa.array([h[1] for h in held], pa.list_(pa.int64())),
                    pa.array([[next(frames) for _ in blocks] for blocks in cut], pa.list_(pa.binary())),
                ],
                names=["part", "seq", "doc_ids", "n_tokens", "frames"],
            )
            seq += len(held)
            held.clear()
            return made

        id_type, end = pa.int64(), np.array([end_id], np.uint32)
        for batch in batches:
            id_type = batch.schema.field("__id").type
            ids, texts = batch.column("__id").to_pylist(), batch.column("__text")
            for at, to in by_bytes(texts, batch_bytes):
                for doc, found in zip(ids[at:to], encoder.ids(texts.slice(at, to - at).to_pylist())):
                    docs.append(doc), lengths.append(len(found) + 1), arrays.extend((found, end))
                    size += len(found) + 1
                    if size >= segment_ids:
                        held.append((docs, lengths, np.concatenate(arrays)))
                        waiting += size
                        docs, lengths, arrays, size = [], [], [], 0
                    if waiting >= lanes * block_ids:
                        yield rows()
                        waiting = 0
        if docs:
            held.append((docs, lengths, np.concatenate(arrays)))
        if held:
            yield rows()

    return encode


def write_token_ids(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block_ids: int = 8192, segment_ids: int = 1 << 16, lanes: int = 512, partitions: int | None = None, batch_bytes: int = 1 << 20) -> None:
    """Encodes every whole text (null: empty), appends `end_id`, and writes the ids in ascending order of id_col.

    Null ids come first; rows that repeat an id follow each other by a hash of their text. A text that alone is longer than a
    segment is a segment of its own. `tokenizer` is a path to a .json file of the tokenizers library, present on all executors.
    An empty table gives files without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("__id"), F.xxhash64("__text")).sortWithinPartitions("__id", F.xxhash64("__text"))
    schema = SEGMENT.format(id=rows.schema["__id"].dataType.simpleString())
    encode = _encoder(tokenizer or tokenizer_path(), end_id, block_ids, segment_ids, lanes, batch_bytes)
    with bound_batches(spark):
        rows.mapInArrow(lean(encode), schema).write.mode("overwrite").parquet(path)


def _decoder(with_ids: bool, lanes: int):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = batch.column("frames").to_pylist()
            counts = [sum(rangecoder.head_of(f)[2] for f in row) for row in frames]
            at = 0
            while at < len(frames):  # enough rows to fill the lanes
                to, n = at, 0
                while to < len(frames) and (to == at or n + len(frames[to]) <= lanes):
                    n += len(frames[to])
                    to += 1
                blocks = iter(rangecoder.decode_frames([f for row in frames[at:to] for f in row], lanes))
                out: list[list] = [[], [], [], [], [], []]
                for i in range(at, to):
                    ids = np.concatenate([next(blocks) for _ in frames[i]])
                    lengths = batch.column("n_tokens")[i].as_py()
                    if sum(lengths) != counts[i]:
                        raise ValueError("a segment's documents don't add up to its blocks")
                    begin = 0
                    for doc, length in zip(batch.column("doc_ids")[i].as_py(), lengths):
                        own = ids[begin : begin + length]
                        row = (batch.column("part")[i].as_py(), batch.column("seq")[i].as_py(), doc, begin, length, own.astype(np.int32) if with_ids else zlib.crc32(own.astype("<u4").tobytes()))
                        for column, value in zip(out, row):
                            column.append(value)
                        begin += length
                id_type = batch.schema.field("doc_ids").type.value_type
                kinds = [pa.int64(), pa.int32(), id_type, pa.int64(), pa.int64(), pa.list_(pa.int32()) if with_ids else pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["part", "seq", "doc_id", "__begin", "n_tokens", "ids" if with_ids else "ids_crc32"])
                at = to

    return decode


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = True, lanes: int = 512) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, and ids (or ids_crc32, their checksum).

    Blocks whose checksum or length is wrong raise ValueError.
    """
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = files.select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = prefix_sums(parts, [], "part", "n", "__of_part").select("part", "__of_part")
    starts = prefix_sums(sizes, ["part"], "seq", "n", "__of_seq").select("part", "seq", "__of_seq").join(parts, "part")
    schema = f"part long, seq int, doc_id {id_type}, __begin long, n_tokens long, {'ids array<int>' if with_ids else 'ids_crc32 long'}"
    found = files.mapInArrow(lean(_decoder(with_ids, lanes)), schema)
    start = F.col("__of_part") + F.col("__of_seq") + F.col("__begin")
    return found.join(starts, ["part", "seq"]).select("doc_id", start.alias("start"), "n_tokens", "ids" if with_ids else "ids_crc32")


def token_digest(docs: DataFrame, **options) -> DataFrame:
    """Writes the ids to a scratch folder, reads them back and returns doc_id, start, n_tokens, ids_crc32; the files go afterwards, after errors too."""
    spark = docs.sparkSession
    path = f"{scratch_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    try:
        write_token_ids(docs, path, **options)
        with bound_batches(spark):
            return checkpointed(read_token_ids(spark, path, with_ids=False))
    finally:
        remove(spark, path)
