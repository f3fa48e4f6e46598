"""Token ids as flat unsigned-integer files with 64-bit document offsets.

Layout of a data set: per shard ``<name>.bin`` (ids of all its documents, little-endian unsigned integers, one after
another), ``<name>.idx`` (unsigned 64-bit offsets into it, one more than documents) and ``<name>.doc`` (64-bit
document ids); ``manifest`` (Parquet) names the files that count, in order, with each shard's base: the number of ids
before it, a prefix sum over the shards. A reader maps the files into memory. Documents are in ascending order of id.

Files carry the attempt in their names and only rows of the manifest count, so a task that is run again (a lost
executor, speculation) leaves a whole data set. Ids are stored in 16 bits where all of them fit, else in 32.

Defined cases: a null or empty text holds only the end id; null document ids come first and are stored as the smallest
64-bit value; repeated ids are kept, in order of text; very long texts are encoded in parts, with the same ids; an empty table
gives an empty data set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import file_system
from .textbytes import slices
from .tokens import encoder, library_tokenizer

NULL_ID = -(2**63)
#: Documents and ids that are read at once (or one document with more).
READ_DOCS, READ_IDS = 4096, 4 << 20
MANIFEST = "shard int, name string, n_docs long, n_tokens long"


def id_type(path: str, end_id: int) -> str:
    return "<u2" if max(library_tokenizer(path).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, and write the data set to ``out`` (a URI that all executors reach)."""
    kind = id_type(tokenizer_path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, at = file_system(out)
        offsets, ids, sink = [np.zeros(1, np.int64)], [], None
        for batch in slices(batches):
            if sink is None:
                fs.create_dir(at, recursive=True)
                sink = fs.open_output_stream(f"{at}/{name}.bin")
            tokens, edge = encoder(tokenizer_path).encode([t or "" for t in batch.column("text").to_pylist()])
            edge = edge + np.arange(len(edge))  # room for the end ids
            data, own = np.full(edge[-1], end_id, kind), np.ones(edge[-1], bool)
            own[edge[1:] - 1] = False
            data[own] = tokens
            sink.write(data.tobytes())
            offsets.append(offsets[-1][-1] + edge[1:])
            ids.append(pc.fill_null(batch.column("doc_id"), NULL_ID).to_numpy())
        if sink is not None:
            sink.close()
            for tail, array in (("idx", np.concatenate(offsets).astype("<u8")), ("doc", np.concatenate(ids).astype("<i8"))):
                with fs.open_output_stream(f"{at}/{name}.{tail}") as f:
                    f.write(array.tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "name": [name], "n_docs": [sum(map(len, ids))], "n_tokens": [int(offsets[-1][-1])]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # null and repeated ids are spread by a hash of the text
    rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST).withColumn("id_type", F.lit(kind)).write.parquet(f"{out}/manifest")


def shards(spark: SparkSession, out: str) -> DataFrame:
    """The manifest with each shard's base: one row per file, so the ordered prefix sum is over few rows."""
    return spark.read.schema(MANIFEST + ", id_type string").parquet(f"{out}/manifest").withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


class Numbers:
    """Numbers of a file by range: memory-mapped on local file systems, read range by range on others."""

    def __init__(self, fs, path: str, kind: str):
        self.kind, self.size = np.dtype(kind), fs.get_file_info(path).size
        self.map = np.memmap(path, kind, "r") if self.size and fs.type_name == "local" else None
        self.file = fs.open_input_file(path) if self.size and self.map is None else None

    def __call__(self, low: int, high: int) -> np.ndarray:
        if self.map is not None:
            return np.asarray(self.map[low:high])
        step = self.kind.itemsize
        return np.frombuffer(self.file.read_at((high - low) * step, low * step) if self.size else b"", self.kind)


def read_token_files(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids
    as little-endian unsigned 32-bit integers) and, on request, the ids themselves. A task reads a shard, in runs of
    documents of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(out)
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, docs = (Numbers(fs, f"{at}/{row['name']}.{tail}", kind) for tail, kind in (("bin", row["id_type"]), ("idx", "<u8"), ("doc", "<i8")))
                for begin in range(0, row["n_docs"], READ_DOCS):
                    edges = offsets(begin, min(begin + READ_DOCS, row["n_docs"]) + 1).astype(np.int64)
                    low = 0
                    while low < len(edges) - 1:
                        high = max(low + 1, int(np.searchsorted(edges, edges[low] + READ_IDS, "right")) - 1)
                        edge, own = edges[low : high + 1], docs(begin + low, begin + high)
                        block = ids(int(edge[0]), int(edge[-1]))
                        parts = [block[a:b] for a, b in zip(edge[:-1] - edge[0], edge[1:] - edge[0])]
                        columns = {
                            "doc_id": pa.array(own, mask=own == NULL_ID),
                            "start": pa.array(row["base"] + edge[:-1]),
                            "n_tokens": pa.array(np.diff(edge)),
                            "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                        }
                        if with_ids:
                            columns["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(columns)
                        low = high

    manifest = shards(spark, out)
    # a number of partitions that adaptive execution keeps: rows are a few bytes, their files are not
    dealt = manifest.repartitionByRange(max(1, manifest.count()), "shard")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
