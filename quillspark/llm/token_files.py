"""Token ids as flat files.

A folder holds, for each shard, `<shard>.bin`: ids one after another as little-endian unsigned integers (16 bits if
the vocabulary allows, else 32), and `<shard>.idx`: the number of documents n (64 bits), n + 1 offsets in ids from the shard's start
(64 bits), n document ids (64 bits, signed) and n bytes that are 1 where the id is null. `manifest.json` names the
shards in ascending order of documents with their bases: documents and ids before them, from prefix sums.

A task writes under a name of its own and only shards of tasks that ended well are in the manifest, so a task that
is lost and run again leaves at most a file that nobody names. Files are written and read through pyarrow's
file systems (file, hdfs, s3, gs); local ones are memory-mapped.

Null texts count as empty. Rows are ordered by id, null ids first, then by text; repeated rows stay.
An empty table gives a manifest without shards.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe

SUMMARY = "part int, shard string, n_docs long, n_ids long"
#: Ids that are read at once, and characters of a text that ranges are told apart by.
BLOCK, BEGINNING = 4_000_000, 16


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path in it."""
    return pafs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (pafs.LocalFileSystem(), folder)


def write(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, partitions: int | None = None) -> dict:
    """Encode the texts with the tokenizer at path, end each with end_id, and write them in ascending order of ids; the manifest."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    by = [F.col("id").asc_nulls_first()]
    # Rows of one id, as of null ids, are split by how their texts begin: ranges keep the order of (id, text), and their borders stay short.
    ranges = [*by, F.substring("text", 1, BEGINNING).asc_nulls_first()]
    rows = (rows.repartitionByRange(partitions, *ranges) if partitions else rows.repartitionByRange(*ranges)).sortWithinPartitions(*by, F.col("text").asc_nulls_first())
    largest = max(end_id or 0, *bpe.load_tokenizer(path).get_vocab(with_added_tokens=True).values())
    dtype = "<u2" if largest < 1 << 16 else "<u4"
    where, root = store(folder)
    where.create_dir(root, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, fs_, at = uuid.uuid4().hex, *store(folder)
        encoder, out, lengths, ids, null = bpe.pieces(path, dtype), None, [], [], []
        for batch in batches:
            column = batch.column(0)
            null.append(column.is_null().to_numpy(zero_copy_only=False))
            ids.append(column.fill_null(0).to_numpy())
            out = out or fs_.open_output_stream(f"{at}/{name}.bin")
            for run in bpe.runs(batch.column(1)):
                flat, ends = encoder.encode(run)
                lengths.append(np.diff(ends) + (end_id is not None))
                out.write(flat if end_id is None else np.insert(flat, ends[1:], end_id))
        if out:
            out.close()
            ends = np.r_[0, np.cumsum(np.concatenate(lengths))]
            with fs_.open_output_stream(f"{at}/{name}.idx") as f:
                for x in (np.array([len(ends) - 1], "<u8"), ends.astype("<u8"), np.concatenate(ids).astype("<i8"), np.concatenate(null).astype("u1")):
                    f.write(x.tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "shard": [name], "n_docs": [len(ends) - 1], "n_ids": [int(ends[-1])]})

    done = sorted(rows.mapInArrow(shard, SUMMARY).collect())  # a row for each task
    docs_before, ids_before = np.cumsum([0, *(r.n_docs for r in done)]), np.cumsum([0, *(r.n_ids for r in done)])
    manifest = {"dtype": dtype, "end_id": end_id, "shards": [{"name": r.shard, "n_docs": r.n_docs, "n_ids": r.n_ids, "docs_before": int(d), "ids_before": int(i)} for r, d, i in zip(done, docs_before, ids_before, strict=False)]}
    with where.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    where, root = store(folder)
    with where.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_shard(folder: str, shard: dict, dtype: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a shard, in blocks of whole documents: ids before the block, offsets in it, document ids, nulls, token ids."""
    where, root = store(folder)
    with where.open_input_file(f"{root}/{shard['name']}.idx") as f:
        n = int(np.frombuffer(f.read(8), "<u8")[0])
        ends, ids, null = np.frombuffer(f.read(8 * n + 8), "<u8").astype(np.int64), np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), "u1")
    local = isinstance(where, pafs.LocalFileSystem) and shard["n_ids"]
    flat = np.memmap(f"{root}/{shard['name']}.bin", dtype, "r") if local else None
    with where.open_input_file(f"{root}/{shard['name']}.bin") as f:
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK, "right")) - 1)
            size = np.dtype(dtype).itemsize
            got = flat[ends[a] : ends[b]] if flat is not None else np.frombuffer(f.read_at(int(ends[b] - ends[a]) * size, int(ends[a]) * size), dtype)
            yield int(ends[a]), ends[a : b + 1] - ends[a], ids[a:b], null[a:b], got
            a = b


def read(spark: SparkSession, folder: str) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens and ids_le32, the ids as little-endian unsigned 32-bit integers, of each document."""
    manifest = read_manifest(folder)
    shards, dtype = manifest["shards"], manifest["dtype"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for first, ends, ids, null, flat in read_shard(folder, shards[k], dtype):
                    flat = flat.astype("<u4")
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "start": shards[k]["ids_before"] + first + ends[:-1], "n_tokens": np.diff(ends),
                        "ids_le32": pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    })

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(rows, "id long, start long, n_tokens long, ids_le32 binary")
