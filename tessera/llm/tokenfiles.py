"""Flat token files and their two uses: counting tokens by separator scan, and compact byte-aligned id files."""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, new_path, stored
from .wordpiece import coder

# ---------------------------------------------------------------- flat files and the separator scan


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, dtype: str = "<u2", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes every document's ids and end_id to flat files without an index, one per task.

    Returns the stored side table (file, ordinal, doc_id), which says in what order a file's documents came. A file
    appears under its name only when whole, and its name is new for each attempt, so tasks can be run again. Null and
    empty texts are documents of no token; null and repeated doc_ids are kept as they come.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "flat")
    if end_id > np.iinfo(np.dtype(dtype)).max:
        raise ValueError("the end id does not fit the width")

    def write(batches):
        import pyarrow as pa

        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        end, own, n = np.array([end_id], dtype=dtype).tobytes(), coder(tokenizer, dtype), 0
        wide = np.dtype(dtype).itemsize
        out = None
        for b in batches:
            if out is None:
                out = fs.open_output_stream(f"{path}/.{name}")
            for ids, lengths in own.batch(b.column(1)):
                raw, at = ids.tobytes(), 0
                for k in (lengths * wide).tolist():
                    out.write(raw[at : at + k] + end)
                    at += k
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"] * b.num_rows), pa.array(range(n, n + b.num_rows), pa.int64()), b.column(0)], ["file", "ordinal", "doc_id"])
            n += b.num_rows
        if out is not None:
            out.close()
            fs.move(f"{path}/.{name}", f"{path}/{name}")

    side = stored(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(write, "file string, ordinal long, doc_id long"), "flat-order")
    side._tessera_folder = folder
    return side


def scan_separators(spark: SparkSession, folder: str, files: DataFrame, end_id: int, dtype: str = "<u2", block_tokens: int = 4_194_304) -> DataFrame:
    """(file, ordinal, start, n_tokens, complete) for every document of flat token files.

    files: (file). Each file is cut into blocks of block_tokens, wherever documents end. A task searches a block for
    end ids with one vectorised comparison and returns their places; a prefix scan over a file's blocks (a window over
    one small row per block) gives each block the number of documents ended before it and where the last of them
    ended, which stitches documents across blocks. Tokens after a file's last end id form a row with complete false.
    A file may be empty; one whose size is no multiple of the width is an error.
    """
    wide = np.dtype(dtype).itemsize

    def sizes(batches):
        import pyarrow as pa

        fs, _ = file_system(folder)
        for b in batches:
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.size for x in fs.get_file_info(names)], pa.int64())], ["file", "bytes"])

    def search(batches):
        import pyarrow as pa

        fs, _ = file_system(folder)
        for b in batches:
            for name, block in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True):
                with fs.open_input_file(name) as f:
                    raw = f.read_at(block_tokens * wide, block * block_tokens * wide)
                if len(raw) % wide:
                    raise ValueError(f"{name} ends within a token")
                found = np.flatnonzero(np.frombuffer(raw, dtype=dtype) == end_id) + block * block_tokens
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([len(raw) // wide], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["file", "block", "tokens", "ends"])

    step = F.lit(block_tokens * wide)
    blocks = files.select("file").distinct().mapInArrow(sizes, "file string, bytes long").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("bytes", F.lit(1)) - 1) / step))).alias("block"))
    blocks = stored(blocks, "block-list")
    n = blocks.count()
    found = stored(blocks.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism + n // 16)), "file", "block").mapInArrow(search, "file string, block long, tokens long, ends array<long>"), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file", "block", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last")).select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal0"), F.coalesce(F.last("last", True).over(before), F.lit(-1)).alias("last0")
    )
    whole = (
        found.join(carried, ["file", "block"])
        .select("file", "ordinal0", "last0", "ends", F.posexplode("ends").alias("k", "end"))
        .select("file", (F.col("ordinal0") + F.col("k")).alias("ordinal"), F.when(F.col("k") == 0, F.col("last0")).otherwise(F.try_element_at("ends", F.col("k"))).alias("prev"), "end")
        .select("file", "ordinal", (F.col("prev") + 1).alias("start"), (F.col("end") - F.col("prev") - 1).alias("n_tokens"), F.lit(True).alias("complete"))
    )
    tail = (
        found.groupBy("file")
        .agg(F.sum("tokens").alias("t"), F.sum(F.size("ends")).cast("long").alias("n"), F.max(F.try_element_at("ends", F.lit(-1))).alias("last"))
        .select("file", F.col("n").alias("ordinal"), (F.coalesce("last", F.lit(-1)) + 1).alias("start"), "t")
        .select("file", "ordinal", "start", (F.col("t") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
        .where("n_tokens > 0")
    )
    return whole.union(tail)


def token_counts(docs: DataFrame, tokenizer: str, end_id: int | None = None, dtype: str = "<u2", block_tokens: int = 4_194_304) -> DataFrame:
    """(doc_id, n_tokens): writes docs to flat files, then counts by scanning these alone.

    end_id is by default the first id that the tokenizer leaves free, as a special token's name may stand in a text.
    Null and empty texts count 0. Rows that repeat a doc_id are counted each, a null doc_id stays null, other columns
    are not read, whatever their names, and an empty table gives an empty table.
    """
    end_id = tokenizer_size(tokenizer) if end_id is None else end_id
    side = write_flat(docs, tokenizer, end_id, dtype)
    counts = scan_separators(docs.sparkSession, side._tessera_folder, side, end_id, dtype, block_tokens)
    return side.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


# ---------------------------------------------------------------- ids in byte-aligned variable-length coding

MAGIC = b"TSVB"
FILES_A_GROUP = 4096
#: For each control byte, the widths of its four values.
_WIDTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.int64)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes): two bits of width for each value, four to a control byte, and 1 to 4 data bytes."""
    v = np.ascontiguousarray(values, dtype="<u4")
    width = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < width[:, None]].tobytes()
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[: len(v)] = width - 1
    codes = codes.reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8).tobytes(), data


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values: widths come from the table by control byte, then one masked copy fills all values."""
    width = _WIDTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    if width.sum() != len(data):
        raise ValueError("control and data bytes disagree")
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4) < width[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return out.view("<u4").reshape(-1)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, dtype: str = "<u2", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stored (doc_id, uid, n_tokens, ids binary), end_id included; uid tells rows of one doc_id apart."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, end, wide = coder(tokenizer, dtype), np.array([end_id], dtype=dtype).tobytes(), np.dtype(dtype).itemsize
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            blobs: list[bytes] = []
            for ids, lengths in own.batch(b.column(1)):
                raw, at = ids.tobytes(), 0
                for k in (lengths * wide).tolist():
                    blobs.append(raw[at : at + k] + end)
                    at += k
            sizes = [len(x) // wide for x in blobs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(range(uid, uid + b.num_rows), pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "uid", "n_tokens", "ids"])
            uid += b.num_rows

    return stored(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, uid long, n_tokens long, ids binary"), "tokens")


def id_counts(tokens: DataFrame, dtype: str, vocabulary: int) -> DataFrame:
    """(id, n) over all rows; a task sends one row per id it met, so at most the vocabulary's size."""

    def run(batches):
        import pyarrow as pa

        n = np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            col = b.column(0)
            lo, hi = col.offset, col.offset + len(col)
            ends = np.frombuffer(col.buffers()[1], dtype=np.int32)
            if hi > lo and col.buffers()[2] is not None:
                n += np.bincount(np.frombuffer(col.buffers()[2], dtype=np.uint8)[ends[lo] : ends[hi]].view(dtype), minlength=vocabulary)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ranked(tokens: DataFrame, folder: str, dtype: str = "<u2", vocabulary: int = 65_536, ids_per_file: int = 4_000_000) -> DataFrame:
    """Writes token rows in ascending (doc_id, uid) order to files of this format; returns their stored list.

    Ids are replaced by their rank in falling frequency (ties: smaller id first), so frequent ids take one byte. The
    frequency table has at most `vocabulary` rows and is written to the folder as ranks.bin (ids by rank, uint32).
    A file: magic, then as uint64 the number of documents, of ids and of data bytes, then int64 doc_ids, uint32
    validity of these, uint64 lengths, control bytes, data bytes. The list: (part, path, n_docs, n_ids), parts rising
    with doc_id. A null doc_id sorts first.
    """
    counts = id_counts(tokens, dtype, vocabulary).orderBy(F.desc("n"), "id").collect()
    by_rank = np.array([r["id"] for r in counts], dtype="<u4")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/ranks.bin") as f:
        f.write(by_rank.tobytes())
    total = int(sum(r["n"] for r in counts))
    rank = np.zeros(vocabulary, dtype="<u4")
    rank[by_rank] = np.arange(len(by_rank))
    rank_blob = rank.tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ranks, fs_, root = np.frombuffer(rank_blob, dtype="<u4"), *file_system(folder)
        docs: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        for b in batches:
            docs += b.column("doc_id").to_pylist()
            lengths += b.column("n_tokens").to_pylist()
            parts += [ranks[np.frombuffer(x.as_buffer(), dtype=dtype)] for x in b.column("ids")]
        if not docs:
            return
        values = np.concatenate(parts)
        control, data = encode_values(values)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tsvb"
        with fs_.open_output_stream(f"{root}/.{name}") as f:
            f.write(MAGIC + struct.pack("<QQQ", len(docs), len(values), len(data)))
            f.write(np.array([d or 0 for d in docs], dtype="<i8").tobytes())
            f.write(np.array([d is not None for d in docs], dtype="<u4").tobytes())
            f.write(np.array(lengths, dtype="<u8").tobytes())
            f.write(control)
            f.write(data)
        fs_.move(f"{root}/.{name}", f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{root}/{name}"]), pa.array([len(docs)], pa.int64()), pa.array([len(values)], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    files = max(1, -(-total // ids_per_file))
    ordered = tokens.repartitionByRange(files, "doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    return stored(ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "files")


def read_ranked(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files of write_ranked."""

    def run(batches):
        import pyarrow as pa

        fs, root = file_system(folder)
        with fs.open_input_file(f"{root}/ranks.bin") as f:
            by_rank = np.frombuffer(f.read(), dtype="<u4")
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with fs.open_input_file(path) as f:
                    raw = memoryview(f.read())
                if raw[:4] != MAGIC:
                    raise ValueError(f"{path} is not a token file")
                docs, n, size = struct.unpack_from("<QQQ", raw, 4)
                at = 28
                ids = np.frombuffer(raw, "<i8", docs, at)
                valid = np.frombuffer(raw, "<u4", docs, at := at + 8 * docs)
                lengths = np.frombuffer(raw, "<u8", docs, at := at + 4 * docs).astype(np.int64)
                at += 8 * docs
                control = raw[at : (at := at + -(-n // 4))]
                values = by_rank[decode_values(control, raw[at : at + size], n)].tobytes()
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(values[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=valid == 0), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a prefix over groups of files, then over the files of a group, so that no task holds a row for each file
    grouped = files.withColumn("group", F.floor(F.col("part") / FILES_A_GROUP))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = grouped.groupBy("group").agg(F.sum("n_ids").alias("n")).select("group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.join(firsts, "group").select("path", (F.col("first") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("base"))
    return placed.repartition(max(1, files.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_size(path: str) -> int:
    """One more than the largest id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(os.fspath(path)).get_vocab().values()) + 1


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, dtype: str = "<u2", ids_per_file: int = 4_000_000) -> DataFrame:
    """Encodes docs, writes files in ascending doc_id order and reads them back: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts are documents of the end id alone. Rows of one doc_id, null included, keep the order of their
    input; null doc_ids come first. Other columns are not read, whatever their names, and an empty table gives an empty
    table.
    """
    tokens = token_table(docs, tokenizer, end_id, dtype)
    folder = new_path(docs.sparkSession, "ids")
    return read_ranked(write_ranked(tokens, folder, dtype, tokenizer_size(tokenizer), ids_per_file), folder)
