"""Pinned inputs and provenance manifests."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.operators.support import Shelf

PART = 128 << 20  # bytes: longer files are hashed by one task after the other, each of about so many
CODEC = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"  # names whose bytes the text reader would unpack
STATE = 112  # bytes of OpenSSL's SHA256_CTX


@cache
def _crypto() -> ctypes.CDLL:
    return ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")


class Sha256:
    """SHA-256 whose state goes from task to task, which hashlib's does not."""

    def __init__(self, state: bytes | None = None):
        self.context = ctypes.create_string_buffer(state or b"", STATE)
        if not state:
            _crypto().SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        _crypto().SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.context.raw, STATE)
        _crypto().SHA256_Final(out, last)
        return out.raw.hex()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, begin, seq, content) from lines in their order: those of one split in a batch, each with its line feed."""
    for seq, b in enumerate(batches):
        runs = pa.Table.from_batches([b]).group_by(["path", "size", "begin"], use_threads=False).aggregate([("line", "list")])
        for i in range(len(runs)):
            run = runs.slice(i, 1).combine_chunks()
            content = pc.binary_join(run["line_list"], b"\n")[0].as_py() + b"\n"
            yield pa.RecordBatch.from_arrays([*(run[c].chunk(0) for c in ("path", "size", "begin")), pa.array([seq]), pa.array([content])],
                                             ["path", "size", "begin", "seq", "content"])


def _advanced(states: dict[str, bytes], marked: set[str]):
    """The states after the contents of a turn; the line feed at a state's end waits for the next content.

    The text reader drops a byte order mark, which the files in ``marked`` get back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: dict[str, Sha256] = {}
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                if path not in chain:
                    chain[path] = Sha256(states.get(path))
                    chain[path].update(b"\n" if path in states else b"\xef\xbb\xbf" if path in marked else b"")
                else:
                    chain[path].update(b"\n")
                chain[path].update(content.as_py()[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(list(chain), pa.string()), pa.array([c.context.raw for c in chain.values()], pa.binary())],
                                         ["path", "state"])
    return run


def _long_digests(spark: SparkSession, path: str, glob: str, part: int) -> list[tuple[str, str, int]]:
    """The digests of the files longer than ``part``. A SHA-256 is one chain, so turns follow each other, a job each, and
    hand on 112 bytes a file; within a turn a task reads about ``part`` bytes of one file.

    The bytes come from Spark's text reader, which splits files and returns the bytes between line feeds as they are.
    """
    shelf, meta = Shelf(spark), F.col("_metadata")
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
             .where(~((meta["file_size"] <= part) | meta["file_path"].rlike(CODEC)))
             .select(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_block_start"].alias("begin"),
                     F.col("value").cast("binary").alias("line")))
    parts = shelf.put(lines.mapInArrow(_contents, "path string, size long, begin long, seq long, content binary")
                      .withColumn("turn", F.expr(f"begin div {part}")), "parts")
    files = parts.groupBy("path", "size").agg(F.sum(F.length("content")).alias("seen")).withColumn("more", F.expr("size - seen")).collect()
    odd = [r["path"] for r in files if r["more"] not in (0, -1, 3, 2)]
    if odd:
        raise ValueError(f"files that changed or are not read byte by byte: {odd}")
    marked, states = {r["path"] for r in files if r["more"] >= 2}, {}
    for (turn,) in sorted(parts.select("turn").distinct().collect()):
        # A partition to each file that is so long: where hashes deal them, a task may get several.
        left = [r["path"] for r in files if r["size"] > turn * part]
        now = (parts.where(F.col("turn") == turn).repartitionById(len(left), (F.array_position(F.lit(left), F.col("path")) - 1).cast("int"))
               .sortWithinPartitions("begin", "seq").select("path", "content"))
        states |= {r["path"]: bytes(r["state"]) for r in now.mapInArrow(_advanced(states, marked), "path string, state binary").collect()}
    shelf.drop("parts")
    found = []
    for r in files:
        chain = Sha256(states[r["path"]])
        chain.update(b"\n" if r["more"] in (0, 3) else b"")
        found.append((r["path"], chain.hexdigest(), r["size"]))
    return found


def _name_below(spark: SparkSession, path: str) -> Column:
    """The part of the column ``path`` below a folder, whose files may share names with those of another: a table may be a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(where).toUri().getPath().rstrip("/") + "/"
    local = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(local.startswith(root), F.substr(local, F.lit(len(root) + 1))).otherwise(F.regexp_extract("path", r"([^/]+)$", 1)).alias("file")


def file_digests(spark: SparkSession, path: str, glob: str = "*", part: int = PART) -> DataFrame:
    """(file, sha256, bytes) of every file below a path; ``file`` is its path below that one.

    Files of up to ``part`` bytes are hashed inside one row, longer ones in turns by several tasks. Two kinds stay with one
    task: a long file named as a packed one (``CODEC``), in one row of at most 2 GB, and a run without any line feed.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(path))
    name = _name_below(spark, path)
    # Conditions on the files' metadata are tried on the list of files, so that contents which are not asked for are not read.
    meta = F.col("_metadata")
    at_once = (meta["file_size"] <= part) | meta["file_path"].rlike(CODEC)
    whole = files.where(at_once).select(name, F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    if files.where(~at_once).select("length").isEmpty():
        return whole
    long = spark.createDataFrame(_long_digests(spark, path, glob, part), "path string, sha256 string, bytes long")
    # The text reader's paths are encoded as in an address.
    long = long.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    return whole.unionByName(long.select(name, "sha256", "bytes"))


def verify_pins(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """(file, status) over found and pinned files: ok, mismatch, missing or unpinned."""
    d = (found.select("file", F.col("sha256").alias("_got"))
         .join(pinned.select("file", F.col("sha256").alias("_want")), "file", "full"))
    return d.select("file", F.when(F.col("_got").isNull(), "missing").when(F.col("_want").isNull(), "unpinned")
                    .when(F.col("_got") != F.col("_want"), "mismatch").otherwise("ok").alias("status"))


def cited_sources(records: DataFrame, digests: DataFrame, file: str = "file") -> DataFrame:
    """The digests of those files only that some record cites: by the whole name, the last part of it, or the folder it begins with."""
    named = F.array(F.col("file"), F.substring_index("file", "/", -1), F.substring_index("file", "/", 1))
    hits = digests.withColumn("_named", F.explode(F.array_distinct(named)))
    cited = records.select(F.col(file).alias("_named")).distinct()
    return hits.join(cited, "_named", "left_semi").drop("_named").distinct()
