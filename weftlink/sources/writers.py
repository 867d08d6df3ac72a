"""Sinks: row-limited shards by split, small CSV tables, text reports."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..schema import SHARD_COLUMNS
from .scratch import written

FORMATS = {"auto": "parquet", "parquet": "parquet", "csv": "csv", "tsv": "csv"}
# Rows that a task writes in one go, about, ids in a piece of a list, rows in a row group.
CHUNK, PIECE, ROW_GROUP = 65_536, 512, 131_072
# Fixed value: characters that Spark escapes in the names of partition folders, besides control characters.
ESCAPED = set("\"#%'*/:=?\\{[]^\x7f")


def _part(column: str) -> Column:
    """A hashed part of a group: its row numbers are taken inside parts and offset by the parts before."""
    return F.substring(F.md5(F.col(column).cast("string")), 1, 2)


def _bases(sizes: DataFrame, group: str) -> DataFrame:
    """``(group, _part, _base)`` from ``(group, _part, _n)``, at most 256 rows a group."""
    ahead = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(group, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))


def shard_numbers(df: DataFrame, shard_size: int = 50_000, group: str = "split", order: tuple[str, ...] = ("s1_id", "secondary_id")) -> DataFrame:
    """``df`` with ``shard``, numbered from 0 in each group, full but for the last.

    Row numbers are taken in hashed parts of a group and offset by the parts before, so a group is not one task's work.
    """
    parts = df.withColumn("_part", _part(order[0]))
    sizes = _bases(parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")), group)
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    numbered = parts.withColumn("_place", place).join(sizes, [group, "_part"])
    return numbered.withColumn("shard", F.floor((F.col("_place") + F.col("_base")) / shard_size).cast("int")).drop("_part", "_place", "_base")


def _listed(members: DataFrame, items: DataFrame, shard_size: int) -> DataFrame:
    """``(split, s1_id, at, ...)``: ``members`` and ``items`` joined by ``list``, in arrays that begin at row ``at`` of the
    split, with rows in the order of ``shard_numbers``, and shard after shard in each partition. Records are numbered by
    the sizes of their lists: no pair is ranked or shuffled alone."""
    fields = [c for c in items.columns if c != "list"]
    place = F.row_number().over(Window.partitionBy("list").orderBy("secondary_id")) - 1
    pieces = items.withColumn("piece", F.floor(place / PIECE)).groupBy("list", "piece").agg(F.array_sort(F.collect_list(F.struct("secondary_id", *[c for c in fields if c != "secondary_id"]))).alias("items"))
    # Arrays of plain values are smaller than arrays of structs.
    pieces = written(pieces.select("list", (F.col("piece") * PIECE).alias("from"), *[F.col(f"items.{c}").alias(c) for c in fields]), "pieces")
    sizes = pieces.groupBy("list").agg(F.sum(F.size("secondary_id")).alias("_n"))
    parts = written(members.select("split", "s1_id", "list", _part("s1_id").alias("_part")).join(sizes, "list"), "sizes")
    ahead = Window.partitionBy("split", "_part").orderBy("s1_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = _bases(parts.groupBy("split", "_part").agg(F.sum("_n").alias("_n")), "split")
    begins = parts.withColumn("at", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).join(bases, ["split", "_part"]).select("split", "s1_id", "list", (F.col("at") + F.col("_base")).alias("at"))
    met = begins.join(pieces, "list").withColumn("at", F.col("at") + F.col("from"))
    chunk = shard_size * -(-CHUNK // shard_size)
    of = lambda c: F.floor(c / chunk).cast("long")
    cut = met.withColumn("chunk", F.explode(F.sequence(of(F.col("at")), of(F.col("at") + F.size("secondary_id") - 1))))
    cut = cut.withColumn("skip", F.greatest(F.lit(0), F.col("chunk") * chunk - F.col("at")).cast("int"))
    keep = F.least(F.size("secondary_id"), F.col("chunk") * chunk + chunk - F.col("at")).cast("int") - F.col("skip")
    cut = cut.select("split", "chunk", "s1_id", (F.col("at") + F.col("skip")).alias("at"), *[F.slice(c, F.col("skip") + 1, keep).alias(c) for c in fields])
    return cut.repartition("split", "chunk").sortWithinPartitions("split", "at").drop("chunk")


def write_shards(df: DataFrame, output_dir: str, shard_size: int = 50_000, file_format: str = "auto", columns: Iterable[str] = SHARD_COLUMNS) -> DataFrame:
    """Write rows in shards of at most ``shard_size`` rows, a file a shard; returns ``(split, shard, rows)``. Files are
    ``split=<s>/<s>_part_<n>.parquet`` in a local or shared file system, else one in each folder ``split=<s>/shard=<n>``."""
    _check(file_format)
    rows = shard_numbers(df, shard_size).select(*columns, "split", "shard").repartition("split", "shard").sortWithinPartitions("split", "shard")
    return _write(rows, output_dir, file_format, list(columns))


def write_listed_shards(members: DataFrame, items: DataFrame, output_dir: str, shard_size: int = 50_000, file_format: str = "auto", columns: Iterable[str] = SHARD_COLUMNS) -> DataFrame:
    """``write_shards`` of the pairs of records and the items of their lists. ``members``: (s1_id, split, list), a row a
    record; ``items``: (list, secondary_id, ...), each id once in a list."""
    _check(file_format)
    fields, lists = [c for c in items.columns if c != "list"], _listed(members, items, shard_size)
    if FORMATS[file_format] == "parquet" and (root := _local(lists.sparkSession, output_dir)) is not None:
        return _write_files(lists, output_dir, listed_writer(root, list(columns), fields, shard_size))
    rows = lists.select("split", "s1_id", "at", F.posexplode(F.arrays_zip(*fields)).alias("pos", "item")).withColumn("shard", F.floor((F.col("at") + F.col("pos")) / shard_size).cast("int"))
    return _write(rows.select("split", "shard", "s1_id", "item.*").select(*columns, "split", "shard"), output_dir, file_format, list(columns))


def _check(file_format: str) -> None:
    if file_format not in FORMATS:
        raise ValueError(f"unknown format {file_format!r}")


def _write(rows: DataFrame, output_dir: str, file_format: str, columns: list[str]) -> DataFrame:
    """Write ``rows``, shard after shard in each partition and each shard in one."""
    kind, spark = FORMATS[file_format], rows.sparkSession
    if kind == "parquet" and (root := _local(spark, output_dir)) is not None:
        return _write_files(rows, output_dir, shard_writer(root, columns))
    writer, back = rows.write.mode("overwrite").partitionBy("split", "shard"), spark.read.format(kind)
    if kind == "csv":
        sep = "\t" if file_format == "tsv" else ","
        writer, back = writer.option("header", True).option("sep", sep), back.option("header", True).option("sep", sep)
    writer.format(kind).save(output_dir)
    return back.load(output_dir).groupBy("split", "shard").agg(F.count(F.lit(1)).alias("rows"))


def _local(spark: SparkSession, path: str) -> str | None:
    """The path in the (shared) file system, None if it is in another."""
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = urlsplit(of.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(of).toUri().toString())
    return unquote(uri.path) if uri.scheme == "file" else None


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _write_files(rows: DataFrame, output_dir: str, kernel: Kernel) -> DataFrame:
    """Parquet files from Arrow batches: of small shards a second has many, where Spark's writer needs a process a file."""
    of = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(output_dir)
    files = of.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    files.delete(of, True)
    files.mkdirs(of)
    out = written(rows.mapInArrow(kernel, "split string, shard int, rows long"), "shards-written")
    files.create(rows.sparkSession._jvm.org.apache.hadoop.fs.Path(of, "_SUCCESS")).close()
    return out


def _escaped(name: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in name)


def shard_file(split: str, shard: int) -> str:
    """Where a Parquet shard is: a file in the folder of its split, since a folder each would double space and files."""
    return f"split={split}/{split}_part_{shard:03d}.parquet"


def shard_writer(root: str, columns: list[str]) -> Kernel:
    """The kernel: each run of rows with one ``split`` and ``shard`` becomes a file. A file gets its name when it is
    complete, so a task that is run again replaces whole files by the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, file, sink, done, rows, path = None, [], None, None, [], 0, ""
        folder = os.path.join(root, f"_temporary-{os.urandom(8).hex()}")
        temporary = f"{folder}/shard"
        os.makedirs(folder)
        splits: dict[str | None, str] = {}

        def flush() -> None:
            nonlocal held, file, sink
            table = pa.Table.from_batches(held)
            if sink is None:
                file = pa.OSFile(temporary, "wb")
                sink = pq.ParquetWriter(file, table.schema, compression="snappy", write_statistics=False, store_schema=False)
            sink.write_table(table)
            held = []

        def finish() -> None:
            nonlocal sink
            if key is None:
                return
            if held:
                flush()
            sink.close()
            file.close()
            sink = None
            os.replace(temporary, path)
            done.append((*key, rows))

        def counts() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["split", "shard", "rows"])
            done.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            split, shard = batch.column("split"), batch.column("shard").to_numpy(zero_copy_only=False)
            codes = pc.dictionary_encode(split, null_encoding="encode")
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), batch.num_rows]
            data = batch.select(columns)
            for i, j in zip(starts, starts[1:]):
                now = (names[code[i]], int(shard[i]))
                if now != key:
                    finish()
                    key, rows = now, 0
                    if now[0] not in splits:
                        splits[now[0]] = "__HIVE_DEFAULT_PARTITION__" if now[0] in (None, "") else _escaped(now[0])
                        os.makedirs(os.path.join(root, f"split={splits[now[0]]}"), exist_ok=True)
                    path = os.path.join(root, shard_file(splits[now[0]], now[1]))
                held.append(data.slice(i, j - i))
                rows += j - i
                if rows % ROW_GROUP < j - i:
                    flush()
            yield counts()
        finish()
        os.rmdir(folder)
        yield counts()

    return run


def listed_writer(root: str, columns: list[str], fields: list[str], shard_size: int) -> Kernel:
    """``shard_writer`` of arrays ``fields`` that begin at row ``at`` of their split."""
    write = shard_writer(root, columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                n = pc.list_value_length(few.column("secondary_id")).to_numpy(zero_copy_only=False)
                row, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
                place = np.arange(len(row)) - np.repeat(ends - n, n) + few.column("at").to_numpy(zero_copy_only=False)[row]
                data = {c: pc.list_flatten(few.column(c)) if c in fields else few.column(c).take(pa.array(row)) for c in dict.fromkeys((*columns, "split"))}
                yield pa.RecordBatch.from_pydict(data | {"shard": pa.array((place // shard_size).astype(np.int32))})

    return lambda batches: write(rows(batches))


def write_table(df: DataFrame, *output_dirs: str) -> None:
    """A small table as one CSV file in each folder."""
    for d in output_dirs:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(d)


def write_text(text: str, *paths: str) -> str:
    for p in map(Path, paths):
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return text
