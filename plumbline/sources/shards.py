"""Cache shards: written, verified and published as one commit; read by a data source that skips what is not asked for.

A published table is a folder of generations with a pointer, ``current.json``. Its shards are Parquet files; ``shards`` beside
them is a table with path, rows, bytes and sha256 of each. A reader follows the pointer, so it sees a generation whole or not
at all. The data source also reads shards from elsewhere, each with its metadata in ``<shard>.json``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..operators.quality import violations

# --- checks in the same pass as the write -----------------------------------------------------------------------------


def checked(df: DataFrame, checks: dict[str, Column], *, key: str) -> DataFrame:
    """``df``, which raises for the first row that breaks a check, with the row's key and messages, whenever it is computed."""
    bad = F.array_join(violations(checks), "; ")
    first, *rest = df.columns
    stop = F.raise_error(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), bad)).cast(df.schema[first].dataType)
    return df.select(F.when(bad != "", stop).otherwise(F.col(first)).alias(first), *rest)


# --- files of the store that Spark writes to ---------------------------------------------------------------------------


class Store:
    """The few operations on single files that a commit needs, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def rename(self, source: str, target: str) -> None:
        """Parents of the target are made; a target that is there is an error."""
        self.fs.mkdirs(self.at(target).getParent())
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{source} could not be renamed to {target}")

    def write(self, path: str, text: str) -> None:
        """A reader sees the old text or the new one."""
        draft = self.at(f"{path}.{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        target = self.fs.makeQualified(self.at(path))
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(self.fs.makeQualified(draft), target, options)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``bytes``, ``sha256`` of a folder's Parquet files, read in tasks; a shard is a small file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish(df: DataFrame, root: str, *, by: tuple[str, ...] = (), rows_per_file: int = 128, checks: dict[str, Column] | None = None, key: str | None = None, metadata: dict | None = None) -> dict:
    """Writes a generation of ``df`` under ``root`` and makes it the current one; returns what the pointer says.

    One job computes ``df``, checks its rows and writes them. A second reads every shard back whole: its rows, a hash over
    all their values (columns with maps aside) and the digest of its bytes go to the table of shards. Unless the types are
    those that were to be written, or where anything fails, the generation is removed and the one before stays current.
    """
    spark = df.sparkSession
    root, generation = root.rstrip("/"), uuid.uuid4().hex
    home, store = f"{root}/{generation}", Store(df.sparkSession, root)
    rows = checked(df, checks, key=key or df.columns[0]) if checks else df
    try:
        rows.write.option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(f"{home}/data")
        back = spark.read.schema(df.schema).parquet(f"{home}/data")
        files = digests(spark, f"{home}/data")
        kinds = {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{home}/data").schema} if files.limit(1).count() else {}
        odd = [f.name for f in df.schema if kinds and f.name not in by and kinds.get(f.name) != f.dataType.simpleString()]
        if odd:
            raise OSError(f"{home}: other types than were written: {', '.join(odd)}")
        values = [F.col(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t]
        content = F.bit_xor(F.xxhash64(*values)) if values else F.lit(0)
        counts = back.groupBy(F.col("_metadata.file_path").alias("file"), *by).agg(F.count("*").alias("rows"), content.alias("content"))
        files = files.join(counts, "file", "left")  # an empty file has no row to count
        files.withColumn("rows", F.coalesce("rows", F.lit(0).cast("long"))).write.parquet(f"{home}/shards")
        found = spark.read.parquet(f"{home}/shards").agg(F.count("*").alias("shards"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().asDict()
        said = {"generation": generation, **found, "columns": [[f.name, f.dataType.simpleString()] for f in df.schema], **({"metadata": metadata} if metadata else {})}
        store.write(f"{root}/current.json", json.dumps(said, sort_keys=True))
    except BaseException:
        store.delete(home)
        raise
    return said


def current(spark: SparkSession, root: str) -> dict:
    """What the pointer of a published table says."""
    text = spark.read.text(f"{root.rstrip('/')}/current.json", wholetext=True).first()
    return json.loads(text[0])


def read_published(spark: SparkSession, root: str, *, verify: bool = False) -> DataFrame:
    """The current generation. ``verify`` compares every shard's digest first and raises where one differs, is gone or is new."""
    said = current(spark, root)
    home = f"{root.rstrip('/')}/{said['generation']}"
    if verify:
        name = F.element_at(F.split("file", f"/{said['generation']}/"), -1).alias("name")  # the table may have been moved as a whole
        want = spark.read.parquet(f"{home}/shards").select(name, F.col("sha256").alias("want"))
        odd = want.join(digests(spark, f"{home}/data").select(name, "sha256"), "name", "full_outer").where(~F.col("want").eqNullSafe(F.col("sha256")))
        bad = odd.select("name").limit(3).collect()
        if bad:
            raise OSError(f"{home}: shards differ from what was published: {', '.join(r['name'] for r in bad)}")
    schema = ", ".join(f"`{n}` {t}" for n, t in said["columns"])
    return spark.read.schema(schema).parquet(f"{home}/data")


# --- a data source of shards ------------------------------------------------------------------------------------------

IDENTITY = ("model_name", "dataset_name", "subset", "split", "source_dataset")
VECTORS = ("layer_vectors", "first_token_logits")
_TYPES = {c: pa.string() for c in (*IDENTITY, "sample_id", "image_id", "image_path", "question", "object_name", "answer_text", "shard_path")} | {"label": pa.int32(), "parsed": pa.int32(), "selected_layers": pa.list_(pa.int32()), "layer_vectors": pa.list_(pa.list_(pa.float32())), "first_token_logits": pa.list_(pa.float32())}
_SPARK = {pa.string(): "string", pa.int32(): "int", pa.list_(pa.int32()): "array<int>", pa.list_(pa.float32()): "array<float>", pa.list_(pa.list_(pa.float32())): "array<array<float>>"}


@dataclass
class Shards(InputPartition):
    paths: list[str]


@dataclass
class ShardReader(DataSourceReader):
    """Files and sidecars by pyarrow; predicates on identity columns are pushed to it."""

    path: str
    columns: list[str]
    bytes_per_task: int
    tests: dict[str, list[set]] = field(default_factory=dict)

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in IDENTITY:
                self.tests.setdefault(f.attribute[0], []).append(set(f.value) if isinstance(f, In) else {f.value})
            else:
                yield f

    def partitions(self) -> list[Shards]:
        """Files by size in order of path, about ``bytes_per_task`` to a task."""
        fs, at = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        found = sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if x.is_file and x.extension == "parquet" and not x.base_name.startswith(("_", ".")))
        out, size = [], 0
        for path, n in found:
            if not out or size + n > self.bytes_per_task:
                out.append(Shards([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Shards([])]

    def read(self, partition: Shards) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        for path in partition.paths:
            yield from self.shard(fs, path)

    def shard(self, fs: pafs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        side, file = self.sidecar(fs, f"{path}.json"), pq.ParquetFile(path, filesystem=fs)
        if not self.may_hold(side, file):  # told by sidecar and footer
            return
        there, wanted = set(file.schema_arrow.names), list(dict.fromkeys((*self.columns, *self.tests)))
        for batch in file.iter_batches(columns=[c for c in wanted if c in there], batch_size=256):
            cols = {c: batch.column(c).cast(_TYPES[c]) if c in there else pa.nulls(batch.num_rows, _TYPES[c]) for c in wanted}
            for c in set(wanted) & set(IDENTITY):
                cols[c] = pa.array([v.strip() if v and v.strip() else side.get(c) for v in cols[c].to_pylist()], pa.string())
            if "shard_path" in cols:
                cols["shard_path"] = pa.array([path] * batch.num_rows, pa.string())
            out = pa.RecordBatch.from_pydict(cols)
            for c, tests in self.tests.items():
                out = out.filter(pa.array([all(v in values for values in tests) for v in out.column(c).to_pylist()], pa.bool_()))
            yield out.select(self.columns)

    def sidecar(self, fs: pafs.FileSystem, path: str) -> dict[str, str]:
        """Identity values of a sidecar, trimmed; none where there is no sidecar."""
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return {}
        with fs.open_input_stream(path) as f:
            said = json.loads(f.read())
        return {c: str(said[c]).strip() for c in IDENTITY if isinstance(said, dict) and said.get(c) is not None and str(said[c]).strip()}

    def may_hold(self, side: dict[str, str], file: pq.ParquetFile) -> bool:
        """Whether rows may pass the tests: the sidecar's value is that of all rows where the file has none of its own."""
        return not any(blank(file, c) and any(side.get(c) not in values for values in tests) for c, tests in self.tests.items())


def blank(file: pq.ParquetFile, column: str) -> bool:
    """Whether a file lacks a column or has only nulls in it, by its footer."""
    names = [file.schema.column(k).path for k in range(len(file.schema))]
    if column not in names:
        return True
    at = names.index(column)
    stats = [file.metadata.row_group(g).column(at).statistics for g in range(file.metadata.num_row_groups)]
    return all(s is not None and s.null_count == file.metadata.row_group(g).num_rows for g, s in enumerate(stats))


class ShardSource(DataSource):
    """Options: path; columns (comma-separated; by default all but the vectors); taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        named = self.options.get("columns")
        wanted = [c.strip() for c in named.split(",")] if named else [c for c in _TYPES if c not in VECTORS]
        return ", ".join(f"{c} {_SPARK[_TYPES[c]]}" for c in wanted)

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"].rstrip("/"), schema.names, int(self.options.get("taskbytes", 64 << 20)))


def read_shards(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Entries of all shards under a folder, blank identity columns filled from their sidecars; equality and ``in`` on these skip shards where ``spark.sql.python.filterPushdown.enabled`` is on."""
    spark.dataSource.register(ShardSource)
    return spark.read.format("shards").options(path=path, **({"columns": ",".join(columns)} if columns else {})).load()
