"""The node table and the table of model calls: reads, upserts, look-ups and keys."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("level", T.IntegerType()), T.StructField("filename", T.StringType()), T.StructField("page_number", T.IntegerType()),
    T.StructField("section_name", T.StringType()), T.StructField("language", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("child_ids", T.ArrayType(T.StringType())),
])
CALL = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "kind", "provider", "model", "payload")])


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``new`` rows, and the ``old`` ones whose key isn't among them; of rows that share a key in ``new`` one stays."""
    fresh = new.dropDuplicates([key])
    return fresh.unionByName(old.join(fresh.select(key), key, "left_anti"))


def by_ids(rows: DataFrame, wanted: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the ids asked for (pos, key), with their positions; ids that don't exist go."""
    return wanted.select("pos", key).join(rows, key)


def checked(nodes: DataFrame, dim: int) -> DataFrame:
    """Nodes; a vector of another length raises when the table is read."""
    fits = F.coalesce(F.size("embedding") == dim, F.lit(True))
    return nodes.withColumn("embedding", F.when(F.assert_true(fits, F.lit(f"a vector's length is not {dim}")).isNull(), F.col("embedding")))


class NodeTable:
    """Nodes in Parquet: every write makes a new version beside the old one, and a pointer file names the last whole one."""

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None) -> None:
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim

    def _pointer(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        at, fs = self._pointer()
        return self.spark.read.text(at.toString()).first()[0] if fs.exists(at) else None

    def read(self) -> DataFrame:
        name = self._current()
        rows = self.spark.createDataFrame([], NODE) if name is None else self.spark.read.schema(NODE).parquet(f"{self.path}/{name}")
        return rows

    def upsert(self, rows: DataFrame) -> None:
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE])
        rows = checked(rows, self.dim) if self.dim else rows
        name = f"v-{uuid.uuid4().hex}"
        upserted(self.read(), rows).write.parquet(f"{self.path}/{name}")
        at, fs = self._pointer()
        stream = fs.create(at, True)
        stream.write(bytearray(name.encode()))
        stream.close()

    def leaves(self) -> DataFrame:
        return self.read().where("level = 0").orderBy("document_id", "chunk_index")

    def count(self) -> int:
        return self.read().count()


def canonical(values: dict) -> str:
    return json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def call_key(kind: str, provider: str, model: str, payload: Column, params: dict | None = None, version: int = 1) -> Column:
    """SHA-256 of a call's canonical JSON, keys sorted, the payload a text column."""
    head = canonical({"kind": kind, "model": model, "params": params or {}})[:-1]
    quoted = F.get_json_object(F.to_json(F.struct(payload.alias("p"))), "$")
    value = F.regexp_extract(quoted, r'(?s)^\{"p":(.*)\}$', 1)
    tail = canonical({"provider": provider, "version": version})[1:]
    return F.sha2(F.concat(F.lit(head + ',"payload":'), value, F.lit("," + tail)).cast("binary"), 256)


def python_call_key(kind: str, provider: str, model: str, payload: object, params: dict | None = None, version: int = 1) -> str:
    return hashlib.sha256(canonical({"kind": kind, "provider": provider, "model": model, "payload": payload, "params": params or {}, "version": version}).encode()).hexdigest()


def cached_calls(wanted: DataFrame, calls: DataFrame, answer, mode: str = "read_write") -> tuple[DataFrame, DataFrame]:
    """(answers with payload, new rows of calls) for rows that have key and text, by a table of earlier calls.

    ``answer(text)`` is the model's column function. read_write asks for misses, read_only raises on them when read, refresh
    asks for all, off asks for all and keeps nothing.
    """
    known = calls.select("key", F.col("payload").alias("__p"))
    if mode == "read_only":
        joined = wanted.join(known, "key", "left")
        held = F.when(F.assert_true(F.col("__p").isNotNull(), F.lit("a call is not in the table")).isNull(), F.col("__p"))
        return joined.withColumn("payload", held).drop("__p"), calls.where("false")
    if mode in ("refresh", "off"):
        out = wanted.withColumn("payload", answer(F.col("text")))
        return out, (out.select("key", "payload").dropDuplicates(["key"]) if mode == "refresh" else out.select("key", "payload").where("false"))
    if mode != "read_write":
        raise ValueError(f"unknown mode {mode!r}")
    missing = wanted.join(known, "key", "left_anti").dropDuplicates(["key"]).withColumn("payload", answer(F.col("text"))).select("key", "payload")
    every = known.withColumnRenamed("__p", "payload").unionByName(missing)
    return wanted.join(every, "key", "left"), missing
