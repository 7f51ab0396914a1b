"""Content-addressed blobs: a Parquet table of distinct contents by SHA-256 and one of references to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "mp4": "video/mp4", "webm": "video/webm",
    "mp3": "audio/mpeg", "wav": "audio/wav", "pdf": "application/pdf", "json": "application/json", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "csv": "text/csv",
}


def media_type(path: Column) -> Column:
    """By extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv]), ext), F.lit("application/octet-stream"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, length and media type of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", "length", media_type(F.col("path")).alias("media_type"))


class BlobStore:
    """contents (id, content, size) holds each content once; refs (name, id, media_type) says who needs it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.contents_path, self.refs_path = spark, f"{path}/contents", f"{path}/refs"

    def _read(self, path: str, ddl: str) -> DataFrame:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return self.spark.read.schema(ddl).parquet(path) if there else self.spark.createDataFrame([], ddl)

    def contents(self) -> DataFrame:
        return self._read(self.contents_path, "id string, content binary, size long")

    def refs(self) -> DataFrame:
        return self._read(self.refs_path, "name string, id string, media_type string")

    def put(self, blobs: DataFrame) -> None:
        """name and content; contents that are there already aren't written again."""
        named = blobs.select("name", "content", F.sha2("content", 256).alias("id"), media_type(F.col("name")).alias("media_type"))
        new = named.select("id", "content", F.length("content").cast("long").alias("size")).join(self.contents().select("id"), "id", "left_anti").dropDuplicates(["id"])
        new.write.mode("append").parquet(self.contents_path)
        named.select("name", "id", "media_type").write.mode("append").parquet(self.refs_path)

    def get(self, name: str) -> bytes | None:
        row = self.contents().join(self.refs().where(F.col("name") == name), "id", "left_semi").select("content").first()
        return bytes(row[0]) if row else None

    def get_range(self, name: str, offset: int, size: int) -> bytes | None:
        row = self.contents().join(self.refs().where(F.col("name") == name), "id", "left_semi").select(F.substring("content", offset + 1, size)).first()
        return bytes(row[0]) if row else None

    def counts(self) -> DataFrame:
        """id and the number of references."""
        return self.contents().select("id").join(self.refs().groupBy("id").agg(F.count(F.lit(1)).alias("refs")), "id", "left").select("id", F.coalesce("refs", F.lit(0)).alias("refs"))

    def forget(self, name: str) -> None:
        self._rewrite(self.refs().where(F.col("name") != name), self.refs_path)

    def collect_garbage(self) -> int:
        """Contents without references go; how many."""
        dead = self.counts().where("refs = 0").count()
        if dead:
            self._rewrite(self.contents().join(self.refs().select("id"), "id", "left_semi"), self.contents_path)
        return dead

    def _rewrite(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path + ".new")
        self.spark.read.schema(df.schema).parquet(path + ".new").write.mode("overwrite").parquet(path)
