"""Shared plumbing: the cluster's shared folder, written intermediate tables, column-name hygiene."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the word pattern [^\x20\x09-\x0D]+ sees it.
SPACES = " \t\n\x0b\x0c\r"
_made: list[tuple[SparkSession, str]] = []
_own: dict = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: 64-bit words of a table of marks, at most: its size bounds what is sent to every task.
MOST_WORDS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext not in _own:
            _own[spark.sparkContext] = "file://" + tempfile.mkdtemp(prefix="manyfold-")
            track(spark, _own[spark.sparkContext])
        path = _own[spark.sparkContext]
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, with its path: lineage ends there and lost executors cost nothing.
    The write's own shuffle files go when it is done."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    track(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def perhaps(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose column key may stand in ids (one column), and few others; no row of df is moved. ids mark
    bits of a table of at most MOST_WORDS words, 16 bits or more for an id while there are under four million of them.
    With more ids more others pass, so an exact join has to follow."""
    words = MOST_WORDS >> max(0, MOST_WORDS.bit_length() - 1 - max(10, (ids.count() // 4).bit_length()))
    word, bit, hashed = unused(df, "word"), unused(df, "bit"), unused(df, "hashed")
    at = lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(words - 1))
    mask = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` & 63 as int))")
    marks = ids.select(F.xxhash64(ids.columns[0]).alias(hashed)).select(at(F.col(hashed)).alias(word), mask(hashed).alias(bit))
    marks, _ = written(marks.groupBy(word).agg(F.bit_or(bit).alias(bit)), "marks")
    rows = df.withColumn(hashed, F.xxhash64(key)).withColumn(word, at(F.col(hashed)))
    return rows.join(F.broadcast(marks), word).where(F.col(bit).bitwiseAND(mask(hashed)) != 0).select(*df.columns)


def track(spark: SparkSession, path: str) -> None:
    """Remove path when the session ends."""
    _made.append((spark, path))


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already; nothing is left to clean with
            return


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in have:
        k += 1
        name = f"{stem}_{k}"
    return name


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls in fold 0; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """schema with the fields of ddl after its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
