"""Column helpers and shared-folder handling used by every operator here."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A term is a run of ASCII digits, lower-case ASCII letters and non-ASCII characters.
TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The same before A-Z are lower-cased.  A positive class: Java's matcher takes a third of the time of a negated one.
RAW_TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z only, so that every engine agrees; pure ASCII takes the fast way."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _UPPER.lower()))


def words(col: Column, pattern: str = WORD) -> Column:
    """All words of a whole text; none for NULL."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Inside higher-order functions Spark evaluates a captured expression for each
    element; a bound variable costs a field access.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def md5_uniform(*cols: Column) -> Column:
    """A number in [0, 1) from the md5 of the '|'-joined values (NULL: 'null').

    32 bits; SQL engines without xxhash64 give the same number.
    """
    key = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder
    is made and set; on a cluster executors couldn't reach it, so that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
            base = sc.getCheckpointDir()
    return base.rstrip("/")


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` with ``text`` at one stroke; False if it exists, whoever made it.

    The text is written beside it first.  A local file is then linked, which fails if the
    name is taken; elsewhere the store's own rename without overwriting decides (atomic
    on HDFS; a store without an atomic rename can't hold manifests for several writers).
    """
    jvm = spark.sparkContext._jvm
    folder, _, name = path.rpartition("/")
    fs, target = hadoop_fs(spark, path)
    _, draft = hadoop_fs(spark, f"{folder}/_draft-{name}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, target, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        fs.delete(draft, False)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers n of the files v<n>.json in a folder, in order."""
    fs, p = hadoop_fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)

    atexit.register(drop)
    return path


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage by files that outlive any executor, and lets later steps read
    only the columns they need.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    delete(df.sparkSession, df.stored_at)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def light(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``most`` bytes as JSON, 64 more for each; else as it is, to be shuffled."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def numbered(docs: DataFrame) -> DataFrame:
    """Adds uid, a unique long that orders rows as doc_id does; columns doc_id, text, uid.

    Where ids are unique and set, uid is the doc_id.  Else uid numbers the distinct pairs
    of id and text's md5 in order, NULL ids first: rows equal in both share a uid and are
    one document, reported once per row.  The numbers come from a range sort, so any
    number of rows may have one id or none; nothing is computed from an id.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    per_id = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    row = per_id.agg(F.max("n").alias("n"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    if (row.n or 0) <= 1 and not row.nulls:
        return d.withColumn("uid", F.col("doc_id"))
    keyed = d.select("doc_id", "text", F.md5("text").alias("h"))
    order = keyed.select("doc_id", "h").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "h")
    # stored, since a range sort that is run again may number otherwise
    order = stored(order.select(F.col("doc_id").alias("_i"), F.col("h").alias("_h"), F.monotonically_increasing_id().alias("uid")), "uids")
    return keyed.join(order, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))).select("doc_id", "text", "uid")


def shuffle_cleanup(spark: SparkSession) -> None:
    """Let Spark delete a finished query's shuffle files at once, where it can."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
