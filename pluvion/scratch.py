"""Tables written to the shared folder of the cluster.

The folder is the one the session names in ``spark.checkpoint.dir``. Where that is unset one is made on this machine, for tests and laptops only: a session with
executors on other machines is refused, since those could not read it. Tables stay until ``cleared`` removes those of the session, or the folder goes.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="pluvion-")
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back; ``by``: columns that name folders.

    Cuts the lineage and gives the planner the true size, so that it broadcasts the table only below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it beyond.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.partitionBy(*(by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> int:
    """Removes the tables that this session wrote; to be called when their results are no longer read. Gives their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)
