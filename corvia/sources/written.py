"""Written tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, else the one given to setCheckpointDir.

    Only on one machine (a local master, as in tests), and where both are unset, a temporary folder of this process;
    on a cluster without either it is an error, since executors would not see each other's files.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        given = sc._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("corvia.shared.dir", None)
        if not root:
            root = tempfile.mkdtemp(prefix="corvia-")
            spark.conf.set("corvia.shared.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs only the reader's own tasks,
    and a plan that uses the result several times computes it once. Shuffle files of the plan that wrote it go
    when it is over: nothing reads them again.
    """
    path = f"{shared_dir(df.sparkSession)}/corvia/{tag}-{uuid.uuid4().hex}"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "snappy").parquet(path)
    finally:
        if before is None:
            conf.unset(CLEAN_UP)
        else:
            conf.set(CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete tables of materialise() that nothing will read again: what was made from them is written too."""
    for df in written:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getParent().getName() == "corvia":
                folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
