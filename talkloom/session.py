"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "talkloom", **settings: str) -> SparkSession:
    """A session with the settings the library is tested with.

    Sizing (executors, shuffle partitions, split size) is left to spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors reach.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="talkloom-"))
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, object]) -> Iterator[None]:
    """Have these session settings inside, and those of before afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: The folder that :func:`scratch` has opened.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """Have all tables materialised inside written below one folder of their own, whose path this gives.

    :func:`drop_folder` removes it, once what was built from them has been written.
    """
    folder = f"{shared_folder(spark)}/talkloom/{uuid.uuid4().hex}-{name}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, which reaches whatever store it is in; none there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet below the shared folder."""
    return f"{_scratch.get() or shared_folder(spark) + '/talkloom'}/{uuid.uuid4().hex}/{name}"


#: While set, the shuffle files of a job go when it has ended, not when the driver happens to collect its garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, and stays
    columnar, so later passes read only the columns they use.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_all(
    spark: SparkSession, parts: Iterable[Callable[[], DataFrame]], schema: StructType, name: str, at_once: int = 4
) -> DataFrame:
    """Write several tables of one schema, ``at_once`` at a time, and read them as one; none of them make an empty one.

    Each part is a function that plans its table: while some are planned on the driver, others are written.
    """
    path = new_folder(spark, name)
    spark.createDataFrame([], schema).write.parquet(f"{path}/none")

    def write(number: int, part: Callable[[], DataFrame]) -> None:
        # A folder each, as one job's commit clears away what others have begun in its folder.
        part().write.parquet(f"{path}/{number}")
        # The driver's JVM keeps a plan, and the files it has listed, until Python's frame is collected.
        gc.collect()

    with ThreadPoolExecutor(at_once) as pool:
        begun: set[Future] = set()
        for number, part in enumerate(parts):
            if len(begun) == at_once:
                done, begun = wait(begun, return_when=FIRST_COMPLETED)
                for job in done:
                    job.result()
            begun.add(pool.submit(write, number, part))
        for job in begun:
            job.result()
    return spark.read.schema(schema).parquet(f"{path}/*")
