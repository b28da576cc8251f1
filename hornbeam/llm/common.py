"""Pieces that several corpus operators share: table access, reliable checkpoints, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, for UTF-8 bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


#: Bytes of texts that a Python worker treats together, about; a longer text is alone.
GROUP_BYTES = 4 << 20


def groups(texts: list, most: int, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` (bytes, strings or None) of at most ``most`` of them and about ``size`` in all."""
    begin = held = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > begin and (k - begin >= most or held + n > size):
            yield begin, k
            begin, held = k, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder of ``spark.checkpoint.dir``. Where it is unset a local master gets a temporary one; a cluster is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="hornbeam-"))
    return sc.getCheckpointDir()


def free(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to be none of ``taken`` (case aside)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


@contextmanager
def _exchanges_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside has its exchanges' files removed when it ends, instead of whenever the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read from there: columns that a reader doesn't need stay on disk."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _exchanges_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(table: DataFrame) -> None:
    """Removes the files of what ``stored`` gave; neither it nor what is made of it can be read after that."""
    sc = table.sparkSession.sparkContext
    for file in table.inputFiles()[:1]:
        folder = sc._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    with _exchanges_freed(df.sparkSession):  # a frame takes the setting when it is made
        return df.select("*").checkpoint(eager=True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that is reachable.

    Alternating large-star and small-star steps until only stars are left. Each step is two partial aggregations
    and two equi-joins, so a hub is pre-aggregated and its join partition can be split; nothing but two counts
    comes to the driver. No edges give no rows; loops count as nodes without links and give none either.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    star = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not star.isEmpty():
        both = star.union(star.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter(v > u).select(v.alias("u"), m.alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = settle(large.join(low, "u").filter(v != m).select(v.alias("u"), m.alias("v")).union(low.select("u", m.alias("v"))).distinct())
        parents = star.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if parents.filter("n > 1").isEmpty() and star.select("v").join(parents, v == u, "left_semi").isEmpty():
            break
    return star.select(u.alias("node"), v.alias("root")).union(star.select(v.alias("node"), v.alias("root")).distinct())
