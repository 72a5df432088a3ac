"""What the operators of this package share: durable tables, salted prefix sums, words.

Words are maximal runs of anything but space and the control characters
\\x09-\\x0D, everywhere in this package.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java's spelling of one word.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = found.get() if found.isDefined() else None
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='lodestat-')}"
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """For writes: Python workers get so many rows at a time, as whole texts are long and a worker holds a batch and its
    results at once; and shuffled rows are gathered to the advisory size, so that small tables have few files."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def durable(df: DataFrame, label: str = "t", batch: int = 1_000) -> DataFrame:
    """Write df once to the shared folder and return a scan of it: lineage is cut and a lost executor costs nothing. batch: rows that a Python worker gets at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestat/{label}-{uuid.uuid4().hex}"
    with small_batches(spark, batch):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, rows: int, per_file: int = 250_000) -> DataFrame:
    """df in as many partitions as its known number of rows needs, so that small tables don't become many files."""
    return df.coalesce(max(1, -(-rows // per_file)))


def drop_tables(paths: list[str], spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            drop_tables([path], spark)


def ranked(df: DataFrame, keys: list[str], order: list[str], salt_on: list[str], amount: str | None = None, few_keys: bool = False, add: dict | None = None) -> DataFrame:
    """Add __rank (from 0) inside each group of keys and, with amount, __before: the sum of amount over smaller ranks.

    A group's rows are dealt into about sqrt(rows) hash buckets of about
    sqrt(rows) rows, so that no task holds a whole group: a hot group of n
    rows needs tasks of sqrt(n) rows, and its buckets' totals are a second
    small prefix sum. Ranks follow (bucket, order); they depend on the data
    alone. df is read twice and should be durable. few_keys: the number of
    groups has a bound, so their sizes may be broadcast. add: columns for order.
    """
    df = df.withColumns(add) if add else df
    sizes = df.groupBy(*keys).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("__buckets"))
    same = None
    renamed = sizes
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__k_{k}")
        term = df[k].eqNullSafe(renamed[f"__k_{k}"])
        same = term if same is None else same & term
    dealt = df.join(F.broadcast(renamed) if few_keys else renamed, same).drop(*[f"__k_{k}" for k in keys])
    dealt = dealt.withColumn("__bucket", F.pmod(F.xxhash64(*salt_on), F.col("__buckets")))
    total = F.sum(amount) if amount else F.lit(0).cast("long")
    sums = dealt.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"), (total if amount else F.max(total)).alias("__a"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__a").over(earlier), F.lit(0)).alias("__a0"),
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    own = dealt.withColumn("__rank", F.row_number().over(inside) - 1)
    if amount:
        own = own.withColumn("__before", F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = own["__bucket"] == sums["__b"]
    for k in keys:
        same = same & own[k].eqNullSafe(sums[f"__k_{k}"])
    out = own.join(sums, same).withColumn("__rank", F.col("__rank") + F.col("__n0"))
    if amount:
        out = out.withColumn("__before", F.col("__before") + F.col("__a0"))
    return out.drop("__buckets", "__bucket", "__b", "__n0", "__a0", *[f"__k_{k}" for k in keys])


def known_places(docs: DataFrame) -> DataFrame:
    """docs with __file and __row, which tell equal rows apart; docs that is no table in files, and hasn't them, is written first."""
    if {"__file", "__row"} <= {*docs.columns}:
        return docs
    place = {"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")}
    try:
        return docs.withColumns(place)
    except AnalysisException:
        return durable(docs, "docs").withColumns(place)


#: A key with more than this share of a join's rows, and more rows than the second, is split.
HOT_SHARE, HOT_ROWS = 1e-4, 2_000


def split_join(left: DataFrame, rows: int, right: DataFrame, keys: list[str], salt: list[str]) -> DataFrame:
    """left joined with right, which has one row for each of keys, without a hot key's rows in one task.

    left has so many rows and should be durable. Keys of many rows, fewer than
    1 / HOT_SHARE of them and so broadcast, are dealt by a hash of salt, and
    their rows of right are repeated for each share.
    """
    limit = max(HOT_ROWS, int(rows * HOT_SHARE))
    if rows <= limit:
        return left.join(right, keys)
    hot = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / limit).cast("long").alias("__shares")).where("__shares > 1")
    hot = durable(hot.coalesce(1), "hot")
    if hot.isEmpty():
        return left.join(right, keys)
    shares = F.coalesce("__shares", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__share", F.pmod(F.xxhash64(*salt), shares)).drop("__shares")
    again = right.join(F.broadcast(hot), keys, "left").withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("__shares")
    return dealt.join(again, [*keys, "__share"]).drop("__share")


def folded(docs: DataFrame, *names: str) -> DataFrame:
    """docs as one column __doc, beside the columns named: whatever else docs has can't clash with an operator's own names."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"), *[docs[c] for c in names])


def labelled(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most bound rows (doc_id, __y) of labels, the same ones for the same table; conflicting or null labels go, and rows whose crc32(doc_id as text) mod 5 is 0."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("__y")).where("doc_id is not null and __y in (0, 1)")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = rows.groupBy("doc_id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").drop("__z")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def learned_from(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text and the other columns of chosen (bounded, one row per doc_id): as many rows as chosen has at most, the least text of an id with several."""
    names = [c for c in chosen.columns if c != "doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", *names).agg(F.min("text").alias("text"))
