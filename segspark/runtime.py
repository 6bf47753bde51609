"""Session-level helpers: shared scratch tables, size checks, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_scratch: dict[str, str] = {}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail at analysis time when an operator misses input columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    return df


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: `spark.checkpoint.dir` of the session.

    Only a local master may go without it (tests); there a folder of this
    process is made once.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every node can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="segspark-")
    return _local_scratch[app]


_scopes: list[list[str]] = []


def new_scratch_path(spark: SparkSession, kind: str) -> str:
    path = f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope():
    """Removes, at its end, the tables that operators wrote inside.

    Results that still read them must be written or counted before that.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            store, place = fs.FileSystem.from_uri(path)
            if store.get_file_info(place).type == fs.FileType.Directory:
                store.delete_dir(place)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and freezes values (such as
    partition ids) that a recomputation could change.
    """
    path = new_scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_limit(spark: SparkSession) -> int:
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    digits = text.rstrip("bkmg")
    return int(digits) * units.get(text[len(digits):], 1)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a dimension only when its planned size is under the session limit."""
    return F.broadcast(df) if _fits_broadcast(df) else df


def _fits_broadcast(df: DataFrame) -> bool:
    """Planned size under the limit; a plan with a row generator has no usable estimate."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if "Generate " in plan.toString() or "EvalPython" in plan.toString():
        return False
    return 0 <= int(str(plan.stats().sizeInBytes())) <= broadcast_limit(df.sparkSession)


def join_side(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join a pixel-sized table with a table of one row per key.

    The side is copied once per salt and the big rows are spread over the
    salts, so a key that holds a third of `big` still goes to many tasks. A
    side under the broadcast limit is joined without any shuffle of `big`, and
    so is one dealt as `big` is.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    if salts & (salts - 1):
        raise ValueError("salts must be a power of two")
    if _fits_broadcast(side):
        return big.join(F.broadcast(side), on, how)
    return _carry(big, side, on, how, salts)


def _carry(big: DataFrame, side: DataFrame, on: list[str], how: str, salts: int) -> DataFrame:
    """The join as one sorted pass: a key's side rows come first and are carried over its big rows.

    Grouping by keys, unlike a join, is content with tables dealt by some of
    them, so rows of both that lie in the same tasks already are not shuffled.
    """
    rest = [c for c in side.columns if c not in on]
    known = side.select(*on, F.struct(F.lit(1).alias("__one"), *rest).alias("__row")).dropna(subset=on)
    lists = (known.groupBy(*on).agg(F.collect_list("__row").alias("__side"))
             .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    rows = big.withColumns({"__salt": salt(big, on, salts), "__big": F.struct(F.lit(1).alias("__one"), *[c for c in big.columns if c not in on])}).select(*on, "__salt", "__big")
    keys = [*on, "__salt"]
    ahead = Window.partitionBy(*keys).orderBy(F.col("__big").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(lists, allowMissingColumns=True)
    met = both.withColumn("__met", F.last("__side", ignorenulls=True).over(ahead)).filter("__big is not null")
    types = dict(big.dtypes)
    own = [F.col(c).cast(types[c]).alias(c) for c in on] + [F.col("__big")[c].alias(c) for c in big.columns if c not in on]
    if how in ("left_semi", "left_anti"):
        return met.filter(F.col("__met").isNotNull() if how == "left_semi" else F.col("__met").isNull()).select(*own)
    spread_out = (F.explode if how == "inner" else F.explode_outer)("__met")
    return met.select(*on, "__big", spread_out.alias("__row")).select(*own, *[F.col("__row")[c].alias(c) for c in rest])


def salt(df: DataFrame, on: list[str], salts: int) -> Column:
    """Hash of whole-number columns outside the key, as 0..salts-1 (a power of two).

    Cheap columns only: the expression may be planned more than once.
    """
    whole = [c for c, t in df.dtypes if c not in on and t in ("int", "bigint", "smallint", "tinyint")]
    rest = whole[:3] or [c for c in df.columns if c not in on][:3] or list(on)
    return F.xxhash64(*rest).bitwiseAND(F.lit(salts - 1).cast("bigint")).cast("int")


def join_pixels(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join two pixel-sized tables on a pixel key, `inner` or `left`.

    The rows of a pixel are brought together by a grouping, which sorts and
    spills like a join but shuffles nothing of tables dealt by image.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    whole = lambda df, name: F.struct(F.lit(1).alias("__one"), *[c for c in df.columns if c not in on]).alias(name)
    some = lambda df: df.dropna(subset=on)
    # Rows without a key meet no other; they are told apart so that they do not gather.
    apart = F.when(F.concat(*[F.col(c).cast("string") for c in on]).isNull(), F.xxhash64(*left.columns)).otherwise(F.lit(0))
    lefts = (left if how == "left" else some(left)).select(*on, (apart if how == "left" else F.lit(0)).cast("bigint").alias("__apart"), whole(left, "__l"))
    rights = some(right).select(*on, F.lit(0).cast("bigint").alias("__apart"), whole(right, "__r"))
    met = (lefts.unionByName(rights, allowMissingColumns=True).groupBy(*on, "__apart")
           .agg(F.collect_list("__l").alias("__l"), F.collect_list("__r").alias("__r")))
    pairs = met.withColumn("__l", F.explode("__l")).withColumn("__r", (F.explode if how == "inner" else F.explode_outer)("__r"))
    types = dict(left.dtypes)
    return pairs.select(*[F.col(c).cast(types[c]).alias(c) for c in on], *[F.col("__l")[c].alias(c) for c in left.columns if c not in on],
                        *[F.col("__r")[c].alias(c) for c in right.columns if c not in on])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a few wide splits enough tasks before a row generator multiplies them."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)


IMAGES_PER_TASK = 512


def by_image(images: DataFrame, *keys: str) -> DataFrame:
    """Deal a table of images over tasks by its keys, so many that the pixels of a task's images fit its memory.

    Rows that a generator makes of an image stay in its task: grouping or
    joining them by keys that begin with the image's needs no other shuffle.
    Tables dealt by this over the same number of rows meet in the same tasks.
    """
    tasks = max(images.sparkSession.sparkContext.defaultParallelism, -(-images.count() // IMAGES_PER_TASK))
    return images.repartition(tasks, *keys)
