"""Queries over streams of the given tables; each drains what is there into a scratch folder."""

from pyspark.sql import functions as F

from segspark.plans import fixtures as X
from segspark.plans.registry import query, table
from segspark.runtime import new_scratch_path
from segspark.streaming import streams as S

#: Files that a quarter of the events arrives in.
FILES = 8


def _collected(spark, stream, mode="append"):
    target = new_scratch_path(spark, "out")
    S.drain(stream, target, mode)
    return spark.read.schema(stream.schema).parquet(target)


def _latest(spark, stream, mode):
    """Result table of a complete- or update-mode query after its last micro-batch with rows."""
    target = new_scratch_path(spark, "out")
    S.drain(stream, mode=mode, each=lambda df, i: df.write.mode("overwrite").parquet(f"{target}/batch={i}"), checkpoint=f"{target}/_checkpoint")
    return S.latest_batch(spark, target)


def _threshold_model():
    def run(frame):
        bright = frame["data"].map(lambda v: sum(1 for x in v if x >= 128))
        return frame[["sample_id"]].assign(bright=bright)
    return run


@query("p01_frames", "SELECT vec_id AS sample_id, len(list_filter(embedding, lambda z: z::DOUBLE * 1000 >= 128))::BIGINT AS bright FROM embeddings")
def frames(spark, d):
    raw = S.read_table_stream(spark, d, "embeddings.parquet")
    f = raw.select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda v: v.cast("double") * 1000).alias("data"))
    return _collected(spark, S.score_frames(f, _threshold_model, "sample_id bigint, bright bigint"))


def _pixel_stream(spark, d):
    """The pixel table as a stream of parts; a projection of each row, so no state."""
    part = S.read_table_stream(spark, d, "part.parquet")
    axis = F.sequence(F.lit(0), F.lit(X.SIDE - 1))
    grid = part.select(F.col("p_partkey").alias("sample_id"), "p_size").withColumn("y", F.explode(axis)).withColumn("x", F.explode(axis))
    block = F.expr("(y div 4) + (x div 4) + p_size")
    gt = F.when((F.col("sample_id") * 7 + F.col("y") * 16 + F.col("x")) % 97 == 0, 255).otherwise(block % 6)
    pred = (F.when((F.col("sample_id") + F.col("y") * 5 + F.col("x") * 3) % 11 == 0, (block + 1) % 6)
            .when((F.col("sample_id") + F.col("x") + F.col("y")) % 89 == 0, 6).otherwise(block % 6))
    return grid.select("sample_id", "y", "x", gt.cast("int").alias("gt"), pred.cast("int").alias("pred"))


@query("p02_running_confusion", f"WITH {X.PIXELS} SELECT gt, pred, count(*) AS n FROM px WHERE gt <> 255 GROUP BY gt, pred")
def running_confusion(spark, d):
    return _latest(spark, S.running_pairs(_pixel_stream(spark, d)), "complete")


@query("p02_running_iou", f"""WITH {X.PIXELS}, ok AS (SELECT * FROM px WHERE gt <> 255) SELECT c::INT AS class_id,
  round((SELECT count(*) FROM ok WHERE gt = c AND pred = c)::DOUBLE / nullif((SELECT count(*) FROM ok WHERE gt = c OR pred = c), 0), 6) AS iou FROM range(6) k(c)""")
def running_iou(spark, d):
    target = new_scratch_path(spark, "iou")
    S.running_class_metrics(_pixel_stream(spark, d), X.CLASSES, target)
    return S.latest_batch(spark, target).select("class_id", F.round("iou", 6).alias("iou"))


def _events(spark, d):
    return S.read_table_stream(spark, d, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _in_batches(spark, d, repeats=False):
    """Events in order of time as a stream of four quarters, one a trigger, each of `FILES` files. With `repeats`, each
    quarter but the first also brings again, a minute later, events of the one before it."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = events.select(F.percentile(F.unix_micros("ts"), F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]))).first()[0]
    quarter = sum((F.when(F.unix_micros("ts") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    folder = new_scratch_path(spark, "arrivals")
    for k in range(4):
        part = events.filter(quarter == k)
        if repeats and k:
            part = part.unionByName(events.filter(quarter == k - 1).withColumn("ts", F.col("ts") + F.expr("interval 1 minute")))
        # Dealt in turn, so that every file has rows and a trigger takes exactly those of a quarter.
        part.repartition(FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


@query("p03_windows_append", """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak
FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def windows_append(spark, d):
    out = _collected(spark, S.windowed_throughput(_in_batches(spark, d), "1 hour", keys=["event_type"]))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"), "peak")


@query("p03_windows", """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak
FROM events GROUP BY 1, 2""")
def windows(spark, d):
    out = _latest(spark, S.windowed_throughput(_events(spark, d), "1 hour", keys=["event_type"]), "complete")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"), "peak")


@query("p03_sliding", """WITH s AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, value FROM events, range(4) t(k))
SELECT start, start + INTERVAL 24 HOUR AS stop, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY 1, 2""")
def sliding(spark, d):
    out = _latest(spark, S.windowed_throughput(_events(spark, d), "24 hours", "6 hours"), "complete")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select(ntz("start"), ntz("stop"), "n", F.round("mean", 6).alias("mean"))


SESSIONS = """g AS (SELECT user_id AS run, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(b) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)"""


@query("p04_sessions", f"WITH {SESSIONS} SELECT run, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS stop, count(*) AS n FROM i GROUP BY run, s")
def sessions(spark, d):
    ev = _events(spark, d).withColumnRenamed("user_id", "run")
    out = _latest(spark, S.run_sessions(ev, "12 hours"), "complete")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("run", ntz("start"), ntz("stop"), "n")


@query("p04_sessions_append", f"WITH {SESSIONS} SELECT run, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS stop, count(*) AS n FROM i GROUP BY run, s "
       "HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def sessions_append(spark, d):
    out = _collected(spark, S.run_sessions(_in_batches(spark, d).withColumnRenamed("user_id", "run"), "12 hours"))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("run", ntz("start"), ntz("stop"), "n")


@query("p05_step_carry", """SELECT user_id AS run, event_id AS line_no, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0 ELSE event_id // 5 END AS raw_step,
  coalesce(last_value(CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE nullif(event_id // 5, 0) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS step FROM events""")
def step_carry(spark, d):
    ev = _in_batches(spark, d)
    step = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("bigint")).when(F.col("event_id") % 11 == 0, F.lit(0).cast("bigint")).otherwise(F.expr("event_id div 5"))
    lines = ev.select(F.col("user_id").alias("run"), F.col("event_id").alias("line_no"), F.to_json(F.struct(step.alias("step"), "value")).alias("line"))
    target = new_scratch_path(spark, "steps")
    S.carry_steps(lines, target)
    return spark.read.parquet(f"{target}/rows").drop("batch")


@query("p06_distinct_arrivals", "SELECT event_id, user_id, event_type FROM events")
def arrivals(spark, d):
    """Each event once, though most arrive again in the next file."""
    first = S.distinct_arrivals(_in_batches(spark, d, repeats=True), ["event_id"])
    return _collected(spark, first.select("event_id", "user_id", "event_type"))


@query("p07_class_join", f"""WITH {X.PIXELS}, c AS (SELECT DISTINCT p_size % 6 AS class_id, 'class_' || (p_size % 6) AS class_name FROM part)
SELECT class_name, count(*) AS n FROM px LEFT JOIN c ON c.class_id = px.gt GROUP BY class_name""")
def class_join(spark, d):
    classes = table(spark, d, "part").select((F.col("p_size") % 6).cast("int").alias("class_id")).distinct()
    classes = classes.withColumn("class_name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    rows = _collected(spark, S.with_class_names(_pixel_stream(spark, d), classes).select("sample_id", "class_name"))
    return rows.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
