"""Queries for logs, throughput and the model zoo."""

from pyspark.sql import functions as F

from segspark.operators import logs as N
from segspark.plans import fixtures as X
from segspark.plans.registry import query, table

FILL = X.LOG_LINES + """, fs AS (SELECT *, coalesce(last_value(nullif(step, 0) IGNORE NULLS) OVER (PARTITION BY run ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS st FROM lg)"""


def _filled(spark, d):
    return N.fill_steps(N.parse_lines(X.log_lines(spark, d)))


@query("n01_step_fill", f"WITH {FILL} SELECT run, line_no, step AS raw_step, st AS step FROM fs")
def step_fill(spark, d):
    return _filled(spark, d).select("run", "line_no", "raw_step", "step")


SERIES = FILL + """, se AS (SELECT run, 'loss' AS metric, st AS step, line_no, value FROM fs
  UNION ALL SELECT run, 'mIoU', st, min(line_no), arg_min(k, line_no) FROM fs WHERE k IS NOT NULL GROUP BY run, st)"""


@query("n02_series", f"WITH {SERIES} SELECT run, metric, step, line_no, value FROM se")
def series(spark, d):
    return N.metric_series(_filled(spark, d))


@query("n03_matrix", f"WITH {SERIES} SELECT run, arg_max(value, line_no) FILTER (WHERE metric = 'loss') AS loss, arg_max(value, line_no) FILTER (WHERE metric = 'mIoU') AS \"mIoU\" FROM se GROUP BY run")
def matrix(spark, d):
    return N.metric_matrix(N.metric_series(_filled(spark, d)), ["loss", "mIoU"])


@query("n03_legends", """SELECT DISTINCT user_id AS run, m AS metric, user_id || '_' || m AS legend FROM events, (SELECT unnest(['loss', 'mIoU']) AS m) t""")
def legends(spark, d):
    return N.legends(X.log_lines(spark, d), ["loss", "mIoU"])


FPS = """tm AS (SELECT user_id AS run, event_id, 0.01::DOUBLE + value / 1000 AS e, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
cu AS (SELECT run, i AS images, sum(CASE WHEN i > 5 THEN e ELSE 0 END) OVER (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING) AS t, count(*) OVER (PARTITION BY run) AS n FROM tm),
fp AS (SELECT run, images, (images - 5) / nullif(t, 0) AS fps, images = n AS overall FROM cu WHERE images > 5 AND (images % 10 = 0 OR images = n))"""


def _fps(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("run"), "event_id", (0.01 + F.col("value") / 1000).alias("elapsed"))
    return N.running_fps(ev, [F.col("event_id")], every=10)


@query("n04_throughput", f"WITH {FPS} SELECT run, images, round(fps, 4) AS fps, overall FROM fp")
def throughput(spark, d):
    return _fps(spark, d).withColumn("fps", F.round("fps", 4))


@query("n05_fps_summary", f"WITH {FPS} SELECT round_even(avg(fps), 2) AS average_fps, round_even(var_pop(fps), 4) AS fps_variance FROM fp WHERE overall")
def fps_summary(spark, d):
    return N.fps_summary(_fps(spark, d).filter("overall"))


README = """rd AS (SELECT doc_id, '# ' || source || ' ' || (doc_id % 50) AS t, ['ALGORITHM', 'BACKBONE', 'OTHERS'][doc_id % 3 + 1] AS k, doc_id % 4 AS n FROM documents)"""


def _readmes(spark, d):
    kind = F.get(F.array(F.lit("ALGORITHM"), F.lit("BACKBONE"), F.lit("OTHERS")), (F.col("doc_id") % 3).cast("int"))
    links = F.concat_ws("\n", F.transform(F.slice(F.sequence(F.lit(1), F.lit(4)), 1, (F.col("doc_id") % 4).cast("int")), lambda i: F.concat(
        F.lit("| [model](https://download.example.org/zoo/"), F.floor(i / 2).cast("string"), F.lit(".pth) |"))))
    content = F.concat(F.lit("# "), "source", F.lit(" "), F.col("doc_id") % 50, F.lit("\n\n<!-- ["), kind, F.lit("] -->\n"), links, F.lit("\n"), "text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("path"), content.alias("content"))


@query("n06_papers", f"""WITH {README} SELECT doc_id AS path, substr(t, 3) AS title, k AS paper_type, CASE n WHEN 1 THEN 1 ELSE 2 END::INT AS ckpts FROM rd WHERE n > 0""")
def papers(spark, d):
    return N.paper_records(_readmes(spark, d), "zoo")


@query("n06_zoo_statistics", f"""WITH {README}, p AS (SELECT substr(t, 3) AS title, k AS paper_type, CASE n WHEN 1 THEN 1 ELSE 2 END AS ckpts FROM rd WHERE n > 0)
SELECT paper_type, count(DISTINCT title) AS papers, sum(ckpts)::BIGINT AS checkpoints FROM p GROUP BY GROUPING SETS ((paper_type), ())""")
def zoo_statistics(spark, d):
    return N.zoo_statistics(N.paper_records(_readmes(spark, d), "zoo"))


@query("n07_leaderboard", """WITH z AS (SELECT p_brand AS dataset, p_partkey AS name, floor(p_retailprice) % 97 AS miou, p_size AS memory FROM part)
SELECT dataset, name, miou, memory, row_number() OVER (PARTITION BY dataset ORDER BY miou DESC, memory, name)::INT AS rank FROM z
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY miou DESC, memory, name) <= 3""")
def leaderboard(spark, d):
    zoo = table(spark, d, "part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("name"),
                                         (F.floor("p_retailprice") % 97).cast("double").alias("miou"), F.col("p_size").alias("memory"))
    return N.leaderboard(zoo, 3)


@query("n08_preview", """SELECT l_orderkey AS step, l_linenumber AS batch, min(l_partkey) AS pos FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY 1, 2""")
def preview(spark, d):
    out = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("batch"), F.col("l_partkey").alias("pos"))
    return N.preview(out, 50)
