"""Training logs, throughput and model-zoo tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.functions.prefix import carry_forward, running_totals, top_k_per_group
from segspark.runtime import join_side

# Metrics that are written once per validation.
VALIDATION = ("mIoU", "mAcc", "aAcc")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(run, line_no, raw_step, fields map<string,string>) of JSON lines (run, line_no, line)."""
    fields = F.from_json("line", "map<string,string>")
    return lines.select("run", "line_no", fields.alias("fields")).select(
        "run", "line_no", F.try_element_at("fields", F.lit("step")).cast("bigint").alias("raw_step"), "fields")


def fill_steps(parsed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add step: a missing or zero step takes the last one before it in the same run (0 at the start)."""
    base = parsed.withColumn("step", F.when(F.col("raw_step") != 0, F.col("raw_step")))
    return carry_forward(base, ["line_no"], "step", ["run"], partitions).withColumn("step", F.coalesce("step", F.lit(0).cast("bigint")))


def metric_series(filled: DataFrame, validation: tuple[str, ...] = VALIDATION) -> DataFrame:
    """(run, metric, step, line_no, value): the first value per step for validation metrics, every record
    for the others."""
    cells = (filled.select("run", "line_no", "step", F.explode("fields").alias("metric", "text"))
             .filter("metric != 'step'").select("run", "metric", "step", "line_no", F.expr("try_cast(text as double)").alias("value"))
             .filter("value is not null"))
    once = (cells.filter(F.col("metric").isin(*validation)).groupBy("run", "metric", "step")
            .agg(F.min_by(F.struct("line_no", "value"), "line_no").alias("r")).select("run", "metric", "step", "r.*"))
    return cells.filter(~F.col("metric").isin(*validation)).unionByName(once)


def legends(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """(run, metric, legend): every run with every metric."""
    return (runs.select("run").distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
            .withColumn("legend", F.concat_ws("_", F.col("run").cast("string"), "metric")))


def metric_matrix(series: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run, the last value of each metric in a column of its name."""
    return series.groupBy("run").pivot("metric", metrics).agg(F.max_by("value", "line_no"))


def running_fps(timings: DataFrame, order: list[Column], warmup: int = 5, every: int = 50) -> DataFrame:
    """(run, images, fps, overall): timings(run, elapsed) after `warmup` rows of each run; a row every
    `every` images and one for the whole run."""
    sums = running_totals(timings, order, {"images": F.lit(1).cast("bigint"), "total": F.col("elapsed")}, ["run"])
    marks = sums.groupBy("run").agg(F.max(F.when(F.col("images") == warmup, F.col("total"))).alias("warm"), F.max("images").alias("n"))
    rows = join_side(sums.select("run", "images", "total"), marks, ["run"]).filter(F.col("images") > warmup)
    rows = rows.filter((F.col("images") % every == 0) | (F.col("images") == F.col("n")))
    fps = F.try_divide((F.col("images") - warmup).cast("double"), F.col("total") - F.coalesce("warm", F.lit(0.0)))
    return rows.select("run", "images", fps.alias("fps"), (F.col("images") == F.col("n")).alias("overall"))


def fps_summary(overall: DataFrame) -> DataFrame:
    """Mean (2 decimals) and population variance (4 decimals) over repeats."""
    return overall.agg(F.bround(F.avg("fps"), 2).alias("average_fps"), F.bround(F.var_pop("fps"), 4).alias("fps_variance"))


def paper_records(readmes: DataFrame, must_contain: str = "") -> DataFrame:
    """(path, title, paper_type, ckpts) of readme texts (path, content) that list checkpoints."""
    title = F.trim(F.replace(F.split("content", "\n")[0], F.lit("#"), F.lit("")))
    urls = F.array_distinct(F.transform(F.filter(F.regexp_extract_all("content", F.lit(r"https?://download.*\.pth"), F.lit(0)),
                                                 lambda u: F.contains(u, F.lit(must_contain))), lambda u: F.trim(F.lower(u))))
    kind = F.regexp_extract("content", r"<!--\s*\[([A-Z]*?)\]\s*-->", 1)
    return (readmes.select("path", title.alias("title"), kind.alias("paper_type"), F.size(urls).alias("ckpts")).filter("ckpts > 0"))


def zoo_statistics(records: DataFrame) -> DataFrame:
    """(paper_type, papers, checkpoints) per type, plus a row with NULL type for the totals."""
    per_type = records.groupBy("paper_type").agg(F.count_distinct("title").alias("papers"), F.sum("ckpts").alias("checkpoints"))
    total = records.agg(F.count_distinct("title").alias("papers"), F.sum("ckpts").alias("checkpoints"))
    return per_type.unionByName(total.withColumn("paper_type", F.lit(None).cast("string")))


def leaderboard(zoo: DataFrame, k: int = 1) -> DataFrame:
    """Best k models per dataset by miou, then lower memory, then name: (…, rank)."""
    return top_k_per_group(zoo, ["dataset"], [F.col("miou").desc(), F.col("memory"), F.col("name")], k)


def preview(outputs: DataFrame, interval: int) -> DataFrame:
    """First sample of each batch whose step is a multiple of `interval`: outputs(step, batch, pos, …)."""
    rest = [c for c in outputs.columns if c not in ("step", "batch", "pos")]
    hit = outputs.filter(F.pmod(F.col("step"), F.lit(interval)) == 0)
    return (hit.groupBy("step", "batch").agg(F.min_by(F.struct("pos", *rest), F.struct("pos", *rest)).alias("r"))
            .select("step", "batch", "r.*"))
