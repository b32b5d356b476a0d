"""Source presets, gold labels and template defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import strip

PRESET_SCHEMA = (
    "id string, name string, source_url string, selector_list string, selector_title string, "
    "selector_link string, selector_summary string, description string, default_keywords array<string>, "
    "recommended_cron string, category string, subcategory string, content_kind string"
)
# What a preset must hold.
PRESET_REQUIRED = ("id", "name", "source_url", "selector_list", "selector_title", "selector_link")


def complete_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows that hold every required field."""
    return df.dropna(subset=list(required))


def read_presets(spark: SparkSession, path: str, required: Sequence[str] = PRESET_REQUIRED) -> DataFrame:
    """A JSON array of presets; incomplete ones are skipped."""
    return complete_rows(spark.read.schema(PRESET_SCHEMA).json(path, multiLine=True), required)


def gold_labels(lines: DataFrame, column: str = "value") -> DataFrame:
    """Gold lines `{"item_id": …, "relevant": …}` → item_id, relevant. Blank lines are ignored.

    A line without item_id fails the job when it is read.
    """
    row = F.from_json(F.col(column), "item_id string, relevant string")
    parsed = lines.filter(strip(F.col(column)) != "").select(row.alias("g"))
    return parsed.select(
        F.when(F.col("g.item_id").isNull(), F.raise_error(F.lit("gold line without item_id")).cast("string"))
        .otherwise(F.col("g.item_id")).alias("item_id"),
        F.lower(F.coalesce(F.col("g.relevant"), F.lit("false"))).isin("1", "true").alias("relevant"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return gold_labels(spark.read.text(path))


def apply_templates(tasks: DataFrame, templates: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fill a task's blank fields from its template; the task's own value wins.

    The template values used are kept as a snapshot column.
    """
    source = templates.select(
        "template_id", F.struct(*fields).alias("template_snapshot"))
    joined = tasks.join(source, "template_id", "left")
    filled = {
        f: F.coalesce(F.when(strip(F.col(f)) != "", F.col(f)), F.col(f"template_snapshot.{f}")) for f in fields
    }
    return joined.withColumns(filled)
