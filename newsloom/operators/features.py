"""The item feature row: everything matching and scoring read, computed once per item."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import labels
from newsloom.functions.entities import extract_entities
from newsloom.functions.text import tokenize


def item_features(items: DataFrame, match: str = "substring",
                  dictionaries: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Add a `features` struct: title_tokens, entities, language, content_type, fingerprint.

    `dictionaries` replaces the known names of one or more entity types.
    """
    title, summary = F.col("title"), F.coalesce(F.col("summary"), F.lit(""))
    return items.withColumn(
        "features",
        F.struct(
            tokenize(title).alias("title_tokens"),
            extract_entities(title, summary, match, dictionaries).alias("entities"),
            labels.language(F.concat_ws(" ", title, summary)).alias("language"),
            labels.content_type(title, summary).alias("content_type"),
            labels.title_fingerprint(title).alias("fingerprint"),
        ),
    )
