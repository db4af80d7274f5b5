"""Training sets: seeded splits and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtline.functions.text import label_line


def split(rows: DataFrame, group: list[str], key: str, share: float, seed: int) -> DataFrame:
    """Adds split: of each group the rounded share is `val`, at least one and never all; a single row is `train`.

    The order is that of a hash of key and seed, so a row's place does not depend on the partitions.
    """
    own = Window.partitionBy(*group)
    place = F.row_number().over(own.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key))
    n = F.count("*").over(own)
    held = F.least(F.greatest(F.lit(1), F.bround(n * share).cast("bigint")), n - 1)
    return rows.withColumn("split", F.when((n >= 2) & (place <= held), "val").otherwise("train"))


def classified(files: DataFrame, text: str) -> DataFrame:
    """Adds lines (the valid ones, in one form) and kind: `negative` for an empty file, `skip` without a valid line, else `positive`."""
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    lines = F.filter(F.transform(F.split(body, "\r\n|\n|\r"), label_line), lambda x: x.isNotNull())
    rows = files.withColumn("lines", lines)
    return rows.withColumn("kind", F.when(F.length(body) == 0, "negative").when(F.size("lines") == 0, "skip").otherwise("positive"))
