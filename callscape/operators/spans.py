"""Interval containment joins: which definition encloses an offset.

Spans lie in buckets of a level that fits their size, so that each covers few
of them; a probe is in one bucket of every level. So containment is one
equi-join on file, level and bucket, and a large file or one of wide spans is
many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import NODE_KINDS, ordinal

#: Units of one bucket of the lowest level, how much wider those of the next are, and the number of levels.
BUCKET, LINES, FACTOR, LEVELS = 4096, 64, 64, 4


def _covering(first: Column, last: Column, bucket: int) -> Column:
    """(level, bucket) of all buckets that a span from first to last touches, at the lowest level where these are few."""
    at = lambda level: bucket * FACTOR**level
    own = lambda level: F.transform(F.sequence(F.floor(first / at(level)), F.floor(last / at(level))), lambda b: F.struct(F.lit(level).alias("level"), b.cast("long").alias("bucket")))
    out = own(LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        out = F.when(last - first <= at(level) * FACTOR, own(level)).otherwise(out)
    return out


def _buckets(spot: Column, bucket: int) -> Column:
    """(level, bucket) of a place, for every level."""
    return F.array(*(F.struct(F.lit(level).alias("level"), F.floor(spot / (bucket * FACTOR**level)).cast("long").alias("bucket")) for level in range(LEVELS)))


def _smallest(probes: DataFrame, spans: DataFrame, inside: Column) -> DataFrame:
    """(probe_row, found): for each probe what the least span in one of its buckets that holds it has; null where none does.

    probes: probe_row, by, places; spans: span_by, places, order, found.
    """
    left = probes.withColumn("place", F.explode("places")).drop("places")
    right = spans.withColumn("span_place", F.explode("places")).drop("places")
    near = left.join(right, (F.col("by") == F.col("span_by")) & (F.col("place") == F.col("span_place")) & inside).select("probe_row", "order", "found")
    none = probes.select("probe_row", F.lit(None).cast(near.schema["order"].dataType).alias("order"), F.lit(None).cast(near.schema["found"].dataType).alias("found"))
    return near.unionByName(none).groupBy("probe_row").agg(F.min_by("found", "order").alias("found"))  # no order, no say


def enclosing(probes: DataFrame, spans: DataFrame, by: str = "file", at: str = "at", keep: tuple[str, ...] = ("id",), bucket: int = BUCKET) -> DataFrame:
    """Each probe with the smallest span [byte_start, byte_end) of its file that contains its offset; nulls where none does.

    Ties go to the earlier start, then to the lower kind, then to the lower id.
    """
    order = F.struct((F.col("byte_end") - F.col("byte_start")).alias("size"), F.col("byte_start").alias("start"), ordinal(F.col("kind"), NODE_KINDS).alias("rank"), F.col("id").alias("id"))
    own = spans.where("byte_start < byte_end").select(F.col(by).alias("span_by"), "byte_start", "byte_end", order.alias("order"), F.struct(*keep).alias("found"), _covering(F.col("byte_start"), F.col("byte_end") - 1, bucket).alias("places"))
    marked = probes.select(F.struct(*probes.columns).alias("probe_row"), F.col(by).alias("by"), F.col(at).alias("spot"), _buckets(F.col(at), bucket).alias("places"))
    best = _smallest(marked, own, (F.col("spot") >= F.col("byte_start")) & (F.col("spot") < F.col("byte_end")))
    return best.select("probe_row.*", *(F.col(f"found.{c}").alias(f"{c}_found") for c in keep))


def enclosing_lines(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """Containment on (line, column): probes (document, line, col, …), spans (document, start_line, start_col, end_line, end_col, symbol).

    The size of a span is its lines times 10,000 plus its columns; ties go to the earlier span in its document. Probes in no span are left out.
    """
    at = lambda a, b: F.struct(F.col(a).cast("long").alias("l"), F.col(b).cast("long").alias("c"))
    size = (F.col("end_line") - F.col("start_line")) * 10_000 + (F.col("end_col") - F.col("start_col"))
    order = F.struct(size.alias("size"), F.col("ordinal").alias("ordinal"))
    own = spans.where("start_line <= end_line").select(F.col("document").alias("span_by"), at("start_line", "start_col").alias("lo"), at("end_line", "end_col").alias("hi"), order.alias("order"), F.struct("symbol").alias("found"), _covering(F.col("start_line"), F.col("end_line"), LINES).alias("places"))
    marked = probes.select(F.struct(*probes.columns).alias("probe_row"), F.col("document").alias("by"), at("line", "col").alias("spot"), _buckets(F.col("line"), LINES).alias("places"))
    best = _smallest(marked, own, (F.col("lo") <= F.col("spot")) & (F.col("spot") < F.col("hi")))
    return best.where("found is not null").select("probe_row.*", F.col("found.symbol").alias("enclosing_symbol"))
