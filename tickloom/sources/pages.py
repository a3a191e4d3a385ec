"""Raw provider pages: digests, decoding to ticks, and the overlap of neighbouring pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, identifier

#: Layout of a history page.
PAGE = "struct<history: struct<prices: array<string>, times: array<bigint>>, kind: string>"


def digests(pages: DataFrame) -> DataFrame:
    """delivery_id, intact: does the payload have the declared digest? null without payload."""
    return pages.select("delivery_id", (F.sha2("payload", 256) == digest(F.col("payload_sha256"))).alias("intact"))


def decoded(pages: DataFrame) -> DataFrame:
    """Rows of intact history pages: delivery_id, acquisition, ordinal, digest, place (in the page), t_millis, price (the text as sent). Damaged payloads give none."""
    good = pages.where(F.sha2("payload", 256) == digest(F.col("payload_sha256")))
    page = F.from_json(F.decode("payload", "UTF-8"), PAGE, {"mode": "PERMISSIVE"})
    rows = good.select("delivery_id", identifier(F.col("acquisition_id")).alias("acquisition"), "ordinal", digest(F.col("payload_sha256")).alias("digest"), page.alias("p")).where("size(p.history.prices) = size(p.history.times)")
    return rows.select("delivery_id", "acquisition", "ordinal", "digest", F.posexplode(F.arrays_zip("p.history.times", "p.history.prices")).alias("place", "x")).select("delivery_id", "acquisition", "ordinal", "digest", "place", F.col("x.times").alias("t_millis"), F.col("x.prices").alias("price"))


def without_overlap(rows: DataFrame) -> DataFrame:
    """Page rows (acquisition, ordinal, digest, place, t_millis, price) without what the page before ended with. Pages of one ordinal but another digest are pages of their own, in the order of their digests.

    A page that begins with the longest identical tail of the page before it drops that head, row for row; repeats within a page stay. Candidate
    overlaps are the lengths at which the row before the cut equals the last row of the page before; each is held against both pages whole.
    """
    w = Window.partitionBy("acquisition").orderBy("ordinal", "digest")
    pages = rows.groupBy("acquisition", "ordinal", "digest").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "t_millis", "price"))), lambda x: F.struct(x["t_millis"].alias("t"), x["price"].alias("p"))).alias("r"))
    pages = pages.withColumn("before", F.lag("r").over(w))
    n = F.least(F.size("r"), F.size("before"))
    fits = F.filter(F.sequence(F.lit(1), n), lambda k: F.slice("r", F.lit(1), k) == F.slice("before", F.size("before") - k + 1, k))
    drop = F.when(F.col("before").isNotNull() & (n > 0), F.coalesce(F.array_max(fits), F.lit(0))).otherwise(0)
    return pages.withColumn("dropped", drop).select("acquisition", "ordinal", "digest", "dropped", F.posexplode("r").alias("place", "x")).where("place >= dropped").select("acquisition", "ordinal", "digest", "place", F.col("x.t").alias("t_millis"), F.col("x.p").alias("price"))
