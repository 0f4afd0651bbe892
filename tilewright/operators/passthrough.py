"""Whether a compressed payload can be copied unchanged, as one ordered CASE per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reject_reason(source: dict[str, Column], wanted: dict[str, Column]) -> Column:
    """The first failing rule in fixed order, null if all hold; a null requirement matches anything."""
    out = F.when(F.coalesce(source["bytes"], F.lit(0)) == 0, "EmptyPayload")
    out = out.when(~source["transfer_syntax"].eqNullSafe(wanted["transfer_syntax"]), "TransferSyntaxMismatch")
    out = out.when(~source["payload_kind"].eqNullSafe(wanted["payload_kind"]), "PayloadKindMismatch")
    optional = [("dimensions", "DimensionsMismatch"), ("components", "ComponentsMismatch"), ("bit_depth", "BitDepthMismatch"), ("colorspace", "ColorspaceMismatch"), ("tile_layout", "TileLayoutMismatch")]
    for key, reason in optional:
        if key in wanted:
            out = out.when(wanted[key].isNotNull() & ~source[key].eqNullSafe(wanted[key]), reason)
    return out


def decide(tiles: DataFrame, reason: Column) -> DataFrame:
    return tiles.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").isNull(), "Copy").otherwise("Transcode"))
