"""Which texts contain which needles, by an equi join on anchors instead of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.anchors import anchor_places, needle_anchors
from clauseloom.session import materialize


def containing_pairs(needles: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of ``needles`` (column ``needle``) beside the rows of ``texts`` (column ``hay``) that contain them.

    One anchor of each needle meets the places of the texts that may have it, in an equi join within ``scope``. Places that no needle
    can stand at are left out while the texts are scanned, and a text moves once, to be compared in full with the needles whose
    anchor it has. Empty needles match nothing. Runs Spark jobs when called.
    """
    sized = needles.filter(F.length("needle") > 0).withColumn("_needle", F.md5("needle"))
    anchors = materialize(needle_anchors(sized, scope), "anchors")
    # Two texts of one hash only meet more needles than they need to.
    keyed = texts.withColumn("_hay", F.xxhash64("hay"))
    places = anchor_places(keyed, anchors, [*scope, "_hay"]).select(*scope, "_hay", "_size", "_anchor")
    found = places.join(anchors.drop("_at"), [*scope, "_size", "_anchor"]).select(*scope, "_hay", "_needle").distinct()
    return (keyed.join(found, [*scope, "_hay"]).join(sized, [*scope, "_needle"])
            .filter(F.col("hay").contains(F.col("needle"))).drop("_hay", "_needle"))


def passage_binding(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the passages found in the documents after evidence normalisation."""
    from clauseloom.functions.text import normalize_evidence
    needles = passages.select("item_id", normalize_evidence("text").alias("needle"))
    hay = documents.select("doc_id", normalize_evidence("text").alias("hay"))
    return containing_pairs(needles, hay, []).select("doc_id", "item_id")
