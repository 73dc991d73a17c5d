"""Removal of lines that many sites share, in DataFrame operations only.

One HyperLogLog sketch of sites per line hash, merged by aggregation, decides lines whose spread is far from the
threshold. Lines near it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, unused

MIN_SITES = 10
LG_K = 12
BAND = 0.25


def _lines(docs: DataFrame) -> DataFrame:
    """Distinct places of lines that are not blank, by a row key that repeated rows share."""
    key = F.xxhash64("doc_id", "text").alias("row_key")
    parts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("row_doc"), key, F.coalesce("source", F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return parts.filter(F.trim("line") != "").select("row_doc", "row_key", "site", "pos", F.unhex(F.md5("line")).alias("line_hash"), F.char_length("line").alias("chars"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line_hash of the lines that at least min_sites sites hold; lines has line_hash and site."""
    sketches = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    sizes = save(sketches.select("line_hash", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - BAND)), "sites")
    far = sizes.filter(F.col("sites") > min_sites * (1 + BAND)).select("line_hash")
    near = sizes.filter(F.col("sites") <= min_sites * (1 + BAND)).select("line_hash")
    exact = lines.select("line_hash", "site").distinct().join(near, "line_hash", "left_semi").groupBy("line_hash").agg(F.count("*").alias("n"))
    return far.unionByName(exact.filter(F.col("n") >= min_sites).select("line_hash"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with `text` freed of spread lines, plus n_lines and n_removed (long; names of docs that clash give way).

    A line is spread if at least min_sites sources hold it (a null source is the site named by the empty string). Blank
    lines stay. A document that has no other lines but spread and blank ones is a copy rather than a page with
    boilerplate and stays as it is, so no document is emptied. A null text has no lines and stays null; repeated rows
    are all treated alike; ties cannot occur; the work on a text grows with its lines, however long it is; an empty
    table gives an empty result.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed")])
    lines = _lines(base)
    spread = save(spread_lines(lines, min_sites), "spread")
    found = lines.drop("site").join(spread, "line_hash").groupBy("row_doc", "row_key", "pos").agg(F.first("line_hash"))
    row_doc, row_key, cut = unused(base, "row_doc", "row_key", "cut")
    cuts = save(found.groupBy(F.col("row_doc").alias(row_doc), F.col("row_key").alias(row_key)).agg(F.collect_set("pos").alias(cut)), "cuts")
    rows = base.withColumns({row_doc: F.coalesce("doc_id", F.lit(-1)), row_key: F.xxhash64("doc_id", "text")})
    joined = rows.join(cuts, [row_doc, row_key], "left")
    parts = F.split("text", "\n")
    goes = F.col(cut).isNotNull() & (F.size(F.filter(parts, lambda line: F.trim(line) != "")) > F.size(cut))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(cut))
    clean = F.array_join(F.transform(left, lambda i: F.element_at(parts, i + 1)), "\n")
    out = joined.withColumns({
        "text": F.when(goes, clean).otherwise(F.col("text")),
        "n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"),
        "n_removed": F.when(goes, F.size(cut)).otherwise(0).cast("long"),
    })
    return out.select(*base.columns, "n_lines", "n_removed")
