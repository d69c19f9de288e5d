"""Line dedup: lines that spread over many sites are boilerplate (DataFrame functions only).

The spread of a line is its number of distinct sites.  A HyperLogLog sketch of the sites is kept per
line hash and merged by aggregation, so a line that a third of all documents hold is one sketch per
map task.  Where the estimate is within `margin` of the threshold, the exact distinct count decides;
the sketch errs by far less than the margin.  Boilerplate goes from every document but the one with
the smallest id that holds it, so its text is not lost to the corpus.

Lines are told apart by two 64-bit hashes.  Defined results: null text has no lines and stays null;
empty text is one empty line; lines of spaces only are never boilerplate; a null site adds no site;
equal rows get equal results, and all rows of the first holder's id keep the line; an empty table gives
an empty table; input columns named n_lines or n_removed (in any case) are replaced, and all others
pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.columns import numbered, place, untouched
from llm.storage import stored

MIN_SITES = 10
SKETCH_BITS = 10
MARGIN = 0.3


def _hashes(*columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *columns) for seed in (17, 91)]


def boilerplate_lines(documents: DataFrame, min_sites: int = MIN_SITES, site: str = "source", text: str = "text", doc_id: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """h1, h2 and first_id of each line that spreads over min_sites sites or more."""
    lines = documents.select(F.col(doc_id).alias("id"), F.col(site).cast("string").alias("site"), F.explode(F.split(text, "\n")).alias("line"))
    h1, h2 = _hashes(F.col("line"))
    lines = lines.where(F.trim("line") != "").select("id", "site", h1.alias("h1"), h2.alias("h2"))
    sketch = F.hll_sketch_agg("site", F.lit(SKETCH_BITS))
    spread = lines.groupBy("h1", "h2").agg(sketch.alias("sketch"), F.count("site").alias("n"), F.min("id").alias("first_id"))
    spread = spread.where(F.col("n") >= min_sites).select("h1", "h2", "first_id", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = stored(spread.where(F.col("sites") >= (1 - margin) * min_sites), "spread")
    certain = likely.where(F.col("sites") > (1 + margin) * min_sites)
    near = likely.where(F.col("sites") <= (1 + margin) * min_sites)
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact"))
    confirmed = near.join(exact.where(F.col("exact") >= min_sites), ["h1", "h2"], "left_semi")
    return certain.unionByName(confirmed).select("h1", "h2", "first_id")


def remove_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES, site: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """documents with the text without its boilerplate lines, and n_lines and n_removed (long)."""
    names, kept_places = documents.columns, untouched(documents, "n_lines", "n_removed")
    text, doc_id, site = (f"c{place(documents, c)}" for c in (text, doc_id, site))
    documents = numbered(documents)
    spread = stored(boilerplate_lines(documents, min_sites, site, text, doc_id), "boilerplate")
    r1, r2 = _hashes(F.col(doc_id), F.col(text))
    lines = documents.select(F.col(doc_id).alias("id"), r1.alias("r1"), r2.alias("r2"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    h1, h2 = _hashes(F.col("line"))
    held = lines.select("id", "r1", "r2", "pos", h1.alias("h1"), h2.alias("h2")).join(spread, ["h1", "h2"])
    gone = held.where(~F.col("id").eqNullSafe(F.col("first_id"))).groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))
    rows = documents.withColumns({"r1": r1, "r2": r2}).join(gone, ["r1", "r2"], "left")
    parts = F.split(text, "\n")
    count = F.coalesce(F.size(parts), F.lit(0)).cast("long")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n"))
    out = [kept if f"c{i}" == text else F.col(f"c{i}") for i in kept_places]
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    counts = [F.when(F.col(text).isNull(), 0).otherwise(count).cast("long"), F.when(F.col("gone").isNull(), 0).otherwise(removed).cast("long")]
    return rows.select(*out, *counts).toDF(*(names[i] for i in kept_places), "n_lines", "n_removed")


#: Counts and the digest of what is left, on whole tables.
SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), b AS (
  SELECT line, min(doc_id) AS first_id FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), k AS (
  SELECT l.doc_id, l.pos, l.line, (b.line IS NOT NULL AND l.doc_id IS DISTINCT FROM b.first_id) AS gone FROM l LEFT JOIN b ON l.line = b.line
), s AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
