"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines says whether the first may start a chunk and whether the
second may end one, so boundaries depend on two lines alone and an inserted line moves none but its neighbours. A chunk
runs from each start to the nearest end; chunks may overlap. Chunks that occur again anywhere in the corpus are
removed, all but their first occurrence, after their bytes were compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

#: Chunks of fewer lines are never removed, and none has more.
MIN_LINES, MAX_LINES = 2, 9
#: A hex digit of the rolling hash below this makes a boundary: eleven of sixteen.
BOUNDARY = "b"


def line_chunks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, row_key, chunks array<struct<at, n, body>>), null texts left out.

    roll(i) is the hash of the hashes of lines i - 1 and i. Line i starts a chunk if it is the first or the first digit
    of roll(i + 1) is below BOUNDARY; line i ends one if it is the last or the second digit of roll(i) is. A chunk has
    two lines at least, ends at the nearest end, and at MAX_LINES lines at the latest. ``at`` counts from 1.
    """
    lined = docs.where(F.col("text").isNotNull()).select("doc_id", row_key().alias("row_key"), F.split("text", "\n", -1).alias("lines"))
    hashed = lined.withColumn("hashes", F.transform("lines", lambda line: F.md5(line)))
    before = F.concat(F.array(F.lit("")), F.slice("hashes", 1, F.size("hashes") - 1))
    rolled = hashed.withColumn("rolls", F.zip_with(before, "hashes", lambda b, own: F.substring(F.md5(F.concat(b, own)), 1, 2)))
    roll = lambda i: F.get(F.col("rolls"), i - 1)
    starts = F.filter(
        F.sequence(F.lit(1), F.size("lines")), lambda i: (i < F.size("lines")) & ((i == 1) | (F.substring(roll(i + 1), 1, 1) < BOUNDARY))
    )
    cut = rolled.withColumn("starts", starts)
    ends = lambda i: (i == F.size("lines")) | (F.substring(roll(i), 2, 1) < BOUNDARY)
    length = lambda at: F.coalesce(*[F.when(ends(at + d), d + 1) for d in range(1, MAX_LINES - 1)], F.lit(MAX_LINES))
    placed = cut.select("doc_id", "row_key", "lines", F.transform("starts", lambda at: F.struct(at.alias("at"), length(at).alias("n"))).alias("spans"))
    chunks = F.transform(
        "spans", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.array_join(F.slice("lines", s["at"], s["n"]), "\n").alias("body"))
    )
    return placed.select("doc_id", "row_key", chunks.alias("chunks"))


def flagged_chunks(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(row_key, spans array<struct<at, n>>): the chunks whose hash occurs again; only small rows are counted."""
    found = written(
        line_chunks(docs)
        .select("doc_id", "row_key", F.explode_outer("chunks").alias("chunk"))  # not explode: Spark would infer a filter that computes all chunks once more
        .where((F.col("chunk.n") >= min_lines) & (F.trim("chunk.body") != ""))
        .select("doc_id", "row_key", "chunk.at", "chunk.n", F.xxhash64("chunk.body").alias("hash")),
        "line-chunks",
    )
    again = found.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash")
    return written(
        found.join(again, "hash", "left_semi").groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans")),
        "line-chunks-flagged",
    )


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Every row of docs(doc_id, text, ...) with repeated chunks cut out of text, and removed_lines int.

    The bodies of flagged chunks are grouped by their bytes; of equal ones the occurrence with the least (doc_id,
    row_key, at), nulls first, stays. Both joins to the texts ask for the same partitioning by row_key, so that Spark
    shuffles the texts once for both.

    A null text stays null and an empty one empty; both have removed_lines 0. Rows that repeat doc_id and text count
    as one document: each is left as one would be. A document that consists of repeated chunks keeps an empty text.
    Columns of other names pass through, whatever they are called; one named removed_lines is replaced.
    """
    columns = [c for c in docs.columns if c != "removed_lines"]
    names = [f"c{i}" for i in range(len(columns))]  # so that no column's name can clash with those used here
    plain = docs.select(*columns).toDF(*names).withColumns({c: F.col(names[columns.index(c)]) for c in ("doc_id", "text")})
    keyed = plain.withColumn("__row_key", row_key())
    flagged = flagged_chunks(plain, min_lines).select(F.col("row_key").alias("__row_key"), F.col("spans").alias("__spans"))
    body = F.array_join(F.slice("lines", F.col("span.at"), F.col("span.n")), "\n")
    kept = (
        keyed.join(flagged.hint("merge"), "__row_key")
        .select("doc_id", "__row_key", F.split("text", "\n", -1).alias("lines"), F.explode_outer("__spans").alias("span"))
        .select("doc_id", "__row_key", F.col("span.at").alias("at"), body.alias("body"))
        .groupBy("body")
        .agg(F.min(F.struct("doc_id", "__row_key", "at")).alias("first"))
        .groupBy("first.__row_key")
        .agg(F.collect_set("first.at").alias("__kept"))
    )
    none = F.array().cast("array<int>")
    removed = F.filter("__spans", lambda s: ~F.array_contains(F.coalesce(F.col("__kept"), none), s["at"]))
    gone = (
        flagged.join(kept, "__row_key", "left")
        .select("__row_key", F.array_distinct(F.flatten(F.transform(removed, lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1)))).alias("__gone"))
    )
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size("__lines")), "__gone"), lambda i: F.get(F.col("__lines"), i - 1))
    untouched = F.col("__gone").isNull() | (F.size("__gone") == 0)
    return (
        keyed.join(gone.hint("merge"), "__row_key", "left")
        .withColumn("__lines", F.when(~untouched, F.split("text", "\n", -1)))
        .select(
            *[F.when(untouched, F.col("text")).otherwise(F.array_join(left, "\n")).alias("text") if c == "text" else F.col("doc_id") if c == "doc_id" else F.col(n).alias(c) for n, c in zip(names, columns, strict=True)],
            F.when(untouched, 0).otherwise(F.size("__gone")).alias("removed_lines"),
        )
    )


ORACLE = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
lined AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM docs),
hashed AS (SELECT *, md5(line) AS h FROM lined),
rolled AS (
  SELECT *, md5(concat(coalesce(lag(h) OVER w, ''), h)) AS roll FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
marked AS (
  SELECT *, i < n AND (i = 1 OR lead(roll[1:1]) OVER w < 'b') AS starts, i = n OR roll[2:2] < 'b' AS ends
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
spans AS (
  SELECT s.doc_id, s.i AS first_line, coalesce(min(e.i), s.i + 8) AS last_line
  FROM marked s LEFT JOIN marked e ON e.doc_id = s.doc_id AND e.i BETWEEN s.i + 1 AND s.i + 8 AND e.ends
  WHERE s.starts GROUP BY s.doc_id, s.i
),
chunks AS (
  SELECT s.doc_id, s.first_line, s.last_line, string_agg(l.line, chr(10) ORDER BY l.i) AS body
  FROM spans s JOIN lined l ON l.doc_id = s.doc_id AND l.i BETWEEN s.first_line AND s.last_line GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, first_line) AS occurrence FROM chunks
),
gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM ranked r JOIN lined l ON l.doc_id = r.doc_id AND l.i BETWEEN r.first_line AND r.last_line
  WHERE trim(body, ' ') <> '' AND occurrence > 1
),
left_over AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) AS text
  FROM lined p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
),
lost AS (SELECT doc_id, count(*)::INT AS removed_lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(l.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN left_over t USING (doc_id) LEFT JOIN lost l USING (doc_id)
"""
