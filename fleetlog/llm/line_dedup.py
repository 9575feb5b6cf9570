"""Removal of repeated multi-line chunks whose boundaries follow the content.

A text is cut at line breaks. Every line has a hash, and a rolling hash runs over the
last three line hashes. A chunk ends after a line whose rolling hash is smaller than
those of the `radius` lines on either side, so a boundary depends on the few lines
around it only and moves along when lines are put in before it. No chunk but that of
a one-line text has a single line.

Chunks are grouped by fingerprint; the smallest and the largest text of a group are
compared byte for byte, and a group in which they differ is taken apart by its texts.
Of each repeated chunk the first copy stays, by document key and place.

Everything is built-in column expressions. Texts cross the network twice: the
chunks, after duplicates within a task are merged, and the documents for the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.frames import document_key, written

# Fixed values, shared with the SQL form: weights of the rolling hash and its modulus.
WEIGHTS = (1, 40503, 65599)
MODULUS = 4294967291


def _hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _rolling(hashes: Column) -> Column:
    def at(i: Column) -> Column:
        return sum(
            (F.when(i >= back, F.get(hashes, i - back)).otherwise(F.lit(0)) * weight for back, weight in enumerate(WEIGHTS)),
            F.lit(0).cast("long"),
        ) % F.lit(MODULUS)

    return F.transform(F.sequence(F.lit(0), F.size(hashes) - 1), at)


def _ends(rolling: Column, radius: int) -> Column:
    """Number of the last line of each chunk."""
    last = F.size(rolling) - 1

    def is_end(i: Column) -> Column:
        inside = (i >= radius) & (i >= 1) & (i <= last - 2)
        for d in range(1, radius + 1):
            inside &= F.get(rolling, i) < F.get(rolling, i - d)
            inside &= F.coalesce(F.get(rolling, i) < F.get(rolling, i + d), F.lit(True))
        return (i == last) | inside

    return F.filter(F.sequence(F.lit(0), last), is_end)


def _with_ends(df: DataFrame, radius: int) -> DataFrame:
    df = df.withColumn("lines", F.split("text", "\n", -1))
    df = df.withColumn("rolling", F.transform("lines", _hash))
    df = df.withColumn("rolling", _rolling(F.col("rolling")))
    return df.withColumn("ends", _ends(F.col("rolling"), radius)).drop("rolling")


def _begin(no: Column) -> Column:
    return F.when(no > 0, F.get(F.col("ends"), no - 1) + 1).otherwise(F.lit(0))


def _lines(no: Column) -> Column:
    begin = _begin(no)
    return F.slice("lines", begin + 1, F.get(F.col("ends"), no) - begin + 1)


def chunks(docs: DataFrame, radius: int) -> DataFrame:
    """One row per multi-line chunk with a word: k1, k2, no, body, fingerprint."""
    cut = _with_ends(docs, radius).select("k1", "k2", "lines", "ends", F.explode(F.sequence(F.lit(0), F.size("ends") - 1)).alias("no"))
    part = cut.select("k1", "k2", "no", _lines(F.col("no")).alias("part"))
    return part.filter(F.size("part") > 1).select("k1", "k2", "no", F.array_join("part", "\n").alias("body")).filter(F.col("body").rlike(r"\S"))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 1, fingerprint_bits: int = 64
) -> DataFrame:
    """All columns of df with the text cleaned, plus n_lines, n_chunks, n_removed_chunks, n_removed_lines.

    A null text stays null and counts 0 lines; an empty one has one empty line. Chunks
    without a word are left alone. Rows equal in id and text are one document: none is
    a copy of the other. A column of df named like one of the four counts is replaced.
    """
    key1, key2 = document_key(df[id_col], df[text_col])
    docs = df.select(key1, key2, df[text_col].cast("string").alias("text")).filter(F.col("text").isNotNull())
    seed = F.xxhash64("body")
    if fingerprint_bits < 64:
        seed = F.pmod(seed, F.lit(1 << fingerprint_bits))
    rows = chunks(docs, radius).withColumn("fp", seed)
    place = F.struct("k1", "k2", "no")
    groups = written(
        rows.groupBy("fp").agg(
            F.count(F.lit(1)).alias("n"), F.min(place).alias("first"),
            F.min("body").alias("low"), F.max("body").alias("high"),
        ).filter("n > 1").select("fp", "first", (F.col("low") != F.col("high")).alias("mixed")),
        "line-chunks",
    )
    later = (
        rows.select("fp", place.alias("place"))
        .join(groups.filter("not mixed").select("fp", "first"), "fp")
        .filter("place != first").select("place")
    )
    mixed = groups.filter("mixed").select("fp")
    if not mixed.isEmpty():  # unequal texts under one fingerprint: go by the texts themselves
        odd = written(rows.join(mixed, "fp").select("body", place.alias("place")), "line-mixed")
        firsts = odd.groupBy("body").agg(F.min("place").alias("first"))
        later = later.union(odd.join(firsts, "body").filter("place != first").select("place"))
    gone = later.groupBy("place.k1", "place.k2").agg(F.collect_set("place.no").alias("gone"))

    counts = ["n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines"]
    others = [c for c in df.columns if c.lower() not in {*counts, text_col.lower()}]
    packed = df.select(F.struct(*[df[c] for c in others]).alias("row"), df[text_col].cast("string").alias("text"), key1, key2)
    cut = _with_ends(packed.join(gone, ["k1", "k2"], "left"), radius)
    numbers = F.sequence(F.lit(0), F.size("ends") - 1)
    cut = cut.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))).withColumn(
        "kept", F.filter(numbers, lambda no: ~F.array_contains("gone", no))
    )
    cut = cut.withColumn("clean", F.flatten(F.transform("kept", _lines)))
    full = F.col("text").isNotNull()
    zero = F.lit(0).cast("long")
    columns = [
        *[F.col("row")[c].alias(c) for c in others],
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join("clean", "\n")).alias(text_col),
        F.when(full, F.size("lines").cast("long")).otherwise(zero).alias("n_lines"),
        F.when(full, F.size("ends").cast("long")).otherwise(zero).alias("n_chunks"),
        F.size("gone").cast("long").alias("n_removed_chunks"),
        F.when(full, (F.size("lines") - F.size("clean")).cast("long")).otherwise(zero).alias("n_removed_lines"),
    ]
    # as rows of an array, so that a caller's filter is not pushed into the expressions above and computes them line by line
    return cut.select(F.inline(F.array(F.struct(*columns))))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n
  FROM documents WHERE text IS NOT NULL
), h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l
), r AS (
  SELECT *, (h * {WEIGHTS[0]} + coalesce(lag(h) OVER w, 0) * {WEIGHTS[1]} + coalesce(lag(h, 2) OVER w, 0) * {WEIGHTS[2]}) % {MODULUS} AS r
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), e AS (
  SELECT *, (i = n - 1 OR (i >= 1 AND i <= n - 3 AND r < lag(r) OVER w AND r < lead(r) OVER w))::INT AS ends
  FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY i) - ends AS no FROM e
), chunk AS (
  SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS lines FROM c GROUP BY doc_id, no
), mark AS (
  SELECT *, lines > 1 AND regexp_matches(body, '\\S')
    AND row_number() OVER (PARTITION BY body, lines > 1 ORDER BY doc_id, no) > 1 AS gone
  FROM chunk
)
SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text,
       sum(lines)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks,
       coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS n_removed_lines
FROM mark GROUP BY doc_id
"""
