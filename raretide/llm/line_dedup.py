"""Removal of later repeated runs of lines, by winnowing over line hashes; DataFrame expressions only.

Every window of ``run`` consecutive lines selects its smallest line hash as fingerprint, the first of equal ones: two
equal windows always select the same one, at the same distance from their start. Only fingerprints are written, with
their place; neighbouring windows mostly select the same. Fingerprints that stand at several places are joined, and
only around those the match is extended both ways: each of the windows that selected it is compared by its content
with the first place of that content. Windows that follow one another extend a match further: their union is a maximal
repeated run, and every run whose content stands earlier is deleted. Equal lines next to a matched window always make
a further matched window, so nothing is lost against comparing line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raretide.llm.workspace import Workspace

SPACE = " \t\r\x0b\f"


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole row apart, so that further columns may have any name; body tells rows apart that share an id."""
    return docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("body"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))


def _fingerprints(source: DataFrame, run: int) -> DataFrame:
    """doc_id, body, mark (the fingerprint), windows (first, last as line numbers, key1, key2): one row for each place selected."""
    trimmed = F.transform("lines", lambda s, i: F.struct(F.btrim(s, F.lit(SPACE)).alias("s"), i.alias("i")))
    hashed = F.transform(F.filter(trimmed, lambda x: x.s != ""), lambda x: F.struct(x.i.alias("i"), F.xxhash64(x.s).alias("h1"), F.conv(F.substring(F.md5(x.s), 1, 15), 16, 10).cast("long").alias("h2")))

    def window(p: Column) -> Column:
        part = F.slice("seq", p, run)
        h1, h2 = F.transform(part, lambda x: x.h1), F.transform(part, lambda x: x.h2)
        at = p + F.array_position(h1, F.array_min(h1)).cast("int") - 1
        return F.struct(F.get(part, F.lit(0)).i.alias("first"), F.get(part, F.lit(run - 1)).i.alias("last"), F.xxhash64(h1).alias("key1"), F.xxhash64(h2).alias("key2"), at.alias("at"))

    sequences = source.select("doc_id", "body", hashed.alias("seq")).filter(F.size("seq") >= run)
    sequences = sequences.withColumn("windows", F.transform(F.sequence(F.lit(1), F.size("seq") - run + 1), window))
    # the windows that selected place p start at p - run + 1 .. p
    around = lambda p: F.filter(F.slice("windows", F.greatest(p - run + 1, F.lit(1)), F.lit(run)), lambda w: w.at == p)
    places = F.transform(F.array_distinct(F.transform("windows", lambda w: w.at)), lambda p: F.struct(F.get("seq", p - 1).h1.alias("mark"), around(p).alias("windows")))
    return sequences.select("doc_id", "body", F.explode(places).alias("f")).select("doc_id", "body", "f.mark", "f.windows")


def repeated_runs(source: DataFrame, work: Workspace, run: int) -> DataFrame:
    """doc_id, body, first, last: maximal runs of lines to delete, as line numbers of the text."""
    places = work.table(_fingerprints(source.filter("doc_id IS NOT NULL"), run), "fingerprints")
    # written first, so that the join stands alone in its stage and a frequent fingerprint's places can be split
    shared = work.table(places.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark"), "shared")
    met = places.join(shared, "mark").select("doc_id", "body", F.explode("windows").alias("w"))
    candidates = work.table(met.select("doc_id", "body", "w.first", "w.last", "w.key1", "w.key2"), "candidates")
    work.drop(places, shared)
    first = work.table(candidates.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "first")).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key1", "key2", "earliest"), "first")
    later = candidates.join(first, ["key1", "key2"]).filter(F.struct("doc_id", "first") > F.col("earliest")).select("doc_id", "body", "first", "last")
    # islands of overlapping windows
    in_text = W.partitionBy("doc_id", "body").orderBy("first")
    reach = F.max("last").over(in_text.rowsBetween(W.unboundedPreceding, -1))
    islands = later.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(in_text.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "body", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def _cut(docs: DataFrame, id_col: str, text_col: str, run: int) -> DataFrame:
    """whole, doc_id, lines, n_removed and what is left as text."""
    source = _source(docs, id_col, text_col)
    with Workspace(docs.sparkSession, "line-dedup") as work:
        runs = repeated_runs(source, work, run)
        before = F.lag("last", 1, -1).over(W.partitionBy("doc_id", "body").orderBy("first")) + 1
        # stretches that stay: before each run, and after the last
        gaps = runs.select("doc_id", "body", F.struct(before.alias("at"), (F.col("first") - before).alias("size")).alias("gap"), "first", "last")
        cuts = work.keep(gaps.groupBy("doc_id", "body").agg(F.array_sort(F.collect_list("gap")).alias("gaps"), (F.max("last") + 1).alias("rest"), F.sum(F.col("last") - F.col("first") + 1).alias("n_removed")))
    both = source.join(cuts, ["doc_id", "body"], "left")
    stay = F.concat(F.flatten(F.transform("gaps", lambda g: F.slice("lines", g.at + 1, g.size))), F.slice("lines", F.col("rest") + 1, F.size("lines")))
    return both.select("whole", "doc_id", "lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.when(F.col("gaps").isNotNull(), F.array_join(stay, "\n")).alias("left"))


def dedup_lines(docs: DataFrame, *, run: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, text (what is left).

    Lines end at a line feed and are compared without white space at their ends; blank lines are passed over, but go
    with a run that they stand in. A line is deleted if a window of ``run`` lines covers it whose lines also stand,
    in the same order and next to one another, at an earlier place: in a smaller identifier, or further up in the
    same text. All is judged on the input. A text with fewer lines stays as it is; null stays null, and counts as one
    blank line. Rows with a null identifier stay whole and are no source. Rows that repeat an identifier are told
    apart by their texts. Other columns are not read; an empty table gives an empty result.
    """
    out = _cut(docs, id_col, text_col, run)
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.coalesce("left", F.col(f"whole.{text_col}")).alias("text"))


def without_repeated_lines(docs: DataFrame, *, run: int = 3, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with all its columns and rows, the text cut as in dedup_lines; length_col, if named, is counted anew."""
    out = _cut(docs, id_col, text_col, run)
    text = F.coalesce("left", F.col("whole").getField(text_col))
    new = {text_col: text} | ({length_col: F.when(F.col("left").isNotNull(), F.length("left")).otherwise(F.col("whole").getField(length_col)).cast(docs.schema[length_col].dataType)} if length_col else {})
    return out.select(*(new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns))


def oracle_sql(run: int = 3) -> str:
    """dedup_lines as DuckDB SQL, with the text as its digest."""
    space = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        rows AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
        full_rows AS (SELECT doc_id, i, trim(line, {space}) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rows WHERE trim(line, {space}) <> ''),
        windows AS (SELECT doc_id, i AS first, lead(i, {run - 1}) OVER o AS last, list(s) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {run - 1} FOLLOWING) AS key
                    FROM full_rows WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        later AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, first) AS nth FROM windows WHERE last IS NOT NULL) WHERE nth > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later),
        stay AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text, count(*) AS n FROM rows r ANTI JOIN gone g USING (doc_id, i) GROUP BY r.doc_id)
        SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, CAST(len(d.lines) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.text, '')) AS text_sha256
        FROM split d LEFT JOIN stay s USING (doc_id)
    """
