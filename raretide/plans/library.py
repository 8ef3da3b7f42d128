"""Queries over libraries of failing configurations and over stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from raretide.functions import ansatz
from raretide.operators import library as L
from raretide.operators import spectrum as S
from raretide.plans import base as X
from raretide.plans.catalogue import query
from raretide.sources import results

#: key, factor, plus of the moves around a setting.
MOVES = (("sets", 2.0, 0.0), ("sets", 0.5, 0.0), ("legs", 1.0, 1.0), ("legs", 1.0, -1.0), ("memory", 1.25, 0.0), ("memory", 0.8, 0.0), ("spread", 1.0, 0.1))
MOVES_SQL = "moves(key, factor, plus) AS (VALUES " + ", ".join(f"('{k}', {f}::DOUBLE, {p}::DOUBLE)" for k, f, p in MOVES) + ")"


@query(f"""WITH {MOVES_SQL}, settings AS (SELECT n_name AS name, unnest([{{'key': 'sets', 'old': 100.0::DOUBLE + n_nationkey}}, {{'key': 'legs', 'old': 1.0::DOUBLE + n_regionkey}}, {{'key': 'memory', 'old': 0.125::DOUBLE}}]) AS s FROM nation)
    SELECT DISTINCT name, key, s.old * factor + plus AS value FROM settings JOIN moves ON moves.key = s.key WHERE s.old * factor + plus > 0 AND s.old * factor + plus <> s.old""")
def setting_neighbours(spark, sf):
    """Every decoder setting with one of its values moved; values at or below zero are left out."""
    config = F.create_map(F.lit("sets"), F.lit(100.0) + F.col("n_nationkey"), F.lit("legs"), F.lit(1.0) + F.col("n_regionkey"), F.lit("memory"), F.lit(0.125))
    settings = X.read(spark, sf, "nation").select(F.col("n_name").alias("name"), config.alias("config"))
    return L.neighbours(settings, spark.createDataFrame(MOVES, "key string, factor double, plus double")).select("name", "key", "value")


SPECIMENS = "sets AS (SELECT l_linestatus AS kind, l_orderkey AS iteration, list_sort(list(DISTINCT l_partkey)) AS mechs, bool_or(l_returnflag <> 'A') AS fails FROM lineitem GROUP BY ALL)"


def _specimens(spark, sf, kind):
    line = X.read(spark, sf, "lineitem").filter(F.col("l_linestatus") == kind)
    return line.groupBy(F.col("l_orderkey").alias("iteration")).agg(F.collect_set("l_partkey").alias("mechs"), F.max(F.col("l_returnflag") != "A").alias("fails"))


@query(f"""WITH {SPECIMENS}, named AS (SELECT kind, array_to_string(mechs, ',') AS name, len(mechs) AS w, iteration FROM sets WHERE kind = 'F' OR fails),
    once AS (SELECT name, min(w) AS w, min(iteration) FILTER (kind = 'F') AS old, min(iteration) FILTER (kind = 'O') AS new FROM named GROUP BY name)
    SELECT name, CAST(w AS BIGINT) AS w, coalesce(old, new) AS iteration, old IS NULL AS added FROM once""")
def library_fold(spark, sf):
    """The library (one kind of lines) with the failing specimens of the other kind that it lacks."""
    folded = L.fold(_specimens(spark, sf, "F").drop("fails"), _specimens(spark, sf, "O"))
    return folded.select("name", F.size("mechs").cast("long").alias("w"), "iteration", "added")


@query(f"WITH {SPECIMENS} SELECT kind, fails, count(*) AS n, CAST(min(len(mechs)) AS BIGINT) AS w_min, max(iteration) AS latest FROM sets GROUP BY kind, fails")
def library_status(spark, sf):
    """Size, lightest specimen and latest addition of each part of the library."""
    both = _specimens(spark, sf, "F").withColumn("kind", F.lit("F")).unionByName(_specimens(spark, sf, "O").withColumn("kind", F.lit("O")))
    return L.status(both, ["kind", "fails"])


@query("""WITH marked AS (SELECT o_orderkey AS specimen, least(CAST(floor(o_totalprice / 20000) AS BIGINT) + 1, 9) AS stratum FROM orders),
    drawn AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS of, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(specimen AS VARCHAR)), specimen) AS place FROM marked)
    SELECT specimen, CAST(stratum AS BIGINT) AS stratum, of FROM drawn WHERE place <= CASE WHEN stratum <= 8 THEN 25 ELSE 60 END""")
def bench_strata(spark, sf):
    """A bench drawn by weight: 25 specimens of each light weight, 60 of all heavier ones (the sampling is the feature)."""
    specimens = X.read(spark, sf, "orders").select(F.col("o_orderkey").alias("specimen"), (F.floor(F.col("o_totalprice") / 20000) + 1).alias("w"))
    return L.strata(specimens, "w", "specimen").select("specimen", "stratum", "of")


@query(f"WITH {X.SHOTS}, spec AS (SELECT run, channel, w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY run, channel, w) SELECT run, CAST(channel AS BIGINT) AS channel, array_to_string(list(w ORDER BY w), ',') AS weights, array_to_string(list(t ORDER BY w), ',') AS trials, array_to_string(list(f ORDER BY w), ',') AS failures FROM spec GROUP BY run, channel")
def spectrum_payload(spark, sf):
    """Each spectrum as parallel arrays, the form in which results store it."""
    rows = results.payload(S.failure_spectrum(X.shots(spark, sf), ["run", "channel"]), ["run", "channel"])
    return rows.select("run", F.col("channel").cast("long").alias("channel"), *(F.array_join(c, ",").alias(c) for c in ("weights", "trials", "failures")))


@query(f"WITH {X.SHOTS} SELECT run, CAST(w AS BIGINT) AS w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY run, w")
def stored_spectrum(spark, sf):
    """Bins rebuilt from stored results, whose further fields are dropped."""
    rows = results.payload(S.failure_spectrum(X.shots(spark, sf), ["run"]), ["run"])
    stored = rows.select("run", F.struct("weights", "trials", "failures", F.lit(1.0).alias("q_base")).alias("result"))
    bins = results.unpacked(stored, ["run"], "result")
    return bins.select("run", F.col("w").cast("long").alias("w"), F.col("t").cast("long").alias("t"), F.col("f").cast("long").alias("f"))


@query("""SELECT vec_id AS run, 'embedding' AS name, CAST(i - 1 AS BIGINT) AS place, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
    UNION ALL SELECT vec_id, 'labels', 0, CAST(label AS DOUBLE) FROM embeddings""")
def result_arrays(spark, sf):
    """Ragged named arrays in long form."""
    rows = X.read(spark, sf, "embeddings").select(F.col("vec_id").alias("run"), "embedding", F.array("label").alias("labels"))
    return results.named_arrays(rows, "run").withColumn("place", F.col("place").cast("long"))


@query("""SELECT s_suppkey AS task, CASE s_nationkey % 3 WHEN 0 THEN s_name || '__iso_' || CAST(s_nationkey AS VARCHAR) WHEN 1 THEN s_name || '__abl_' || CAST(s_nationkey AS VARCHAR) ELSE s_name END AS folder FROM supplier""")
def output_folders(spark, sf):
    """Where each run writes: its name, with the channel that is kept alone or left out."""
    channel, kind = F.col("s_nationkey").cast("string"), F.col("s_nationkey") % 3
    folder = results.output_folder(F.col("s_name"), F.when(kind == 0, channel), F.when(kind == 1, channel))
    return X.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("task"), folder.alias("folder"))


@query("""SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS place, n_name AS path, CAST(n_nationkey AS BIGINT) AS cpus, CAST(NULL AS VARCHAR) AS mem FROM nation""")
def manifest_tasks(spark, sf):
    """The entries of each region's manifest (a JSON array) as tasks with their place in it."""
    entry = F.struct(F.col("n_name").alias("path"), F.col("n_nationkey").alias("cpus"), F.lit("1:00").alias("time"), F.lit(0).alias("note"))
    lists = X.read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("text"))
    return results.manifest(lists, "text").select("region", F.col("place").cast("long").alias("place"), "path", "cpus", "mem")


@query(f"""WITH {X.SPEC} SELECT CAST(w AS BIGINT) AS w, round(CASE WHEN w < 3 THEN 0 ELSE 0.5 * (1 - exp(-0.002 * pow(w / 3.0::DOUBLE, 3))) END, 9) AS two,
    round(CASE WHEN w < 3 THEN 0 ELSE 0.5 * (1 - exp(-0.002 * pow(w / 3.0::DOUBLE, 4) * pow((1 + pow(w / 12.0::DOUBLE, 2)) / (1 + pow(3 / 12.0::DOUBLE, 2)), (1.5 - 4) / 2))) END, 9) AS five FROM spec""")
def ansatz_families(spark, sf):
    """Curves of two and of five parameters at every sampled weight."""
    w = F.col("w").cast("double")
    spec = S.failure_spectrum(X.shots(spark, sf))
    return spec.select(F.col("w").cast("long").alias("w"), F.round(ansatz.onset_power(w, 3, 0.001, 0.5), 9).alias("two"), F.round(ansatz.two_powers(w, 3, 0.001, 0.5, 4, 1.5, 12), 9).alias("five"))
