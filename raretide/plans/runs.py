"""Queries over configurations of runs and over tables that compare them."""

from __future__ import annotations

from pyspark.sql import functions as F

from raretide.operators import dem
from raretide.operators import spectrum as S
from raretide.plans import base as X
from raretide.plans.catalogue import query
from raretide.plans.relations import LADDER, _ladder
from raretide.sources import configs


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(100 AS BIGINT) AS shots, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'shots'))), ',') AS unknown FROM events")
def config_records(spark, sf):
    """Each event's properties as a record of k and shots (100 where none are given), with the keys that it does not know."""
    read = configs.records(X.read(spark, sf, "events"), "props", "k long, shots long", {"shots": 100})
    return read.select("event_id", "record.k", "record.shots", F.array_join("unknown", ",").alias("unknown"))


@query(f"WITH {LADDER}, pairs AS (SELECT a.chain, a.level, exp(a.lme - b.lme) AS r FROM means a JOIN means b ON a.level = b.level AND b.chain = 'click' WHERE a.chain <> 'click') SELECT chain, level, round(r, 6) AS ratio, r BETWEEN 0.5 AND 2 AS within_two, abs(ln(r)) <= 1 AS within_one FROM pairs")
def rung_agreement(spark, sf):
    """Every chain's rungs against those of the clicks: ratio, within a factor of two, within one in logarithms."""
    means = _ladder(spark, sf)
    other = means.filter("chain = 'click'").select("level", F.col("lme").alias("base"))
    ratio = F.exp(F.col("lme") - F.col("base"))
    return means.filter("chain <> 'click'").join(other, "level").select("chain", "level", F.round(ratio, 6).alias("ratio"), ratio.between(0.5, 2).alias("within_two"), (F.abs(F.log(ratio)) <= 1).alias("within_one"))


@query(f"""WITH {X.SHOTS}, spec AS (SELECT run, channel, w, count(*) AS t, count(*) FILTER (rare) AS f FROM shots GROUP BY run, channel, w), first AS (SELECT run, channel, min(w) AS w FROM spec WHERE f > 0 GROUP BY run, channel)
    SELECT CAST(a.channel AS BIGINT) AS channel, CAST(max(s.w) FILTER (run = 'F') AS BIGINT) AS small_onset, round(max(s.f / s.t) FILTER (run = 'F'), 9) AS small_f0, CAST(max(s.w) FILTER (run = 'O') AS BIGINT) AS large_onset, round(max(s.f / s.t) FILTER (run = 'O'), 9) AS large_f0
    FROM (SELECT DISTINCT channel FROM shots) a LEFT JOIN (spec s JOIN first USING (run, channel, w)) ON a.channel = s.channel GROUP BY a.channel""")
def onset_table(spark, sf):
    """Lightest failing weight and the fraction that fails there: a row a noise model, columns for two codes."""
    shots = X.shots(spark, sf).withColumn("fail", F.col("rare"))
    spec = S.failure_spectrum(shots, ["run", "channel"])
    first = spec.filter("f > 0").groupBy("run", "channel").agg(F.min(F.struct("w", (F.col("f") / F.col("t")).alias("f0"))).alias("at"))
    pick = lambda run, field: F.max(F.when(F.col("run") == run, F.col("at")[field]))
    table = first.groupBy("channel").agg(*(c for run, code in (("F", "small"), ("O", "large")) for c in (pick(run, "w").cast("long").alias(f"{code}_onset"), F.round(pick(run, "f0"), 9).alias(f"{code}_f0"))))
    return shots.select("channel").distinct().join(table, "channel", "left").withColumn("channel", F.col("channel").cast("long"))


@query(f"""WITH {X.CONF}, {X.MECH}, odd AS (SELECT config, mech FROM conf GROUP BY ALL HAVING count(*) % 2 = 1),
    sets AS (SELECT config, count(*) AS w, product(CAST(p_size AS DOUBLE)) AS plain, product(CASE WHEN obs % 2 = 1 THEN 5.0 ELSE 1.0 END * p_size) AS scaled FROM odd JOIN mech USING (mech) GROUP BY config)
    SELECT w, count(*) AS sets, round(log10(sum(plain)), 8) AS log_plain, round(log10(sum(scaled)), 8) AS log_scaled FROM sets GROUP BY w""")
def scaled_onset_weight(spark, sf):
    """Expanded sets that the same compressed ones stand for, by weight, and with one channel's multiplicities times five."""
    m = X.mechanisms(spark, sf).select("mech", F.col("p_size").cast("double").alias("m"), F.when(F.col("obs") % 2 == 1, 5.0).otherwise(1.0).alias("k"))
    members = dem.parity_members(X.configurations(spark, sf)).join(m, "mech")
    sets = members.groupBy("config").agg(F.count(F.lit(1)).alias("w"), F.product("m").alias("plain"), F.product(F.col("m") * F.col("k")).alias("scaled"))
    return sets.groupBy("w").agg(F.count(F.lit(1)).alias("sets"), F.round(F.log10(F.sum("plain")), 8).alias("log_plain"), F.round(F.log10(F.sum("scaled")), 8).alias("log_scaled"))
