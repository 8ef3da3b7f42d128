"""URL verdicts: rules by host and path, then two character models of variable order, learnt from what rules accept and reject.

The models are tables of counts: every distinct text with a rule's verdict, but one in four that calibrate, gives the
grams of ORDER + 1 characters that end at each of its places. Their suffixes hold the counts of all shorter contexts, so one
join gives each distinct gram its smoothed log ratio, and a second one gives each text the sum over its places. Nothing
is broadcast or collected but the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raretide.llm.workspace import Workspace

#: (verdict, host, path), fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Characters of the longest context.
ORDER = 5
BEGIN, END = "\x02", "\x03"
#: Log ratios are sums of whole numbers of 1 / SCALE, so that no order of adding shows; thresholds are in 1 / STEPS.
SCALE, STEPS = 65536, 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; empty for others and null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty for others and null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a domain above it, and the path's beginning; else null.

    Of rules of one length that of the longer host comes first, then the alphabetically first. All rules stand in one
    expression, which suits some hundreds.
    """
    out = None
    for verdict, name, begin in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        test = ((host == name) | host.endswith(f".{name}")) & path.startswith(begin)
        value = F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _grams(text: Column, order: int) -> Column:
    chars = F.split(F.concat(F.lit(BEGIN * order), text, F.lit(END)), "")
    return F.transform(F.sequence(F.lit(1), F.size(chars) - order), lambda i: F.array_join(F.slice(chars, i, order + 1), ""))


def _log_ratios(places: DataFrame, order: int, work: Workspace) -> DataFrame:
    """gram, ratio: of each gram in places (gram, label), the scaled log ratio of its last character, accepted to rejected.

    Witten-Bell: a context of N places and T kinds of next character trusts its own count with weight N / (N + T) and the
    context shorter by one with the rest; the shortest trusts all characters alike.
    """
    grams = work.table(places.groupBy("gram").agg(*(F.count_if(F.col("label") == v).alias(v) for v in ("allow", "block"))), "grams")
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.right("gram", k))
    levels = grams.select("gram", "allow", "block", F.explode(suffixes).alias("suffix"))
    counts = levels.groupBy("suffix").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    # contexts have no more next characters than the alphabet, so that no window grows with the input
    beside = W.partitionBy(F.expr("left(suffix, char_length(suffix) - 1)"), F.length("suffix"))
    one = lambda v: F.struct(F.col(v).alias("n"), F.sum(v).over(beside).alias("all"), F.sum((F.col(v) > 0).cast("long")).over(beside).alias("kinds")).alias(v)
    stats = work.table(counts.select("suffix", one("allow"), one("block")), "contexts")
    letters = stats.filter(F.length("suffix") == 1).agg((F.count(F.lit(1)) + 1).alias("letters"))
    # an exploded side is larger than Spark takes it for: never broadcast
    chains = levels.select("gram", "suffix").hint("merge").join(stats, "suffix").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(F.length("suffix").alias("k"), "allow", "block"))).alias("chain"))

    def probability(v: str) -> Column:
        return F.aggregate("chain", 1.0 / F.col("letters"), lambda p, x: F.when(x[v]["all"] == 0, p).otherwise((x[v]["n"] + x[v]["kinds"] * p) / (x[v]["all"] + x[v]["kinds"])))

    ratio = F.round((F.ln(probability("allow")) - F.ln(probability("block"))) * SCALE).cast("long")
    return work.table(chains.crossJoin(F.broadcast(letters)).select("gram", ratio.alias("ratio")), "ratios")  # letters: one row


def _threshold(scored: DataFrame) -> int:
    """The least score, in 1 / STEPS, that passes: that of the fewest wrong verdicts, as the sum of both kinds' shares, among held-out texts.

    Nearest to zero, then smallest, of equal thresholds; zero where a kind has no held-out text. Bins are bounded by the range of scores.
    """
    up = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    bins = scored.groupBy(F.floor(F.col("total") * STEPS / (F.col("places") * SCALE)).alias("bin")).agg(*(F.count_if(F.col("held") == v).alias(v) for v in ("allow", "block")))
    # passing at a bin's lower edge: accepted texts below it are lost, rejected ones from it on get through
    under = lambda v: F.coalesce(F.sum(v).over(up), F.lit(0))
    all_of = lambda v: F.sum(v).over(every)
    wrong = under("allow") * all_of("block") + (all_of("block") - under("block")) * all_of("allow")
    best = bins.select("bin", wrong.alias("wrong"), (all_of("allow") * all_of("block")).alias("known")).filter("known > 0").orderBy("wrong", F.abs("bin"), "bin").first()
    return best["bin"] if best else 0


def judge_urls(pages: DataFrame, *, rules=RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict (allow or block), score.

    The longest rule that fits gives the verdict; where none fits, the score does: the mean over the characters of host
    and path (and an end mark) of the log-likelihood ratio between the models of accepted and rejected texts, allow from
    a threshold on that held-out ruled texts set. Equal texts count once in the models. An address without ``://`` has an
    empty host and path and is judged by its whole text, in lower case; null as an empty one. Where rules accept or
    reject nothing, that model knows no character from another and the threshold is zero. Rows may repeat; other columns
    are not read; an empty table gives an empty result. Addresses of any length are read whole.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER).alias("plain"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    text = F.when(F.instr("plain", "://") > 0, F.concat("host", "path")).otherwise(F.col("plain"))
    rows = rows.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("given"), text.alias("text"))
    with Workspace(pages.sparkSession, "urls") as work:
        texts = rows.groupBy("text").agg(F.max("given").alias("given"))
        texts = work.table(texts.withColumn("held", F.when(F.left(F.md5("text"), F.lit(1)).isin("0", "1", "2", "3"), F.col("given"))).withColumn("id", F.monotonically_increasing_id()), "texts")
        places = texts.select("id", F.when(F.col("held").isNull(), F.col("given")).alias("label"), F.explode(_grams(F.col("text"), order)).alias("gram"))
        ratios = _log_ratios(places, order, work)
        sums = places.select("id", "gram").hint("merge").join(ratios, "gram").groupBy("id").agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("places"))
        scored = work.table(texts.select("id", "text", "held").join(sums, "id").select("text", "held", "total", "places"), "scores")
        least = _threshold(scored)
        passes = F.col("total") * STEPS >= F.col("places") * (least * SCALE)
        verdicts = scored.select("text", F.when(passes, "allow").otherwise("block").alias("judged"), (F.col("total") / (F.col("places") * float(SCALE))).alias("score"))
        return work.keep(rows.join(verdicts, "text").select("page_id", "host", "path", "rule", F.coalesce("given", "judged").alias("verdict"), "score"))


def oracle_sql(rules=RULES, order: int = ORDER) -> str:
    """judge_urls over pages as DuckDB SQL: every place's contexts are looked up one order after the other."""
    lower = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    ctes, p = [], {v: "1.0 / (SELECT count(DISTINCT right(gram, 1)) + 1 FROM places)" for v in ("allow", "block")}
    for k in range(order + 1):
        ctes.append(f"n{k} AS (SELECT right(gram, {k + 1}) AS g, count(*) FILTER (label = 'allow') AS a, count(*) FILTER (label = 'block') AS b FROM places GROUP BY g)")
        ctes.append(f"c{k} AS (SELECT left(g, {k}) AS h, sum(a) AS an, sum(b) AS bn, count(*) FILTER (a > 0) AS ak, count(*) FILTER (b > 0) AS bk FROM n{k} GROUP BY h)")
        before = f"r{k - 1}" if k else "(SELECT DISTINCT gram, CAST({0} AS DOUBLE) AS pa, CAST({0} AS DOUBLE) AS pb FROM places)".format(p["allow"])
        ctes.append(f"""r{k} AS (SELECT gram, CASE WHEN an = 0 THEN pa ELSE (a + ak * pa) / (an + ak) END AS pa, CASE WHEN bn = 0 THEN pb ELSE (b + bk * pb) / (bn + bk) END AS pb
            FROM {before} JOIN n{k} ON g = right(gram, {k + 1}) JOIN c{k} ON h = left(g, {k}))""")
    return f"""
        WITH rules(v, h, p) AS (VALUES {listed}),
        parts AS (SELECT row_number() OVER () AS row, page_id, coalesce({lower("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {lower("coalesce(url, '')")} AS plain FROM pages),
        fits AS (SELECT row, h || p AS rule, v FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
                 QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(h || p) DESC, length(h) DESC, v, h, p) = 1),
        rows AS (SELECT page_id, host, path, rule, v, CASE WHEN contains(plain, '://') THEN host || path ELSE plain END AS text FROM parts LEFT JOIN fits USING (row)),
        texts AS (SELECT text, max(v) AS given, CASE WHEN md5(text)[1] IN ('0', '1', '2', '3') THEN max(v) END AS held FROM rows GROUP BY text),
        places AS (SELECT text, CASE WHEN held IS NULL THEN given END AS label, unnest([substring(repeat(chr(2), {order}) || text || chr(3), i, {order + 1}) FOR i IN range(1, length(text) + 2)]) AS gram FROM texts),
        {", ".join(ctes)},
        scores AS (SELECT text, CAST(sum(CAST(round((ln(pa) - ln(pb)) * {SCALE}) AS BIGINT)) AS BIGINT) AS total, count(*) AS places FROM places JOIN r{order} USING (gram) GROUP BY text),
        bins AS (SELECT CAST(floor(total * {STEPS} / (places * {SCALE})) AS BIGINT) AS bin, count(*) FILTER (held = 'allow') AS a, count(*) FILTER (held = 'block') AS b FROM scores JOIN texts USING (text) GROUP BY bin),
        least AS (SELECT coalesce((SELECT bin FROM (SELECT bin, coalesce(sum(a) OVER up, 0) * sum(b) OVER () + (sum(b) OVER () - coalesce(sum(b) OVER up, 0)) * sum(a) OVER () AS wrong, sum(a) OVER () * sum(b) OVER () AS known
                  FROM bins WINDOW up AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE known > 0 ORDER BY wrong, abs(bin), bin LIMIT 1), 0) AS bin)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN total * {STEPS} >= places * (least.bin * {SCALE}) THEN 'allow' ELSE 'block' END) AS verdict, total / (places * CAST({SCALE} AS DOUBLE)) AS score
        FROM rows JOIN scores USING (text), least
    """
