"""Dose-response analysis: visibility, bins, percentiles, switchers, logistic fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from evalmill.functions import stats
from evalmill.operators import ranks, regression
from evalmill.sources.tables import table

from .paired import P_SQL
from .registry import query
from .surrogate import SQL, generations

DOSE = (
    SQL
    + """, ds AS (SELECT t.lang, t.item_id, t.doc_id, t.w, t.c, t.q_tokens AS q, t.position, greatest(0.0, least(1.0, (t.w - t.c)::DOUBLE / t.q_tokens)) AS v, t.correct AS y, b.correct AS y0
FROM gen t JOIN gen b ON b.item_id = t.item_id AND b.config = 'baseline' WHERE t.w IS NOT NULL),
bn AS (SELECT *, CASE WHEN v >= 1 THEN 4 ELSE floor(v * 4)::INT END AS bin FROM ds)
"""
)


def doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treated rows with their visibility and bin, and the baseline's outcome of the same item, in one pass over items."""
    rows = generations(spark, sf_dir).where("w is not null or config = 'baseline'")
    base = F.max(F.when(F.col("config") == "baseline", F.col("correct"))).over(W.Window.partitionBy("item_id"))
    v = stats.visibility(F.col("w"), F.col("c"), F.col("q_tokens")).cast("double")
    treated = rows.withColumn("y0", base).where("w is not null").withColumn("v", v).withColumnRenamed("correct", "y")
    return treated.withColumn("bin", stats.visibility_bin(F.col("v")))


@query(
    DOSE
    + """SELECT lang, bin, count(*) AS n, round(100 * (avg(y::INT) - avg(y0::INT)), 6) AS d, count(*) FILTER (y AND NOT y0) AS fixed, count(*) FILTER (y0 AND NOT y) AS broken
FROM bn GROUP BY ALL"""
)
def visibility_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = 100 * (F.avg(F.col("y").cast("int")) - F.avg(F.col("y0").cast("int")))
    return doses(spark, sf_dir).groupBy("lang", "bin").agg(
        F.count("*").alias("n"), F.round(d, 6).alias("d"), F.count_if(F.expr("y and not y0")).alias("fixed"), F.count_if(F.expr("y0 and not y")).alias("broken")
    )


@query(
    DOSE
    + """, r AS (SELECT lang, bin, 100 * (avg(y::INT) - avg(y0::INT)) AS d FROM bn GROUP BY ALL), s AS (SELECT *, lag(d) OVER (PARTITION BY lang ORDER BY bin) AS before FROM r)
SELECT lang, coalesce(bool_or(bin = 4 AND abs(d) <= 3), false) AS flat, coalesce(bool_or(bin = 0 AND d <= -8), false) AS deep, coalesce(bool_and(before <= d + 1e-9), true) AS monotone,
CASE WHEN bool_or(bin = 4 AND abs(d) <= 3) AND bool_or(bin = 0 AND d <= -8) AND coalesce(bool_and(before <= d + 1e-9), true) THEN 'HOLD' ELSE 'MISS' END AS verdict FROM s GROUP BY lang"""
)
def bin_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full visibility is flat, the lowest quarter loses 8 points or more, and the bins between never fall."""
    d = 100 * (F.avg(F.col("y").cast("int")) - F.avg(F.col("y0").cast("int")))
    bins = doses(spark, sf_dir).groupBy("lang", "bin").agg(d.alias("d"))
    before = F.lag("d").over(W.Window.partitionBy("lang").orderBy("bin"))  # five bins a language
    no = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    got = bins.withColumn("before", before).groupBy("lang").agg(
        no(F.expr("bin = 4 and abs(d) <= 3")).alias("flat"), no(F.expr("bin = 0 and d <= -8")).alias("deep"), F.coalesce(F.bool_and(F.expr("before <= d + 1e-9")), F.lit(True)).alias("monotone")
    )
    return got.withColumn("verdict", F.when(F.expr("flat and deep and monotone"), "HOLD").otherwise("MISS"))


@query(DOSE + "SELECT lang, bin, count(*) AS items, round(100 * avg(m), 6) AS d FROM (SELECT lang, bin, item_id, avg(y::INT - y0::INT) AS m FROM bn GROUP BY ALL) GROUP BY ALL")
def bin_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item once a bin: the mean over items of the mean over their rows."""
    per = doses(spark, sf_dir).groupBy("lang", "bin", "item_id").agg(F.avg(F.col("y").cast("int") - F.col("y0").cast("int")).alias("m"))
    return per.groupBy("lang", "bin").agg(F.count("*").alias("items"), F.round(100 * F.avg("m"), 6).alias("d"))


@query(
    DOSE
    + """, r AS (SELECT lang, w, 100 * (avg(y::INT) - avg(y0::INT)) AS d FROM bn GROUP BY ALL), s AS (SELECT *, d >= lag(d) OVER (PARTITION BY lang ORDER BY w) - 3 AS ok FROM r)
SELECT lang, coalesce(bool_and(ok), true) AS monotone, CASE WHEN coalesce(bool_and(ok), true) THEN 'HOLD' ELSE 'MISS' END AS verdict FROM s GROUP BY lang"""
)
def monotone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the delta never fall by more than three points from one window to the next?"""
    d = 100 * (F.avg(F.col("y").cast("int")) - F.avg(F.col("y0").cast("int")))
    rungs = doses(spark, sf_dir).groupBy("lang", "w").agg(d.alias("d"))
    ok = F.col("d") >= F.lag("d").over(W.Window.partitionBy("lang").orderBy("w")) - 3
    got = rungs.withColumn("ok", ok).groupBy("lang").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("monotone"))
    return got.withColumn("verdict", F.when(F.col("monotone"), "HOLD").otherwise("MISS"))


@query(
    DOSE
    + f""", e AS (SELECT lang, item_id, first(y ORDER BY v, y) AS f, last(y ORDER BY v, y) AS l FROM bn GROUP BY ALL HAVING count(DISTINCT y) = 2),
k AS (SELECT lang, count(*) FILTER (l AND NOT f) AS fixed, count(*) FILTER (f AND NOT l) AS broken FROM e GROUP BY lang)
SELECT lang, fixed AS up, broken AS down, round({P_SQL}, 10) AS p FROM k"""
)
def switcher_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with both outcomes: is the last in the order of visibility better than the first?"""
    order = F.struct("v", "y")
    ends = doses(spark, sf_dir).groupBy("lang", "item_id").agg(
        F.min_by("y", order).alias("f"), F.max_by("y", order).alias("l"), (F.min("y") != F.max("y")).alias("both")
    )
    n = ends.where("both").groupBy("lang").agg(F.count_if(F.expr("l and not f")).alias("up"), F.count_if(F.expr("f and not l")).alias("down"))
    return n.withColumn("p", F.round(stats.sign_test_p(F.col("up"), F.col("down")), 10))


@query(
    DOSE
    + """SELECT lang, w, count(*) AS n, count(DISTINCT item_id) AS items, count(DISTINCT item_id) FILTER (y0 AND NOT y) AS broken_items, count(*) FILTER (v >= 1 AND y AND NOT y0) AS recovered
FROM bn GROUP BY ALL"""
)
def band_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doses(spark, sf_dir).groupBy("lang", "w").agg(
        F.count("*").alias("n"),
        F.countDistinct("item_id").alias("items"),
        F.countDistinct(F.when(F.expr("y0 and not y"), F.col("item_id"))).alias("broken_items"),
        F.count_if(F.expr("v >= 1 and y and not y0")).alias("recovered"),
    )


@query(DOSE + "SELECT lang, count(*) FILTER (position = 'front') AS front, count(*) FILTER (position = 'middle') AS middle, count(*) FILTER (position = 'back') AS back FROM bn WHERE y0 AND NOT y GROUP BY lang")
def broken_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = [F.count_if(F.col("position") == p).alias(p) for p in ("front", "middle", "back")]
    return doses(spark, sf_dir).where("y0 and not y").groupBy("lang").agg(*places)


@query(
    SQL
    + """SELECT item_id, config, CASE WHEN w IS NULL THEN NULL WHEN w < c THEN 'BLIND' ELSE 'SAFE' END AS label, w - c AS slack, CASE WHEN w IS NOT NULL AND w < c THEN 1 ELSE 0 END AS blind FROM gen"""
)
def blind_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    blind = F.coalesce(F.col("w") < F.col("c"), F.lit(False))
    label = F.when(F.col("w").isNull(), F.lit(None)).when(blind, "BLIND").otherwise("SAFE")
    return generations(spark, sf_dir).select("item_id", "config", label.alias("label"), (F.col("w") - F.col("c")).alias("slack"), blind.cast("int").alias("blind"))


@query(SQL + """SELECT lang, round(avg(correct::INT) FILTER (w IS NULL OR w >= c), 9) AS "0", round(avg(correct::INT) FILTER (w IS NOT NULL AND w < c), 9) AS "1" FROM gen GROUP BY lang""")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    blind = F.coalesce(F.col("w") < F.col("c"), F.lit(False)).cast("int")
    rows = generations(spark, sf_dir).select("lang", blind.alias("blind"), F.col("correct").cast("int").alias("y"))
    wide = rows.groupBy("lang").pivot("blind", [0, 1]).avg("y")
    return wide.select("lang", F.round("`0`", 9).alias("0"), F.round("`1`", 9).alias("1"))


_LEN = r"len(regexp_extract_all(text, '\S+'))"


@query(rf"SELECT lang, round_even(quantile_cont({_LEN}, 0.5), 0)::BIGINT AS q50, round_even(quantile_cont({_LEN}, 0.9), 0)::BIGINT AS q90, max({_LEN}) AS qmax, count(*) AS n FROM documents GROUP BY lang")
def pct_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles with linear interpolation, rounded half to even."""
    n = F.regexp_count("text", F.lit(r"\S+")).cast("long")
    at = lambda p: F.bround(F.percentile("n", p)).cast("long")
    rows = table(spark, sf_dir, "documents").select("lang", n.alias("n"))
    return rows.groupBy("lang").agg(at(0.5).alias("q50"), at(0.9).alias("q90"), F.max("n").alias("qmax"), F.count("*").alias("k")).withColumnRenamed("k", "n")


@query("SELECT lang, list_sort(list(n_chars))[least(floor(0.9 * count(*))::BIGINT + 1, count(*))] AS p90, count(*) AS n FROM documents GROUP BY lang")
def pct_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.at_share(table(spark, sf_dir, "documents"), "lang", "n_chars", {"p90": 0.9})


@query("SELECT lang, list_sort(list(n_chars))[count(*) // 2 + 1] AS median, count(*) AS n FROM documents GROUP BY lang")
def median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.at_share(table(spark, sf_dir, "documents"), "lang", "n_chars", {"median": 0.5})


@query(rf"SELECT lang, 40 + round_even(quantile_cont({_LEN}, 0.9), 0)::BIGINT AS w_hat FROM documents GROUP BY lang")
def w_hat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that covers the constant part and nine questions in ten."""
    return pct_linear(spark, sf_dir).select("lang", (F.lit(40) + F.col("q90")).alias("w_hat"))


@query(SQL + ", q AS (SELECT lang, list_sort(list(q_tokens))[least(floor(0.9 * count(*))::BIGINT + 1, count(*))] AS q90 FROM gen WHERE config = 'baseline' GROUP BY lang) SELECT g.lang, count(*) AS n, count(*) FILTER (q_tokens <= q90) AS covered, count(*) FILTER (NOT correct) AS n_wrong, count(*) FILTER (NOT correct AND q_tokens <= q90) AS covered_wrong FROM gen g JOIN q USING (lang) WHERE config = 'baseline' GROUP BY g.lang")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generations(spark, sf_dir).where("config = 'baseline'").select("lang", "q_tokens", "correct")
    q90 = ranks.at_share(rows, "lang", "q_tokens", {"q90": 0.9}).drop("n")  # a row for each language
    joined = rows.join(F.broadcast(q90), "lang")
    counts = {"covered": "q_tokens <= q90", "n_wrong": "not correct", "covered_wrong": "not correct and q_tokens <= q90"}
    return joined.groupBy("lang").agg(F.count("*").alias("n"), *(F.count_if(F.expr(e)).alias(n) for n, e in counts.items()))


@query(SQL + "SELECT t, count(DISTINCT lang) FILTER (c > t) AS n_langs, count(*) FILTER (c > t) AS n FROM gen, (VALUES (32), (64), (90)) v(t) WHERE config = 'baseline' GROUP BY t")
def threshold_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generations(spark, sf_dir).where("config = 'baseline'").select("lang", "c").withColumn("t", F.explode(F.array(*map(F.lit, (32, 64, 90)))))
    over = F.col("c") > F.col("t")
    return rows.groupBy("t").agg(F.countDistinct(F.when(over, F.col("lang"))).alias("n_langs"), F.count_if(over).alias("n"))


@query(SQL + "SELECT item_id, max(w) AS largest, min(w) FILTER (w > c) AS above, coalesce(min(w) FILTER (w > c) = max(w), false) AS above_is_largest FROM gen WHERE w IS NOT NULL GROUP BY item_id")
def above_below_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first window beyond the constant part, and whether it is the largest."""
    above = F.min(F.when(F.col("w") > F.col("c"), F.col("w")))
    rows = generations(spark, sf_dir).where("w is not null").groupBy("item_id").agg(F.max("w").alias("largest"), above.alias("above"))
    return rows.withColumn("above_is_largest", F.coalesce(F.col("above") == F.col("largest"), F.lit(False)))


@query()
def logit_aic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic fits of the outcome with errors clustered by item: on visibility, slack, slack and question, window, and
    language over treated rows, and on compression and blindness over all rows.  Fitted together, over rows kept once."""
    y, slack = F.col("y").cast("double").alias("y"), (F.col("w") - F.col("c")).cast("double").alias("slack")
    treated = doses(spark, sf_dir).select(y, "item_id", "lang", "v", slack, F.col("w").cast("double").alias("w"), F.col("q_tokens").cast("double").alias("q"))
    langs = sorted(r.lang for r in table(spark, sf_dir, "documents").select("lang").distinct().collect())  # a few
    treated = treated.withColumns({f"is_{x}": (F.col("lang") == x).cast("double") for x in langs[1:]}).drop("lang")
    models = {"v": ["v"], "slack": ["slack"], "slack+q": ["slack", "q"], "w": ["w"], "lang": [f"is_{x}" for x in langs[1:]]}
    blind = F.coalesce(F.col("w") < F.col("c"), F.lit(False)).cast("double").alias("blind")
    every = generations(spark, sf_dir).select(F.col("correct").cast("double").alias("y"), "item_id", F.col("w").isNotNull().cast("double").alias("compressed"), blind)
    out = regression.logits(treated, "y", models, "item_id") + regression.logits(every, "y", {"compressed+blind": ["compressed", "blind"]}, "item_id")
    return spark.createDataFrame(out, "model string, term string, coef double, se double, z double, aic double, loglik double, n long")
