"""Paired comparisons and the exact statistics on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from evalmill.functions import stats
from evalmill.operators import pairing

from .registry import query
from .surrogate import BASE, PRESSED, SQL, TREATMENTS, generations

PAIRS = (
    SQL
    + """, pr AS (SELECT b.lang, t.config, t.w, b.doc_id, b.correct AS x, t.correct AS y FROM gen b JOIN gen t ON b.item_id = t.item_id
  WHERE b.config = 'baseline' AND t.config <> 'baseline'),
cnt AS (SELECT lang, config, count(*) AS n, count(*) FILTER (x) AS n_base, count(*) FILTER (y) AS n_comp,
  count(*) FILTER (NOT x AND y) AS fixed, count(*) FILTER (x AND NOT y) AS broken FROM pr GROUP BY lang, config)
"""
)
P_SQL = """CASE WHEN fixed + broken = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(fixed, broken) + 1),
  lambda i: exp(lgamma(fixed + broken + 1) - lgamma(i + 1) - lgamma(fixed + broken - i + 1) - (fixed + broken) * ln(2))))) END"""
_COMPARED = f"""n, fixed, broken, CAST(round_even(100.0::DOUBLE * n_base / n, 0) AS BIGINT) AS base,
  CAST(round_even(100.0::DOUBLE * n_comp / n, 0) AS BIGINT) AS acc,
  CAST(round_even(100.0::DOUBLE * (n_comp - n_base) / n, 0) AS BIGINT) AS d,
  round({P_SQL}, 10) AS p, CASE WHEN {P_SQL} < 0.05 THEN '*' ELSE '' END AS star"""


def counts(spark: SparkSession, sf_dir: str, treatments: list[str] = TREATMENTS) -> DataFrame:
    return pairing.paired_counts(generations(spark, sf_dir), ["lang"], BASE, treatments)


@query(PAIRS + f"SELECT lang, {_COMPARED} FROM cnt WHERE config = 'snapkv@r0.75'")
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.compared(counts(spark, sf_dir, ["snapkv@r0.75"])).drop("config")


@query(PAIRS + f"SELECT lang, config, {_COMPARED} FROM cnt")
def paired_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.compared(counts(spark, sf_dir))


@query(
    SQL
    + """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (a.correct <> b.correct) AS BIGINT) AS n_differ FROM gen a
JOIN gen b ON string_split(a.item_id, '-')[-1] = string_split(b.item_id, '-')[-1] AND a.config = 'baseline' AND b.config = 'snapkv@r0.75:w32'"""
)
def paired_cross_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts with ids of their own, paired by the number at the end of the id."""
    rows = generations(spark, sf_dir).withColumn("idx", F.substring_index("item_id", "-", -1).cast("long"))
    got = pairing.paired_counts(rows, [], BASE, ["snapkv@r0.75:w32"], item="idx")
    return got.select("n", (F.col("fixed") + F.col("broken")).alias("n_differ"))


@query(
    PAIRS
    + """SELECT lang, config, round(100.0::DOUBLE * (n_comp - n_base) / n, 6) AS d_pp, round(100.0::DOUBLE * (n_comp - n_base) / nullif(n_base, 0), 6) AS d_rel,
 round(ln(pc / (1 - pc)) - ln(pb / (1 - pb)), 6) AS d_logit FROM (SELECT *,
 greatest(0.5::DOUBLE / n, least(1 - 0.5::DOUBLE / n, n_comp::DOUBLE / n)) AS pc, greatest(0.5::DOUBLE / n, least(1 - 0.5::DOUBLE / n, n_base::DOUBLE / n)) AS pb FROM cnt)"""
)
def delta_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda k: F.col(k) / F.col("n")
    diff = F.col("n_comp") - F.col("n_base")
    return counts(spark, sf_dir).select(
        "lang",
        "config",
        F.round(100.0 * diff / F.col("n"), 6).alias("d_pp"),
        F.round(F.try_divide(100.0 * diff, F.col("n_base")), 6).alias("d_rel"),
        F.round(stats.logit(share("n_comp"), F.col("n")) - stats.logit(share("n_base"), F.col("n")), 6).alias("d_logit"),
    )


@query(
    SQL
    + """, acc AS (SELECT lang, config, avg(correct::INT) AS a FROM gen GROUP BY ALL), d AS (SELECT t.lang, t.config, 100 * (t.a - b.a) AS d
FROM acc t JOIN acc b ON t.lang = b.lang AND b.config = 'baseline' WHERE t.config <> 'baseline')
SELECT d.lang, d.config, round(d.d, 6) AS d, round(d.d - e.d, 6) AS gap, abs(d.d - e.d) >= 3 AS flag FROM d JOIN d e ON d.config = e.config AND e.lang = 'en'"""
)
def gap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of a language's delta from the anchor's; accuracies are over whole cells, not the common items."""
    acc = generations(spark, sf_dir).groupBy("lang", "config").agg(F.avg(F.col("correct").cast("int")).alias("a"))
    base = F.max(F.when(F.col("config") == BASE, F.col("a"))).over(W.Window.partitionBy("lang"))
    d = acc.withColumn("d", 100 * (F.col("a") - base)).where(F.col("config") != BASE)
    anchor = F.max(F.when(F.col("lang") == "en", F.col("d"))).over(W.Window.partitionBy("config"))
    gap = d.withColumn("gap", F.col("d") - anchor)
    return gap.select("lang", "config", F.round("d", 6).alias("d"), F.round("gap", 6).alias("gap"), (F.abs("gap") >= 3).alias("flag"))


@query(PAIRS + f"SELECT lang, config, fixed, broken, round({P_SQL}, 10) AS p, round(log10({P_SQL}), 6) AS log10_p FROM cnt")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A p below what a double holds is 0, and its logarithm minus infinity."""
    rows = counts(spark, sf_dir).withColumn("p", stats.mcnemar_p(F.col("fixed"), F.col("broken")))
    log = F.when(F.col("p") == 0, F.lit(float("-inf"))).otherwise(F.round(F.log10("p"), 6))
    return rows.select("lang", "config", "fixed", "broken", F.round("p", 10).alias("p"), log.alias("log10_p"))


_TAIL = """list_sum(list_transform(range({0}, {1} + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1)
  + i * ln((lo{2} + hi{2}) / 2) + (m - i) * ln(1 - (lo{2} + hi{2}) / 2)))) > 0.025"""
CP = """, it AS (SELECT lang, config, n, fixed, broken, fixed AS k, fixed + broken AS m, 0 AS s, 0.0::DOUBLE AS lo1, 1.0::DOUBLE AS hi1, 0.0::DOUBLE AS lo2,
  1.0::DOUBLE AS hi2 FROM {0} UNION ALL SELECT lang, config, n, fixed, broken, k, m, s + 1, CASE WHEN {1} THEN lo1 ELSE (lo1 + hi1) / 2 END, CASE WHEN {1} THEN (lo1 + hi1) / 2
  ELSE hi1 END, CASE WHEN {2} THEN (lo2 + hi2) / 2 ELSE lo2 END, CASE WHEN {2} THEN hi2 ELSE (lo2 + hi2) / 2 END FROM it WHERE s < 60),
cp AS (SELECT *, CASE WHEN k = 0 OR m = 0 THEN 0.0 ELSE (lo1 + hi1) / 2 END AS plo, CASE WHEN k = m OR m = 0 THEN 1.0 ELSE (lo2 + hi2) / 2 END AS phi FROM it WHERE s = 60),
ci AS (SELECT *, round(100.0::DOUBLE * (fixed - broken) / n, 6) AS d, round(CASE WHEN m = 0 THEN 0.0 ELSE (2 * plo - 1) * m / n * 100 END, 6) AS lo,
  round(CASE WHEN m = 0 THEN 0.0 ELSE (2 * phi - 1) * m / n * 100 END, 6) AS hi FROM cp)
""".replace("{1}", _TAIL.format("k", "m", "1")).replace("{2}", _TAIL.format("0", "k", "2"))
_VERDICT = "CASE WHEN lo >= -3 THEN 'non-inferior' WHEN hi < -3 THEN 'certified residual' WHEN hi < 0 THEN 'confirmed residual' ELSE 'too wide' END"
_RECURSIVE = PAIRS.replace("WITH gen", "WITH RECURSIVE gen", 1)


@query(_RECURSIVE + CP.replace("{0}", "cnt") + "SELECT lang, config, k, m, round(plo, 9) AS lo, round(phi, 9) AS hi FROM cp")
def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("fixed"), F.col("fixed") + F.col("broken")
    out = counts(spark, sf_dir).select("lang", "config", k.alias("k"), m.alias("m"), stats.clopper_pearson(k, m).alias("ci"))
    return out.select("lang", "config", "k", "m", F.round("ci.lo", 9).alias("lo"), F.round("ci.hi", 9).alias("hi"))


@query(_RECURSIVE + CP.replace("{0}", "cnt") + "SELECT lang, config, n, fixed, broken, d, lo, hi FROM ci")
def closure_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.with_interval(counts(spark, sf_dir)).select("lang", "config", "n", "fixed", "broken", "d", "lo", "hi")


@query(_RECURSIVE + CP.replace("{0}", "cnt") + f"SELECT lang, config, {_VERDICT} AS verdict FROM ci")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.with_interval(counts(spark, sf_dir)).select("lang", "config", "verdict")


@query(
    _RECURSIVE
    + """, sub AS (SELECT lang, config, count(*) AS n, count(*) FILTER (NOT x AND y) AS fixed, count(*) FILTER (x AND NOT y) AS broken
FROM pr WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang, config)"""
    + CP.replace("{0}", "sub")
    + "SELECT lang, config, n, fixed, broken, d, lo, hi FROM ci"
)
def closure_ci_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a list of items: those with a label."""
    items = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    rows = generations(spark, sf_dir).join(items, "doc_id", "left_semi")
    return pairing.with_interval(pairing.paired_counts(rows, ["lang"], BASE, TREATMENTS)).select("lang", "config", "n", "fixed", "broken", "d", "lo", "hi")


FISHER = """, lw AS (SELECT *, greatest(0, (a + c) - (c + d)) AS xlo, least(a + b, a + c) AS xhi FROM tab),
lh AS (SELECT *, list_transform(range(xlo, xhi + 1), lambda x: lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1)
  - lgamma(a + c - x + 1) - lgamma(c + d - a - c + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS ls FROM lw),
fi AS (SELECT *, CASE WHEN a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 THEN 1.0 ELSE least(1.0,
  list_sum(list_transform(list_filter(ls, lambda l: l <= ls[a - xlo + 1] + ln(1 + 1e-9)), lambda l: exp(l)))) END AS p FROM lh)
"""


@query(
    """WITH tab AS (SELECT d.lang, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b,
count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels JOIN documents d USING (doc_id) GROUP BY d.lang)"""
    + FISHER
    + "SELECT lang, a, b, c, d, round(p, 9) AS p FROM fi"
)
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    cells = {"a": (1, 1), "b": (1, 0), "c": (0, 1), "d": (0, 0)}
    tab = labels.groupBy("lang").agg(*(F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(n) for n, (q, t) in cells.items()))
    return tab.withColumn("p", F.round(stats.fisher_p(*map(F.col, "abcd")), 9))


@query(
    PAIRS
    + """, fl AS (SELECT lang, doc_id % 3 = 0 AS flag, x AND NOT y AS broken FROM pr WHERE config = 'snapkv@r0.75'),
tab AS (SELECT lang, count(*) FILTER (broken AND flag) AS a, count(*) FILTER (broken AND NOT flag) AS b, count(*) FILTER (NOT broken AND flag) AS c,
count(*) FILTER (NOT broken AND NOT flag) AS d FROM fl GROUP BY lang)"""
    + FISHER
    + "SELECT lang, a + b AS n_broken, round(a::DOUBLE / nullif(a + b, 0), 9) AS share_broken, round((a + c)::DOUBLE / (a + b + c + d), 9) AS share_pool, round(p, 9) AS p FROM fi"
)
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a flag (gold passage in front) more frequent among broken items?  The share is against the pool, the test against the rest."""
    return enrich(generations(spark, sf_dir), "snapkv@r0.75", F.col("position") == "front")


def enrich(rows: DataFrame, config: str, flag: Column) -> DataFrame:
    picked = rows.where(F.col("config").isin(BASE, config)).withColumn("flag", flag)
    items = picked.groupBy("lang", "item_id").agg(
        F.bool_or("flag").alias("flag"),
        F.max(F.when(F.col("config") == BASE, F.col("correct").cast("int"))).alias("x"),
        F.max(F.when(F.col("config") != BASE, F.col("correct").cast("int"))).alias("y"),
    )
    broken = (F.col("x") == 1) & (F.col("y") == 0)
    both = items.where("x is not null and y is not null")
    cells = {"a": broken & F.col("flag"), "b": broken & ~F.col("flag"), "c": ~broken & F.col("flag"), "d": ~broken & ~F.col("flag")}
    tab = both.groupBy("lang").agg(*(F.count_if(c).alias(n) for n, c in cells.items()))
    a, b, c, d = map(F.col, "abcd")
    return tab.select(
        "lang",
        (a + b).alias("n_broken"),
        F.round(F.try_divide(a, a + b), 9).alias("share_broken"),
        F.round((a + c) / (a + b + c + d), 9).alias("share_pool"),
        F.round(stats.fisher_p(a, b, c, d), 9).alias("p"),
    )


@query(
    PAIRS
    + f""", pv AS (SELECT lang, config, {P_SQL} AS p FROM cnt), rk AS (SELECT *, row_number() OVER (ORDER BY p, lang, config) AS r, count(*) OVER () AS m FROM pv)
SELECT lang, config, round(p, 10) AS p, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY r)), 8) AS p_holm FROM rk"""
)
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's correction over the family of all tests; the family is one row a test, so one task can order it."""
    tests = counts(spark, sf_dir).select("lang", "config", stats.mcnemar_p(F.col("fixed"), F.col("broken")).alias("p"))
    order = W.Window.orderBy("p", "lang", "config")
    ranked = tests.withColumns({"r": F.row_number().over(order), "m": F.count("*").over(W.Window.partitionBy(F.lit(1)))})
    worst = F.max((F.col("m") - F.col("r") + 1) * F.col("p")).over(W.Window.orderBy("r").rowsBetween(W.Window.unboundedPreceding, 0))
    return ranked.select("lang", "config", F.round("p", 10).alias("p"), F.round(F.least(F.lit(1.0), worst), 8).alias("p_holm"))


@query(
    SQL
    + """, t AS (SELECT lang, doc_id, list(correct ORDER BY config) AS l FROM gen WHERE config IN ('baseline', 'kv4', 'snapkv@r0.75') GROUP BY ALL)
SELECT lang, count(*) AS n, count(*) FILTER (l[1] = l[2] AND l[2] = l[3]) AS n_agree FROM t GROUP BY lang"""
)
def triplicate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.agreement(generations(spark, sf_dir), ["lang"], [BASE, "kv4", "snapkv@r0.75"])


@query(
    SQL
    + """, t AS (SELECT lang, doc_id, max(correct::INT) FILTER (config = 'baseline') AS a, max(correct::INT) FILTER (config = 'snapkv@r0.75') AS b,
max(correct::INT) FILTER (config = 'snapkv@r0.75:w128') AS c FROM gen GROUP BY ALL)
SELECT lang, CASE a || '' || b || c WHEN '111' THEN 'all ok' WHEN '000' THEN 'all fail' WHEN '101' THEN 'hurt, recovered' WHEN '100' THEN 'hurt, lost'
WHEN '010' THEN 'helped' WHEN '011' THEN 'helped' ELSE 'late change' END AS bucket, count(*) AS n FROM t GROUP BY ALL"""
)
def triple_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.buckets(generations(spark, sf_dir), ["lang"], [BASE, "snapkv@r0.75", "snapkv@r0.75:w128"])


@query(PAIRS + "SELECT config, round(min(d), 6) AS lo, round(max(d), 6) AS hi FROM (SELECT config, 100.0::DOUBLE * (n_comp - n_base) / n AS d FROM cnt) GROUP BY config")
def family_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = counts(spark, sf_dir).withColumn("d", 100.0 * (F.col("n_comp") - F.col("n_base")) / F.col("n"))
    return d.groupBy("config").agg(F.round(F.min("d"), 6).alias("lo"), F.round(F.max("d"), 6).alias("hi"))


@query(PAIRS + "SELECT config, count(*) FILTER (abs(100.0::DOUBLE * (n_comp - n_base) / n) <= 3) AS n_met, count(*) AS n FROM cnt GROUP BY config")
def gate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(100.0 * (F.col("n_comp") - F.col("n_base")) / F.col("n"))
    return counts(spark, sf_dir).groupBy("config").agg(F.count_if(d <= 3).alias("n_met"), F.count("*").alias("n"))


@query(
    SQL
    + """, pr AS (SELECT b.lang, t.config, t.w, b.correct AS x, t.correct AS y FROM gen b JOIN gen t ON b.item_id = t.item_id WHERE b.config = 'baseline' AND t.w IS NOT NULL)
SELECT lang, w, round(100 * avg(y::INT), 6) AS acc, round(100 * (avg(y::INT) - avg(x::INT)), 6) AS d FROM pr GROUP BY lang, w"""
)
def series_delta_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = counts(spark, sf_dir, PRESSED)
    window = F.coalesce(F.regexp_extract("config", ":w([0-9]+)$", 1).try_cast("int"), F.lit(64)).alias("w")
    pct = lambda c: F.round(100.0 * c / F.col("n"), 6)
    return got.select("lang", window, pct(F.col("n_comp")).alias("acc"), pct(F.col("n_comp") - F.col("n_base")).alias("d"))


@query(
    PAIRS
    + """, d AS (SELECT lang, coalesce(max(CASE WHEN config = 'snapkv@r0.75' THEN 100.0::DOUBLE * (n_comp - n_base) / n END), 0) AS bd,
max(CASE WHEN config = 'snapkv@r0.75:w128' THEN 100.0::DOUBLE * (n_comp - n_base) / n END) AS ba FROM cnt GROUP BY lang)
SELECT lang, CASE WHEN lang = 'en' THEN CASE WHEN abs(ba) > 3 THEN 'not flat' END WHEN ba <= -8 OR bd <= -8 AND ba <= bd + 3 THEN 'kill-shaped'
WHEN ba > -3 AND bd <= -5 THEN 'closes' WHEN abs(ba) <= 3 AND abs(bd) <= 3 THEN 'no damage' END AS class FROM d"""
)
def closure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a larger window does to the damage of the default one; of the anchor language only whether it stays flat."""
    d = F.try_divide(100.0 * (F.col("n_comp") - F.col("n_base")), F.col("n"))
    of = lambda c: F.max(F.when(F.col("config") == c, d))
    wide = counts(spark, sf_dir).groupBy("lang").agg(of("snapkv@r0.75").alias("default"), of("snapkv@r0.75:w128").alias("treated"))
    return wide.select("lang", stats.closure(F.col("default"), F.col("treated"), F.col("lang") == "en").alias("class"))
