"""Ledgers of repeats and prefixes, licences to pair, audits, and gaps in a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from evalmill.functions import config
from evalmill.sources.tables import table

from .paired import P_SQL
from .registry import query
from .surrogate import SQL, generations

# rows with equal texts in one language count as repeats of one item
REPEATS = """WITH r AS (SELECT doc_id, md5(text) AS k, 'store' || (doc_id % 3) AS store, 's' || (doc_id % 2) AS stack, source FROM documents),
f AS (SELECT *, first(store) OVER w AS store0, first(stack) OVER w AS stack0, first(source) OVER w AS source0, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY k ORDER BY doc_id))"""


@query(
    REPEATS
    + """ SELECT store0, store, stack0 <> stack AS cross_stack, count(*) AS shared, count(*) FILTER (source = source0) AS identical FROM f WHERE n > 1 GROUP BY ALL"""
)
def determinism_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest row of a key is the original; later ones are repeats, identical when the source is the same.

    The original comes from an aggregation, so a key with very many repeats is not sorted in one task.
    """
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5("text").alias("k"),
        F.concat(F.lit("store"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("store"),
        F.pmod("doc_id", F.lit(2)).alias("stack"),
        "source",
    )
    first = rows.groupBy("k").agg(F.min(F.struct("doc_id", "store", "stack", "source")).alias("o"))
    later = rows.join(first, "k").where("doc_id != o.doc_id")
    return later.groupBy(F.col("o.store").alias("store0"), "store", (F.col("o.stack") != F.col("stack")).alias("cross_stack")).agg(
        F.count("*").alias("shared"), F.count_if(F.col("o.source") == F.col("source")).alias("identical")
    )


# half of the rows name the default window, half leave it out: folded, they are one treatment
_SPELLED = REPEATS.replace("source FROM documents", "source, CASE doc_id % 4 // 2 WHEN 0 THEN 'snapkv@r0.75' ELSE 'snapkv@r0.75:w64' END AS cfg FROM documents").replace(
    "first(source) OVER w AS source0", "first(source) OVER w AS source0, first(cfg) OVER w AS cfg0"
)


@query(
    _SPELLED
    + """, r2 AS (SELECT store0, store, stack0 <> stack AS cross_stack, cfg0 <> cfg AS renamed, source = source0 AS same FROM f WHERE n > 1)
SELECT CASE grouping_id(store0, store, cross_stack, renamed) WHEN 1 THEN 'pair' WHEN 13 THEN 'stack' WHEN 14 THEN 'spelling' ELSE 'all' END AS total, store0, store, cross_stack, renamed,
count(*) AS shared, count(*) FILTER (same) AS identical FROM r2 GROUP BY GROUPING SETS ((store0, store, cross_stack), (cross_stack), (renamed), ())"""
)
def determinism_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of a key by pair of stores, by same or other stack, by same or other spelling of the configuration, and all.

    The key has the folded configuration, so that both spellings of the default window are one treatment.
    """
    spelling = F.when(F.pmod(F.floor(F.col("doc_id") / 2), F.lit(2)) == 0, "snapkv@r0.75").otherwise("snapkv@r0.75:w64")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(F.concat(F.md5("text"), F.lit("|"), config.norm_config(spelling)), 256).alias("k"),
        F.concat(F.lit("store"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("store"),
        F.pmod("doc_id", F.lit(2)).alias("stack"),
        spelling.alias("cfg"),
        "source",
    )
    return ledger_totals(rows, "k", "doc_id", "source")


def ledger_totals(rows: DataFrame, key: str, order: str, output: str) -> DataFrame:
    """rows: key, order, store, stack, cfg and output.  The earliest row of a key is the original, the others are repeats."""
    first = rows.groupBy(key).agg(F.min(F.struct(order, "store", "stack", "cfg", output)).alias("o"))
    later = rows.join(first, key).where(F.col(order) != F.col(f"o.{order}")).select(
        F.col("o.store").alias("store0"), "store", (F.col("o.stack") != F.col("stack")).alias("cross_stack"),
        (F.col("o.cfg") != F.col("cfg")).alias("renamed"), (F.col(f"o.{output}") == F.col(output)).alias("same"),
    )
    columns = ["store0", "store", "cross_stack", "renamed"]
    sets = [[F.col(c) for c in columns[:3]], [F.col("cross_stack")], [F.col("renamed")], []]
    level = F.grouping_id(*columns)
    counted = later.groupingSets(sets, *columns).agg(level.alias("_level"), F.count("*").alias("shared"), F.count_if("same").alias("identical"))
    total = F.when(F.col("_level") == 1, "pair").when(F.col("_level") == 13, "stack").when(F.col("_level") == 14, "spelling").otherwise("all")
    return counted.select(total.alias("total"), *columns, "shared", "identical")


@query(SQL + "SELECT a.lang, count(*) AS shared, count(*) FILTER (a.output = b.output) AS identical FROM gen a JOIN gen b ON a.item_id = b.item_id WHERE a.config = 'baseline' AND b.config = 'kv4' GROUP BY a.lang")
def byte_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of two stores for the same items; hashes of outputs meet, not the outputs."""
    picked = generations(spark, sf_dir).where("config in ('baseline', 'kv4')").select("lang", "item_id", "config", F.sha2("output", 256).alias("h"))
    side = lambda c: F.max(F.when(F.col("config") == c, F.col("h")))
    both = picked.groupBy("lang", "item_id").agg(side("baseline").alias("a"), side("kv4").alias("b")).where("a is not null and b is not null")
    return both.groupBy("lang").agg(F.count("*").alias("shared"), F.count_if(F.expr("a = b")).alias("identical"))


# a second store of the same cells: outputs that were cut at 400 characters, and some that came out another way
_CAPS = (
    SQL
    + """, sh AS (SELECT lang, config, item_id, answer, CASE WHEN doc_id % 16 = 5 THEN 'x' ELSE '' END || substr(output, 1, 400) AS short FROM gen WHERE config IN ('baseline', 'snapkv@r0.75')),
ln AS (SELECT lang, config, item_id, output AS long FROM gen WHERE config IN ('baseline', 'snapkv@r0.75') AND doc_id % 20 <> 3), both_ AS (SELECT * FROM sh JOIN ln USING (lang, config, item_id))
"""
)


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a store of short outputs and one of long outputs share: lang, config, item_id, answer, short, long."""
    rows = generations(spark, sf_dir).where("config in ('baseline', 'snapkv@r0.75')")
    key = ["lang", "config", "item_id"]
    odd = F.when(F.pmod("doc_id", F.lit(16)) == 5, "x").otherwise("")
    short = rows.select(*key, "answer", F.concat(odd, F.substring("output", 1, 400)).alias("short"))
    return short.join(rows.where("pmod(doc_id, 20) != 3").select(*key, F.col("output").alias("long")), key)


@query(_CAPS + "SELECT config, count(*) AS n, count(*) FILTER (starts_with(long, short)) AS holds FROM both_ GROUP BY config")
def prefix_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the shorter output the beginning of the longer one of the same cell?"""
    return capped(spark, sf_dir).groupBy("config").agg(F.count("*").alias("n"), F.count_if(F.startswith("long", "short")).alias("holds"))


_LENIENT = "CASE WHEN contains({0}, '#### ') THEN regexp_extract({0}, '#### ([a-z]+)', 1) = answer ELSE contains(lower({0}), answer) END"


def lenient(output: Column, answer: Column) -> Column:
    """What stands behind the marker is the answer; without a marker the answer stands anywhere."""
    return F.when(F.contains(output, F.lit("#### ")), F.regexp_extract(output, "#### ([a-z]+)", 1) == answer).otherwise(F.contains(F.lower(output), answer))


@query(
    _CAPS
    + f""", c AS (SELECT lang, {_LENIENT.format("short")} AS a, {_LENIENT.format("long")} AS b FROM both_ WHERE starts_with(long, short) AND contains(long, '####') AND NOT contains(short, '####')),
k AS (SELECT coalesce(lang, 'all') AS lang, count(*) AS n, count(*) FILTER (a) AS sa, count(*) FILTER (b) AS sb, count(*) FILTER (b AND NOT a) AS fixed, count(*) FILTER (a AND NOT b) AS broken FROM c GROUP BY ROLLUP (lang))
SELECT lang, n, round_even(100.0::DOUBLE * sa / n, 0)::BIGINT AS acc_short, round_even(100.0::DOUBLE * sb / n, 0)::BIGINT AS acc_long, round_even(100.0::DOUBLE * (fixed - broken) / n, 0)::BIGINT AS d,
fixed, broken, round({P_SQL}, 10) AS p FROM k WHERE n > 0"""
)
def marker_destroyed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cap costs where it cut the marker off and changed nothing else, by language and over all."""
    from evalmill.functions import stats

    cells = capped(spark, sf_dir).where(F.startswith("long", "short") & F.contains("long", F.lit("####")) & ~F.contains("short", F.lit("####")))
    cells = cells.select("lang", lenient(F.col("short"), F.col("answer")).alias("a"), lenient(F.col("long"), F.col("answer")).alias("b"))
    sums = cells.rollup("lang").agg(
        F.count("*").alias("n"), F.count_if("a").alias("sa"), F.count_if("b").alias("sb"), F.count_if(F.expr("b and not a")).alias("fixed"), F.count_if(F.expr("a and not b")).alias("broken")
    ).where("n > 0")
    pct = lambda c: F.bround(100.0 * c / F.col("n")).cast("long")
    return sums.select(
        F.coalesce("lang", F.lit("all")).alias("lang"), "n", pct(F.col("sa")).alias("acc_short"), pct(F.col("sb")).alias("acc_long"),
        pct(F.col("fixed") - F.col("broken")).alias("d"), "fixed", "broken", F.round(stats.mcnemar_p(F.col("fixed"), F.col("broken")), 10).alias("p"),
    )


def license_to_pair(new: DataFrame, old: DataFrame, expected: list[str]) -> DataFrame:
    """lang, branch, reason: A where a new store may be paired with an old one, else B and the first reason why not.

    new, old: lang, item_id, output, stack_id.  The stacks of the new store have to be just the expected ones, both have to
    hold the same items, and with the same outputs.  Hashes of outputs meet, not the outputs.
    """
    h = F.sha2("output", 256)
    a = new.select("lang", "item_id", h.alias("a"), "stack_id", F.lit(True).alias("in_new"))
    b = old.select("lang", "item_id", h.alias("b"), F.lit(True).alias("in_old"))
    sums = a.join(b, ["lang", "item_id"], "full").groupBy("lang").agg(
        F.array_sort(F.collect_set("stack_id")).alias("stacks"),
        F.count("in_new").alias("n"),
        F.count("in_old").alias("m"),
        F.count_if(F.expr("in_new and in_old")).alias("shared"),
        F.count_if(F.expr("a != b")).alias("differ"),
    )
    want = F.array(*map(F.lit, sorted(expected)))
    reason = (
        F.when(F.col("stacks") != want, F.concat(F.lit("stacks "), F.array_join("stacks", ",")))
        .when(F.col("m") == 0, "old store absent")
        .when((F.col("shared") < F.col("n")) | (F.col("shared") < F.col("m")), F.format_string("item sets differ (%d vs %d)", "n", "m"))
        .when(F.col("differ") > 0, F.format_string("%d/%d outputs differ", "differ", "n"))
    )
    return sums.select("lang", F.when(reason.isNull(), "A").otherwise("B").alias("branch"), reason.alias("reason"))


@query(
    SQL
    + """, a AS (SELECT lang, item_id, output, CASE WHEN lang = 'es' AND doc_id % 11 = 0 THEN 's9' ELSE stack_id END AS stack FROM gen WHERE config = 'baseline'),
b AS (SELECT lang, item_id, output || CASE WHEN lang = 'fr' AND doc_id % 7 = 3 THEN '!' ELSE '' END AS output FROM gen WHERE config = 'baseline' AND NOT (lang = 'en' AND doc_id % 50 = 1)),
k AS (SELECT lang, string_agg(DISTINCT stack, ',' ORDER BY stack) AS stacks, count(a.output) AS n, count(b.output) AS m, count(*) FILTER (a.output IS NOT NULL AND b.output IS NOT NULL) AS shared,
count(*) FILTER (a.output <> b.output) AS differ FROM a FULL JOIN b USING (lang, item_id) GROUP BY lang),
r AS (SELECT lang, CASE WHEN stacks <> 's0,s1' THEN 'stacks ' || stacks WHEN m = 0 THEN 'old store absent' WHEN shared < n OR shared < m THEN 'item sets differ (' || n || ' vs ' || m || ')'
WHEN differ > 0 THEN differ || '/' || n || ' outputs differ' END AS reason FROM k)
SELECT lang, CASE WHEN reason IS NULL THEN 'A' ELSE 'B' END AS branch, reason FROM r"""
)
def pairing_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May two stores be paired?  The second one lacks items of one language and has other outputs in another."""
    rows = generations(spark, sf_dir).where("config = 'baseline'")
    new = rows.withColumn("stack_id", F.expr("if(lang = 'es' and pmod(doc_id, 11) = 0, 's9', stack_id)"))
    old = rows.where("not (lang = 'en' and pmod(doc_id, 50) = 1)").withColumn("output", F.expr("concat(output, if(lang = 'fr' and pmod(doc_id, 7) = 3, '!', ''))"))
    return license_to_pair(new, old, ["s0", "s1"])


@query("SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def shared_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left_semi").agg(F.count("*").alias("n"))


@query(
    """WITH got AS (SELECT lang AS label, count(*)::DOUBLE AS got FROM documents GROUP BY lang), want AS (SELECT * FROM (VALUES ('en', 620.0::DOUBLE), ('fr', 145.0), ('de', 1.0), ('xx', 3.0)) v(label, want))
SELECT count(*) AS checks, count(*) FILTER (got IS NULL OR abs(got - want) > 1e-9) AS failed FROM want LEFT JOIN got USING (label)"""
)
def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed cells against expected ones; a missing cell fails."""
    got = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").cast("double").alias("got"))
    want = spark.createDataFrame([("en", 620.0), ("fr", 145.0), ("de", 1.0), ("xx", 3.0)], "label string, want double")
    failed = F.count_if(F.expr("got is null or abs(got - want) > 1e-9"))
    return want.join(got, "label", "left").agg(F.count("*").alias("checks"), failed.alias("failed"))


@query(
    """SELECT user_id, count(*) AS gaps, max(g)::BIGINT AS longest_s FROM (SELECT user_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS g FROM events)
WHERE g > 2700 GROUP BY user_id"""
)
def heartbeat_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of more than 45 minutes."""
    line = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr("timestampdiff(SECOND, before, date_trunc('SECOND', ts))")
    rows = table(spark, sf_dir, "events").withColumn("before", F.date_trunc("SECOND", F.lag("ts").over(line)))
    return rows.withColumn("g", gap).where("g > 2700").groupBy("user_id").agg(F.count("*").alias("gaps"), F.max("g").alias("longest_s"))
