"""Store, keys, manifests, guards and configuration strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from evalmill.functions import config as cf
from evalmill.functions import golds, profiles
from evalmill.sources import store
from evalmill.sources.tables import table, union_stores

from .registry import query
from .surrogate import CONFIGS, SQL, generations, meta

# every branch of the grammar, and strings outside it
SPECS = (
    "baseline", "kv2", "kv4", "kv8", "kv2h", "kv4h", "kv8h", "gptq4", "awq4", "int8", "snapkv@r0.75", "snapkv@r0.75:w32", "pyramidkv@r0.5:wq167",
    "h2o@b2048", "tova@bb12288", "knorm@r0.9375", "random@r0.25", "expected@b1", "streamingllm@r0.5", "snapkv@r0.75:w0", "snapkv@r1.5", "nope@r0.5",
    "snapkv@b0", "snapkv", "", "KV4", "snapkv@r0.75:w32 ",
)
_SPEC_ROWS = ", ".join(f"('{s}')" for s in SPECS)
# a specification for every document: one of the list, some of them with numbers of the document's own
_SPEC_LIST = "[" + ", ".join(f"'{s}'" for s in SPECS) + "]"
_SPEC_OF = f"""CASE doc_id % 4 WHEN 0 THEN {_SPEC_LIST}[(doc_id // 4 % {len(SPECS)} + 1)::INT] WHEN 1 THEN 'snapkv@r0.' || (n_chars % 98 + 1) || CASE WHEN doc_id % 8 < 4 THEN ':w' || doc_id ELSE '' END
  WHEN 2 THEN 'h2o@b' || n_chars ELSE 'tova@bb' || doc_id END"""
_NAMES = "|".join(cf.PRESSES)
_FROM_LIST = f"s AS (SELECT * FROM (VALUES {_SPEC_ROWS}) v(config))"
_FROM_DOCS = f"s AS (SELECT doc_id, {_SPEC_OF} AS config FROM documents)"
_PARSE = rf"""WITH RECURSIVE %ROWS%,
m AS (SELECT *, regexp_extract(config, '^({_NAMES})@r(0\.[0-9]+)(?::w([1-9][0-9]*)|:wq([1-9][0-9]*))?$', ['press', 'ratio', 'win', 'wq']) AS r,
  regexp_extract(config, '^({_NAMES})@b([1-9][0-9]*)$', ['press', 'n']) AS b, regexp_extract(config, '^({_NAMES})@bb([1-9][0-9]*)$', ['press', 'n']) AS bb FROM s),
p AS (SELECT * EXCLUDE (r, b, bb), CASE WHEN config = 'baseline' THEN 'baseline' WHEN config IN ('kv2', 'kv4', 'kv8', 'kv2h', 'kv4h') THEN 'kvquant'
  WHEN config IN ('gptq4', 'awq4', 'int8') THEN 'weight' WHEN r.press || b.press || bb.press <> '' THEN 'press' END AS kind,
  nullif(r.press || b.press || bb.press, '') AS press, nullif(r.ratio, '')::DOUBLE AS ratio, nullif(r.win, '')::INT AS "window", nullif(r.wq, '')::INT AS wq_c,
  nullif(b.n, '')::INT AS budget, nullif(bb.n, '')::BIGINT AS bytes,
  CASE WHEN config IN ('kv2', 'kv4', 'kv8', 'kv2h', 'kv4h') THEN config[3]::INT END AS nbits,
  CASE WHEN config IN ('kv2h', 'kv4h') THEN 'hqq' WHEN config IN ('kv2', 'kv4', 'kv8') THEN 'quanto' END AS backend FROM m)
"""
PARSED, PARSED_DOCS = (_PARSE.replace("%ROWS%", rows) for rows in (_FROM_LIST, _FROM_DOCS))


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a configuration string for every document."""
    listed = F.element_at(F.array(*map(F.lit, SPECS)), (F.pmod(F.floor(F.col("doc_id") / 4), F.lit(len(SPECS))) + 1).cast("int"))
    window = F.when(F.pmod("doc_id", F.lit(8)) < 4, F.concat(F.lit(":w"), F.col("doc_id").cast("string"))).otherwise("")
    kind = F.pmod("doc_id", F.lit(4))
    spec = (
        F.when(kind == 0, listed)
        .when(kind == 1, F.concat(F.lit("snapkv@r0."), (F.pmod("n_chars", F.lit(98)) + 1).cast("string"), window))
        .when(kind == 2, F.concat(F.lit("h2o@b"), F.col("n_chars").cast("string")))
        .otherwise(F.concat(F.lit("tova@bb"), F.col("doc_id").cast("string")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", spec.alias("config"))


@query(PARSED_DOCS + "SELECT * FROM p")
def parse_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specs(spark, sf_dir).select("doc_id", "config", cf.parse(F.col("config")).alias("c")).select("doc_id", "config", "c.*")


_ITEMS = """, it AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS prefill, octet_length(encode(text)) AS nbytes, 10 + doc_id % 25 AS q FROM documents),
x AS (SELECT doc_id, config, p.*, prefill, nbytes, q, coalesce("window", wq_c + q) AS win,
  coalesce(coalesce("window", wq_c + q) + 1, CASE WHEN press IN ('snapkv', 'pyramidkv') THEN 65 ELSE 0 END) AS least FROM it, p WHERE kind IS NOT NULL)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.regexp_count("text", F.lit(r"\S+")).alias("prefill"),
        F.octet_length("text").alias("nbytes"),
        (F.lit(10) + F.pmod("doc_id", F.lit(25))).alias("q"),
    )
    configs = F.array(*(F.lit(s) for s in SPECS))
    rows = docs.withColumn("config", F.explode(configs)).withColumn("c", cf.parse(F.col("config")))
    return rows.where("c.kind is not null")


@query(
    PARSED
    + _ITEMS
    + """SELECT doc_id, config, round(CASE WHEN kind <> 'press' THEN NULL WHEN prefill < least THEN 0.0 WHEN bytes IS NOT NULL THEN
CASE WHEN nbytes <= bytes THEN 0.0 ELSE 1.0 - bytes::DOUBLE / nbytes END WHEN budget IS NOT NULL THEN CASE WHEN prefill <= budget THEN 0.0 ELSE 1.0 - budget::DOUBLE / prefill END
ELSE ratio END::DOUBLE, 9) AS ratio FROM x"""
)
def effective_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = cf.effective_ratio(F.col("c"), F.col("prefill"), F.col("nbytes"), F.col("q"))
    return _items(spark, sf_dir).select("doc_id", "config", F.round(ratio, 9).alias("ratio"))


@query(PARSED + _ITEMS + "SELECT doc_id, config, win::BIGINT AS win, least::BIGINT AS least FROM x")
def resolved_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = F.col("c"), F.col("q")
    return _items(spark, sf_dir).select(
        "doc_id", "config", cf.resolved_window(c, q).cast("long").alias("win"), cf.min_prefill(c, q).cast("long").alias("least")
    )


@query(
    f"""WITH {_FROM_DOCS} SELECT doc_id, config, CASE WHEN regexp_full_match(config, '({_NAMES})@r0\\.[0-9]+') THEN config || ':w64' ELSE config END AS norm,
CASE WHEN regexp_full_match(config, '({_NAMES})@r0\\.[0-9]+(:w[1-9][0-9]*|:wq[1-9][0-9]*)?')
THEN coalesce(nullif(regexp_extract(config, ':w([0-9]+)$', 1), '')::INT, 64) END AS w FROM s"""
)
def norm_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specs(spark, sf_dir).select("doc_id", "config", cf.norm_config(F.col("config")).alias("norm"), cf.window_value(F.col("config")).alias("w"))


_SIZES = "' ' || doc_id || 'k, ' || n_chars || CASE doc_id % 3 WHEN 0 THEN ',,2k ' WHEN 1 THEN '' ELSE ', ' END"


@query(
    f"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> ''),
lambda x: CASE WHEN x LIKE '%k' THEN rtrim(x, 'k')::BIGINT * 1024 ELSE x::BIGINT END), ',') AS sizes FROM (SELECT doc_id, {_SIZES} AS spec FROM documents)"""
)
def parse_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of sizes, one for every document."""
    rest = F.element_at(F.array(F.lit(",,2k "), F.lit(""), F.lit(", ")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    spec = F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit("k, "), F.col("n_chars").cast("string"), rest)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(cf.parse_sizes(spec).cast("array<string>"), ",").alias("sizes"))


_IDS = "('mrag' || ['', 'PAD96', 'JSON120', 'TOOL60', 'IF', 'RF', 'Xen'][(doc_id % 7 + 1)::INT] || '-' || lang || '-8k-' || doc_id)"


@query(
    f"""SELECT item, regexp_extract(string_split(item, '-')[1], '^mrag(PAD|JSON|TOOL|IF|RF|X)', 1) AS family,
nullif(regexp_extract(string_split(item, '-')[1], '(?:PAD|JSON|TOOL)([0-9]+)', 1), '')::INT AS n, string_split(item, '-')[2] AS lang,
string_split(item, '-')[-1]::BIGINT AS "index" FROM (SELECT {_IDS} AS item FROM documents)"""
)
def parse_item_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("", "PAD96", "JSON120", "TOOL60", "IF", "RF", "Xen")))
    kind = F.element_at(kinds, (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    item = F.concat(F.lit("mrag"), kind, F.lit("-"), "lang", F.lit("-8k-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(item.alias("item")).select("item", cf.parse_item_id(F.col("item")).alias("p")).select("item", "p.*")


_LANGS = ", ".join(f"('{c}', '{n}', '{s}')" for c, n, s, _ in profiles.LANGUAGES)
_CODES = [c for c, *_ in profiles.LANGUAGES]
_ASKED = "' ' || lang || ', ' || " + str(_CODES) + f"[(doc_id % {len(_CODES)} + 1)::INT] || ',, ' || " + str(_CODES) + f"[(doc_id // 7 % {len(_CODES)} + 1)::INT]"


@query(
    f"""SELECT doc_id, "rank", code, l.name, l.script FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS "rank" FROM
(SELECT doc_id, trim(unnest(string_split({_ASKED}, ','))) AS code, unnest(range(4)) AS i FROM documents) WHERE code <> '') w JOIN (VALUES {_LANGS}) l(c, name, script) ON l.c = w.code"""
)
def resolve_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of languages for every document, in the order of the request, blanks left out; the table has 14 rows."""
    dim = spark.createDataFrame([x[:3] for x in profiles.LANGUAGES], "code string, name string, script string")
    codes = F.array(*map(F.lit, _CODES))
    one, two = (F.element_at(codes, (F.pmod(i, F.lit(len(_CODES))) + 1).cast("int")) for i in (F.col("doc_id"), F.floor(F.col("doc_id") / 7)))
    wanted = F.concat(F.lit(" "), "lang", F.lit(", "), one, F.lit(",, "), two)
    listed = F.filter(F.transform(F.split(wanted, ","), lambda c: F.trim(c)), lambda c: c != "")
    asked = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(listed).alias("i", "code"))
    return asked.join(F.broadcast(dim), "code").select("doc_id", (F.col("i") + 1).cast("long").alias("rank"), "code", "name", "script")


@query(SQL + "SELECT item_id, config, substr(sha256(concat_ws('|', model, task, lang, config, item_id, 'v1')), 1, 24) AS run_key FROM gen")
def run_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = store.run_key(*map(F.col, ("model", "task", "lang", "config", "item_id")))
    return generations(spark, sf_dir).select("item_id", "config", key.alias("run_key"))


@query(
    """SELECT DISTINCT source, lang, substr(sha256('{"dtype": "bf16", "lang": ' || to_json(lang) || ', "source": ' || to_json(source) || '}'), 1, 12) AS stack_id FROM documents"""
)
def stack_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of a description does not depend on the order of its keys: here they come in reverse."""
    described = F.create_map(F.lit("source"), "source", F.lit("lang"), "lang", F.lit("dtype"), F.lit("bf16"))
    return table(spark, sf_dir, "documents").select("source", "lang").distinct().select("source", "lang", store.stack_id(described).alias("stack_id"))


@query(
    SQL
    + """SELECT model, task, lang, config, count(*) AS n, round(avg(correct::INT), 9) AS accuracy, round(avg(n_output_tokens), 9) AS mean_tokens,
round(avg(output_bytes), 9) AS mean_bytes, round(avg(drift), 9) AS mean_drift FROM gen GROUP BY ALL"""
)
def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cell_summary(generations(spark, sf_dir)).orderBy("model", "task", "config", "lang")


@query("SELECT doc_id, lang, n_chars FROM documents")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")


@query(SQL + "SELECT item_id, correct FROM gen WHERE model LIKE 'm%' AND task = 'mrag' AND config = 'kv4' AND lang = 'en' AND starts_with(item_id, 'mrag-en')")
def cell_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generations(spark, sf_dir).where(F.col("model").like("m%") & F.col("item_id").startswith("mrag-en"))
    return rows.where("task = 'mrag' and config = 'kv4' and lang = 'en'").select("item_id", "correct")


@query(
    """SELECT 'documents' AS store, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
UNION ALL SELECT 'conversations', conv_id, text FROM conversations"""
)
def multi_store_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"documents": "doc_id", "benchmark": "item_id", "conversations": "conv_id"}
    stores: dict[str, DataFrame | None] = {n: table(spark, sf_dir, n).select(F.col(k).alias("id"), "text") for n, k in keys.items()}
    return union_stores(stores | {"not there": None}).select("store", "id", "text")


NEW_ROWS = """(SELECT doc_id, lang, n_chars, 1 AS v FROM documents UNION ALL SELECT doc_id, upper(lang), n_chars + 1, 2 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query(f"SELECT doc_id, lang, n_chars, v FROM {NEW_ROWS} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.lit(1).alias("v"))
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    new = old.join(labelled, "doc_id", "left_semi").select("doc_id", F.upper("lang").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"), F.lit(2).alias("v"))
    return store.upsert(old, new, key="doc_id", order="v")


@query(
    """SELECT doc_id, quality, 'old' AS origin FROM labels UNION ALL
SELECT doc_id, -1, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit("old").alias("origin"))
    new = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).cast("int").alias("quality"), F.lit("new").alias("origin"))
    return store.insert_ignore(old, new, "doc_id")


@query(SQL + "SELECT item_id, config FROM gen WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) OR config <> 'kv4'")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work of the plan that has no row yet: of kv4, items with a good label are done."""
    plan = generations(spark, sf_dir).select("doc_id", "item_id", "config")
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("kv4").alias("config"))
    done = done.join(plan, ["doc_id", "config"]).select(store.run_key(F.col("config"), F.col("item_id")).alias("run_key"))
    return store.pending(plan.withColumn("run_key", store.run_key(F.col("config"), F.col("item_id"))), done).select("item_id", "config")


@query(
    f"""SELECT lang, config, count(*) AS n FROM documents, (VALUES {', '.join(f"('{c}')" for c, _, _ in CONFIGS)}) v(config) GROUP BY ALL"""
)
def run_matrix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration on every item, counted by cell; the list of configurations is short and fixed."""
    configs = F.array(*(F.lit(c) for c, _, _ in CONFIGS))
    return table(spark, sf_dir, "documents").select("lang", F.explode(configs).alias("config")).groupBy("lang", "config").agg(F.count("*").alias("n"))


@query(
    SQL
    + """SELECT m.store, want, coalesce(n, 0) AS got, coalesce(n, 0) = want AS ok FROM (VALUES ('store0', 1670::BIGINT), ('store1', 1665::BIGINT), ('store9', 0::BIGINT)) m(store, want)
LEFT JOIN (SELECT store, count(*) AS n FROM gen GROUP BY store) c ON c.store = m.store"""
)
def rowcount_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = spark.createDataFrame([("store0", 1670), ("store1", 1665), ("store9", 0)], "store string, want long")
    return store.manifest_check(generations(spark, sf_dir), manifest)


@query(
    """SELECT 'common' AS guard, count(*) AS n FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark) UNION ALL
SELECT 'only documents', count(*) FROM (SELECT text FROM documents EXCEPT SELECT text FROM benchmark) UNION ALL
SELECT 'stacks', count(*) FROM (SELECT doc_id % 2 FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id % 2 FROM documents WHERE lang = 'de') UNION ALL
SELECT 'shared keys', count(DISTINCT d.doc_id) FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
)
def set_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench, labels = (table(spark, sf_dir, n) for n in ("documents", "benchmark", "labels"))
    stack = lambda lang: docs.where(F.col("lang") == lang).select(F.pmod("doc_id", F.lit(2)))
    sets = {
        "common": docs.select("text").intersect(bench.select("text")),
        "only documents": docs.select("text").subtract(bench.select("text")),
        "stacks": stack("en").intersect(stack("de")),
        "shared keys": docs.select("doc_id").distinct().join(labels, "doc_id", "left_semi"),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("guard"), "n") for name, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(
    """SELECT (SELECT count(*) FROM benchmark WHERE item_id < 20) AS n_eval, (SELECT count(*) FROM benchmark WHERE item_id >= 20) AS n_held_out,
(SELECT count(*) FROM (SELECT text FROM benchmark WHERE item_id < 20 INTERSECT SELECT text FROM benchmark WHERE item_id >= 20)) AS n_common"""
)
def disjointness_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation and held-out items share no text; the count is asserted to be 0."""
    bench = table(spark, sf_dir, "benchmark")
    sides = bench.groupBy("text").agg(F.count_if(F.expr("item_id < 20")).alias("e"), F.count_if(F.expr("item_id >= 20")).alias("h"))
    out = sides.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("n_eval"), F.coalesce(F.sum("h"), F.lit(0)).alias("n_held_out"), F.count_if(F.expr("e > 0 and h > 0")).alias("n_common")
    )
    return store.require(out, "n_common = 0", "evaluation and held-out items overlap")


@query(SQL + "SELECT lang, store, count(DISTINCT stack_id) AS n_stacks, count(DISTINCT stack_id) = 1 AS ok FROM gen GROUP BY ALL")
def single_stack_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.collect_set("stack_id")).cast("long")
    return generations(spark, sf_dir).groupBy("lang", "store").agg(n.alias("n_stacks"), (n == 1).alias("ok"))


@query(
    """SELECT w.name, w.want, g.got FROM (VALUES ('languages', 4::BIGINT), ('sources', 20::BIGINT), ('items', 41::BIGINT)) w(name, want)
JOIN (SELECT 'languages' AS name, count(DISTINCT lang) AS got FROM documents UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents
UNION ALL SELECT 'items', count(*) FROM benchmark) g ON g.name = w.name WHERE w.want <> g.got"""
)
def constant_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured constants that differ from the locked ones."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    two = docs.agg(F.countDistinct("lang").alias("languages"), F.countDistinct("source").alias("sources"))
    got = two.unpivot([], ["languages", "sources"], "name", "got").unionAll(bench.agg(F.count("*").alias("got")).select(F.lit("items").alias("name"), "got"))
    want = spark.createDataFrame([("languages", 4), ("sources", 20), ("items", 41)], "name string, want long")
    return want.join(got, "name").where("want != got").select("name", "want", "got")


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events"""
)
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(SQL + "SELECT item_id, 'q' || doc_id AS qid, position, q_tokens FROM gen WHERE config = 'baseline'")
def meta_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the stored JSON, read back with a schema."""
    rows = generations(spark, sf_dir).where("config = 'baseline'")
    rows = rows.withColumn("meta", meta(rows)).drop("position", "q_tokens")
    parsed = F.from_json("meta", "qid string, position string, q_tokens int").alias("m")
    return rows.select("item_id", parsed).select("item_id", "m.*")


# stored golds by the rest of an id: a JSON array, a Python list with escapes, a scalar, blanks, a broken list, numbers
@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN [lang, source] WHEN 1 THEN [left(text, 60), source] WHEN 2 THEN [lang] WHEN 3 THEN []
WHEN 4 THEN ['[' || lang || ', broken'] ELSE [doc_id::VARCHAR, 'it' || chr(39) || 's é', 'None', '2.5'] END AS golds FROM documents"""
)
def decode_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golds stored as a JSON array, a Python list, a scalar, or nothing, as arrays."""
    quoted = F.replace(F.substring("text", 1, 60), F.lit("\\"), F.lit("\\\\"))
    quoted = F.replace(F.replace(quoted, F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    kind = F.pmod("doc_id", F.lit(6))
    stored = (
        F.when(kind == 0, F.to_json(F.array("lang", "source")))
        .when(kind == 1, F.concat(F.lit("['"), quoted, F.lit("', \""), "source", F.lit('", ]')))
        .when(kind == 2, F.concat(F.lit(" \n"), "lang", F.lit("  ")))
        .when(kind == 3, " \n ")
        .when(kind == 4, F.concat(F.lit("["), "lang", F.lit(", broken")))
        .otherwise(F.concat(F.lit("[ "), F.col("doc_id").cast("string"), F.lit(", 'it\\'s \\xe9', None, 2.50]")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", golds.decode_golds(stored).alias("golds"))


_MIXED = SQL + """, e AS (SELECT lang, config, max(n_output_tokens) OVER () AS cap, n_output_tokens, output FROM gen)
SELECT lang, config, count(*) AS n, round(100 * avg((n_output_tokens >= cap)::INT), 6) AS truncated_pct, {0} FROM e GROUP BY ALL"""


@query(_MIXED.replace("{0}", "round(100 * avg(contains(output, '####')::INT), 6) AS marker_pct"))
def truncation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs as long as the longest of the store, and outputs with a marker."""
    rows = generations(spark, sf_dir)
    cap = rows.agg(F.max("n_output_tokens").alias("cap"))  # one row
    cut = F.round(100 * F.avg((F.col("n_output_tokens") >= F.col("cap")).cast("int")), 6)
    marked = F.round(100 * F.avg(F.contains("output", F.lit("####")).cast("int")), 6)
    return rows.join(F.broadcast(cap)).groupBy("lang", "config").agg(F.count("*").alias("n"), cut.alias("truncated_pct"), marked.alias("marker_pct"))


@query(SQL + "SELECT lang, round(100 * avg(contains(output, '####')::INT), 6) AS marker_pct, round(100 * avg(contains(output, chr(65533))::INT), 6) AS mojibake_pct FROM gen GROUP BY lang")
def marker_mojibake_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = lambda needle: F.round(100 * F.avg(F.contains("output", F.lit(needle)).cast("int")), 6)
    return generations(spark, sf_dir).groupBy("lang").agg(pct("####").alias("marker_pct"), pct("�").alias("mojibake_pct"))


@query(
    SQL
    + """, b AS (SELECT lang, config, avg(output_bytes) AS nb, avg((n_output_tokens >= 128)::INT) AS tr, avg(drift) AS dr, avg(contains(output, chr(65533))::INT) AS mo FROM gen GROUP BY ALL)
SELECT b.lang, b.config, round(b.nb / a.nb, 9) AS bytes_ratio, round(100 * b.tr, 6) AS truncated_pct, round(b.dr, 9) AS drift, round(100 * b.mo, 6) AS mojibake_pct
FROM b JOIN b a ON a.lang = b.lang AND a.config = 'baseline'"""
)
def behaviour_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = generations(spark, sf_dir).groupBy("lang", "config").agg(
        F.avg("output_bytes").alias("nb"),
        F.round(100 * F.avg((F.col("n_output_tokens") >= 128).cast("int")), 6).alias("truncated_pct"),
        F.round(F.avg("drift"), 9).alias("drift"),
        F.round(100 * F.avg(F.contains("output", F.lit("�")).cast("int")), 6).alias("mojibake_pct"),
    )
    base = F.max(F.when(F.col("config") == "baseline", F.col("nb"))).over(W.Window.partitionBy("lang"))
    return cells.withColumn("bytes_ratio", F.round(F.col("nb") / base, 9)).drop("nb")
