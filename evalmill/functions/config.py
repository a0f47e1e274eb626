"""Configuration strings: the grammar, and what each row of work gets from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that may stand before "@", quantised caches, quantised weights.
PRESSES = ("snapkv", "pyramidkv", "h2o", "streamingllm", "tova", "expected", "knorm", "random")
KV = ("kv2", "kv4", "kv8")
KV_HQQ = ("kv2h", "kv4h")
WEIGHTS = ("gptq4", "awq4", "int8")
# Shortest prompt that a press with its default window can work on.
MIN_PREFILL = {"snapkv": 65, "pyramidkv": 65}
DEFAULT_WINDOW = 64

_NAME = f"({'|'.join(PRESSES)})"
RATIO = rf"^{_NAME}@r(0\.[0-9]+)(?::w([1-9][0-9]*)|:wq([1-9][0-9]*))?$"
TOKENS = rf"^{_NAME}@b([1-9][0-9]*)$"
BYTES = rf"^{_NAME}@bb([1-9][0-9]*)$"


def _part(config: Column, pattern: str, group: int) -> Column:
    got = F.regexp_extract(config, pattern, group)
    return F.when(got != "", got)


def parse(config: Column, strict: bool = False) -> Column:
    """A struct: kind (null for a string outside the grammar), press, ratio, window, wq_c, budget, bytes, nbits, backend.

    ``strict``: such a string is an error instead.
    """
    kind = (
        F.when(config == "baseline", "baseline")
        .when(config.isin(*KV, *KV_HQQ), "kvquant")
        .when(config.isin(*WEIGHTS), "weight")
        .when(config.rlike(RATIO) | config.rlike(TOKENS) | config.rlike(BYTES), "press")
    )
    if strict:
        kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown config: "), F.coalesce(config, F.lit("null")))).cast("string"))
    quant = kind == "kvquant"
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "press", F.substring_index(config, "@", 1)).alias("press"),
        _part(config, RATIO, 2).cast("double").alias("ratio"),
        _part(config, RATIO, 3).cast("int").alias("window"),
        _part(config, RATIO, 4).cast("int").alias("wq_c"),
        _part(config, TOKENS, 2).cast("int").alias("budget"),
        _part(config, BYTES, 2).cast("long").alias("bytes"),
        F.when(quant, F.substring(config, 3, 1).cast("int")).alias("nbits"),
        F.when(quant, F.when(config.endswith("h"), "hqq").otherwise("quanto")).alias("backend"),
    )


def resolved_window(cfg: Column, q_tokens: Column) -> Column:
    """The window of the string, or its constant plus the item's question; null means the press's own."""
    return F.coalesce(cfg["window"], cfg["wq_c"] + q_tokens)


def min_prefill(cfg: Column, q_tokens: Column) -> Column:
    default = F.lit(0)
    for press, least in MIN_PREFILL.items():
        default = F.when(cfg["press"] == press, least).otherwise(default)
    return F.coalesce(resolved_window(cfg, q_tokens) + 1, default)


def effective_ratio(cfg: Column, prefill: Column, prompt_bytes: Column, q_tokens: Column) -> Column:
    """Share of the cache that goes: null for a config that evicts nothing, 0 where it has no effect."""
    over = lambda most, size: F.when(size <= most, 0.0).otherwise(1.0 - most / size)
    return (
        F.when(F.coalesce(cfg["kind"], F.lit("")) != "press", F.lit(None).cast("double"))
        .when(prefill < min_prefill(cfg, q_tokens), 0.0)
        .when(cfg["bytes"].isNotNull(), over(cfg["bytes"], prompt_bytes))
        .when(cfg["budget"].isNotNull(), over(cfg["budget"], prefill))
        .otherwise(cfg["ratio"])
    )


def norm_config(config: Column) -> Column:
    """The default window written out: press@rX is press@rX:w64.  Other strings stay."""
    plain = rf"^{_NAME}@r0\.[0-9]+$"
    return F.when(config.rlike(plain), F.concat(config, F.lit(f":w{DEFAULT_WINDOW}"))).otherwise(config)


def window_value(config: Column) -> Column:
    """The window of a press config, 64 by default; null for everything else."""
    return F.when(config.rlike(RATIO), F.coalesce(_part(config, RATIO, 3).cast("int"), F.lit(DEFAULT_WINDOW)))


def parse_sizes(spec: Column) -> Column:
    """"8k,32768" to numbers, a k being 1024."""
    return F.transform(
        F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != ""),
        lambda x: F.when(x.endswith("k"), F.regexp_replace(x, "k$", "").cast("long") * 1024).otherwise(F.regexp_replace(x, "k$", "").cast("long")),
    )


def parse_item_id(item: Column) -> Column:
    """A struct: family (PAD, JSON, TOOL, IF, RF, X, or empty), n (its number), lang, index (behind the last hyphen)."""
    head = F.substring_index(item, "-", 1)
    return F.struct(
        F.regexp_extract(head, "^mrag(PAD|JSON|TOOL|IF|RF|X)", 1).alias("family"),
        _part(head, "(?:PAD|JSON|TOOL)([0-9]+)", 1).cast("int").alias("n"),
        F.element_at(F.split(item, "-"), 2).alias("lang"),
        F.substring_index(item, "-", -1).cast("long").alias("index"),
    )
