"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = turn*
    turn         = "<s>[INST" mode "]" role "[/INST]" text "</s>"
    mode         = "" | "~"

In the plain mode a text stands as it is.  Each turn is rendered plainly and parsed again by the grammar; when what
comes back is not the turn, its role and text are escaped ("~" becomes "~0", "<" becomes "~1", "[" becomes "~2"), which
leaves no control string in them, and parsed once more.  A turn that would not come back even then raises an error.
The conversation is the turns in order, rendered one after another; every figure of ``read_back`` comes from parsing
that text again, not from the source.  The whole conversation is parsed and compared with its source, too.

Turns are ordered by turn, then role, then text, so ties and repeated rows have a fixed order; null turns come first.
An empty table gives no conversation; further columns play no part.  Null roles and texts count as empty.  Rows of a null conversation id make one conversation.  Rendering needs no shuffle;
only rendered turns meet by conversation, and a conversation has to fit one row, as it is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
OPEN, ROLE_END, CLOSE = "<s>[INST", "[/INST]", "</s>"
TURN = r"(?s)<s>\[INST(~?)\](.*?)\[/INST\](.*?)</s>"
MASKED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def render(role: Column, text: Column, escaped: bool) -> Column:
    mode, put = ("~", escape) if escaped else ("", lambda c: c)
    return F.concat(F.lit(f"{OPEN}{mode}]"), put(role), F.lit(ROLE_END), put(text), F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    part = [F.regexp_extract_all(formatted, F.lit(TURN), F.lit(i)) for i in (1, 2, 3)]
    plain = lambda mode, c: F.when(mode == "~", unescape(c)).otherwise(c)
    return F.transform(
        F.arrays_zip(*(p.alias(n) for p, n in zip(part, ("mode", "role", "text"), strict=True))),
        lambda t: F.struct(plain(t["mode"], t["role"]).alias("role"), plain(t["mode"], t["text"]).alias("text")),
    )


def rest(formatted: Column) -> Column:
    """What of a formatted conversation is no turn."""
    return F.regexp_replace(formatted, TURN, "")


def _comes_back(rendered: Column, role: Column, text: Column) -> Column:
    """Does the grammar read the rendered turn as just this turn, up to its last character?"""
    group = lambda i: F.regexp_extract(rendered, TURN, i)
    size = F.length(group(0))
    mode = group(1)
    read = lambda c: F.when(mode == "~", unescape(c)).otherwise(c)
    return (size == F.length(rendered)) & (read(group(2)) == role) & (read(group(3)) == text)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and rendered of every turn."""
    own = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    own = own.withColumn("plain", render(role, text, escaped=False))
    own = own.withColumn("rendered", F.when(_comes_back(F.col("plain"), role, text), F.col("plain")).otherwise(render(role, text, escaped=True)))
    good = (F.col("rendered") == F.col("plain")) | _comes_back(F.col("rendered"), role, text)
    kept = F.when(good, F.col("rendered")).otherwise(F.raise_error(F.lit("a turn does not come back from its rendering")))
    return own.select("conv_id", "turn", "role", "text", kept.cast("string").alias("rendered"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and formatted, a row for each conversation; the grammar has to read it as just its turns, to the last character."""
    rows = format_turns(turns, conv_col, turn_col, role_col, text_col)
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), "role", "text", "rendered")))
    whole = rows.groupBy("conv_id").agg(ordered.alias("_turns")).withColumn("formatted", F.array_join(F.transform("_turns", lambda t: t["rendered"]), ""))
    source = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    good = (parse(F.col("formatted")) == source) & (rest(F.col("formatted")) == "")
    kept = F.when(good, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not come back from its rendering")))
    return whole.select("conv_id", kept.cast("string").alias("formatted"))


def read_back(chats: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, parsed from ``formatted``."""
    parsed = chats.withColumn("turns", parse(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == MASKED_ROLE), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
