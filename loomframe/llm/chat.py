"""Chat formatting by quotation linking, by DataFrame operations only.

Lines that begin with ``>`` are quotes, their number of ``>`` the level.  Adjacent lines of a level are a passage.
Passages, their paragraphs and their single lines are normalised (markers off, lower case, one space for white space) and hashed;
messages offer the hashes of their own words: the whole, its paragraphs and its lines.  A passage belongs to the first
message of the conversation that offers its hash, if that comes before the quoting one.  A message replies to the
message that its shallowest, then longest passage belongs to.  Replies lead to a root by pointer doubling;
(root, turn) is the reply order: a thread stands together, and every reply after what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

QUOTE = r"^[ \t]*(>[> \t]*)"
PARAGRAPH = r"\n[ \t\r]*\n"


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s ]+", " ")))


def unquoted(text: Column) -> Column:
    """The text without quote lines, and without a line that introduces them."""
    bare = F.regexp_replace(text, r"(?m)^[^\n>][^\n]*\bwrote:[ \t]*\r?\n(?=[ \t]*>)", "")
    return F.when(text.rlike(r"(?m)^[ \t]*>"), F.trim(F.regexp_replace(bare, r"(?m)^[ \t]*>[^\n]*(?:\n|\z)", ""), F.lit(" \n\r\t"))).otherwise(text)


def _hashes(unit: Column) -> Column:
    return F.struct(F.xxhash64(unit).alias("h1"), F.xxhash64(unit, F.lit(1)).alias("h2"), F.length(unit).alias("size"))


def link_quotes(chat: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``(c, t, k, parent)``: conversation, turn, XXH64 of the text of each quoting message, and the turn that it replies to."""
    rows = chat.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(text_col).alias("x")).where("x IS NOT NULL AND c IS NOT NULL AND t IS NOT NULL")
    quoting = rows.where(F.col("x").rlike(r"(?m)^[ \t]*>")).distinct()
    lines = quoting.select("c", "t", F.xxhash64("x").alias("k"), F.posexplode(F.split("x", "\n")).alias("i", "x"))
    mark = F.regexp_extract("x", QUOTE, 1)
    lines = materialize(lines.select("c", "t", "k", "i", F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.regexp_replace("x", QUOTE, "").alias("x")), "chat-lines")
    message = Window.partitionBy("c", "t", "k").orderBy("i")
    new = F.when(F.col("level") == F.lag("level").over(message), 0).otherwise(1)
    passages = lines.withColumn("new", new).withColumn("p", F.sum("new").over(message.rowsBetween(Window.unboundedPreceding, 0))).where("level > 0")
    passages = passages.groupBy("c", "t", "k", "level", "p").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l"))  # bounded by a message
    x = F.transform("l", lambda s: s["x"])
    units = F.concat(x, F.split(F.array_join(x, "\n"), PARAGRAPH), F.array(F.array_join(x, " ")))
    units = F.transform(units, normal)
    passages = passages.select("c", "t", "k", "level", F.explode(F.array_distinct(units)).alias("u")).where("u != ''").select("c", "t", "k", "level", _hashes(F.col("u")).alias("h")).select("c", "t", "k", "level", "h.*")
    passages = materialize(passages, "chat-passages")

    some = rows.join(passages.select("c").distinct(), "c", "left_semi").select("c", "t", unquoted(F.col("x")).alias("x"))
    units = F.concat(F.array(F.col("x")), F.split("x", PARAGRAPH), F.split("x", "\n"))
    own = some.select("c", "t", F.explode(F.array_distinct(F.transform(units, normal))).alias("u")).where("u != ''").select("c", "t", _hashes(F.col("u")).alias("h")).select("c", "t", "h.h1", "h.h2")
    own = materialize(own.groupBy("c", "h1", "h2").agg(F.min("t").alias("first")), "chat-own")
    links = passages.join(own, ["c", "h1", "h2"]).where("first < t")
    links = links.groupBy("c", "t", "k").agg(F.max(F.struct(-F.col("level"), F.col("size"), F.col("first"))).alias("best")).select("c", "t", "k", F.col("best.first").alias("parent"))
    links = materialize(links, "chat-links")
    release(lines, passages, own)
    return links


def thread(chat: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_col, turn_col, role_col, text_col, reply_to, root, formatted)`` for every row, in reply order.

    text_col comes without quotes; reply_to is the turn that the message answers by quoting it, else null; root is
    the first turn of its thread, its own turn if it quotes nothing.  formatted is ``<|role|>``, a line end, the
    text and ``<|end|>``.  A null text stays null and is formatted as an empty one; a null role is ``user``; rows
    with a null conversation or turn are kept and link with nothing; rows that repeat a turn are linked each by
    its own quotes, and share the turn's first root; texts of any length count whole, and an empty table gives no
    row; of passages that link equally well the one of the latest message counts; other columns play no part.  Conversations are not gathered:
    rows come range-partitioned and sorted by (conversation, root, turn).
    """
    links = link_quotes(chat, conv_col, turn_col, text_col)
    # one parent a turn; doubled until every pointer is at a root
    up = materialize(links.groupBy("c", "t").agg(F.min("parent").alias("root")), "chat-up")
    while True:
        a, b = up.alias("a"), up.alias("b")
        nxt = a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.root") == F.col("b.t")), "left").select("a.c", "a.t", F.coalesce("b.root", "a.root").alias("root"), F.col("b.t").isNotNull().alias("moved"))
        nxt = materialize(nxt, "chat-up")
        release(up)
        up = nxt.select("c", "t", "root")
        up._loomframe_path = nxt._loomframe_path
        if nxt.where("moved").isEmpty():
            break
    rows = chat.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("role"), F.col(text_col).alias("x"), F.xxhash64(text_col).alias("k"))
    rows = rows.join(links, ["c", "t", "k"], "left").join(up, ["c", "t"], "left")
    rows = rows.select("c", "t", "role", unquoted(F.col("x")).alias("x"), F.col("parent").alias("reply_to"), F.coalesce("root", "t").alias("root"))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("x", F.lit("")), F.lit("<|end|>"))
    rows = rows.repartitionByRange("c", "root", "t").sortWithinPartitions("c", "root", "t")
    return rows.select(F.col("c").alias(conv_col), F.col("t").alias(turn_col), F.col("role").alias(role_col), F.col("x").alias(text_col), "reply_to", "root", formatted.alias("formatted"))


def op6_chat(spark, sf_dir):
    return thread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
