"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text between
``loss_start`` and ``loss_end`` (code points of ``formatted``). Turns that no assistant turn follows close with one
example without loss. A turn reads ``### role: text</turn>`` and a line feed; inside roles and texts ``\\``, ``#``,
``<`` (and ``:`` in roles) are written ``\\s``, ``\\h``, ``\\l`` and ``\\c``, so no text can hold a mark of the template.

Turns are in order of turn, role and text, so copies of a row are turns of their own; a NULL turn number comes
first. NULL texts and roles are empty. Rows without a conv_id are one conversation with a NULL conv_id.
A conversation's examples hold its turns once per assistant turn, which is what prefix expansion means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from medweave.llm.common import query, table

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
# Character and the letter that stands for it behind a backslash; the backslash itself first.
CODES = (("\\", "s"), ("#", "h"), ("<", "l"), (":", "c"))


def escape(text: Column, role: bool = False) -> Column:
    for char, code in CODES if role else CODES[:3]:
        text = F.replace(text, F.lit(char), F.lit("\\" + code))
    return text


def unescape(text: Column) -> Column:
    """Every backslash begins a code, and the one for the backslash is read last: no code can arise on the way."""
    for char, code in reversed(CODES):
        text = F.replace(text, F.lit("\\" + code), F.lit(char))
    return text


def examples(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """``conv_id``, ``example`` (from 0), ``formatted``, ``loss_start``, ``loss_end`` of ``turns`` (conv_id, turn, role, text)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(AFTER_ROLE), escape(t["text"]), F.lit(CLOSE)).alias("block"),
        F.char_length(escape(t["text"])).alias("chars"),
        (t["role"] == target).alias("wanted"),
    ))
    last = F.size("made") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda k: F.get("made", k)["wanted"] | (k == last))
    each = whole.select("conv_id", made.alias("made")).select("conv_id", "made", F.posexplode(ends).alias("example", "end"))
    formatted = F.array_join(F.transform(F.slice("made", F.lit(1), F.col("end") + 1), lambda t: t["block"]), "")
    target_turn = F.get("made", F.col("end"))
    loss_end = F.char_length("formatted") - len(CLOSE)
    return each.select("conv_id", "example", formatted.alias("formatted"), target_turn["chars"].alias("chars"), target_turn["wanted"].alias("wanted")).select(
        "conv_id", "example", "formatted",
        F.when(F.col("wanted"), loss_end - F.col("chars")).alias("loss_start"), F.when(F.col("wanted"), loss_end).alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of ``role`` and ``text``."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turn(block: Column) -> Column:
        cut = F.instr(block, F.lit(AFTER_ROLE))
        return F.struct(
            unescape(F.substr(block, F.lit(len(OPEN) + 1), cut - 1 - len(OPEN))).alias("role"),
            unescape(F.substr(block, cut + len(AFTER_ROLE))).alias("text"),
        )

    return F.transform(blocks, turn)


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: its turns and the texts under the loss mask, in order."""
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    own = F.struct("example", F.when(F.col("loss_start").isNotNull(), loss).alias("loss"))
    gathered = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"), F.sort_array(F.collect_list(own)).alias("own"), F.sum(F.char_length("formatted")).alias("formatted_chars")
    )
    texts = F.filter(F.transform("own", lambda e: e["loss"]), lambda x: x.isNotNull())
    return gathered.select("conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(texts, "").alias("loss"), "formatted_chars")


SQL = r"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), sized AS (
  SELECT *, 14 + length(role) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS chars,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM turn WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""


@query("op2_chat_format", SQL)
def op2(spark, folder):
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(examples(turns))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
