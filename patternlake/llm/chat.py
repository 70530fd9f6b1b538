"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Each turn is rendered between the marks of its role. The rendered turn is parsed
again; where role or text differ from the source, the text is escaped, and the
parser undoes escapes, so that the second rendering always reads back. The whole
conversation is then parsed once more, and if the recovered turns differ from the
source, every turn of it is escaped.

Defined results: null text and null role count as empty; turns are ordered by
(turn, role, text) with null turns first, so ties have one order and repeated rows
stay as repeated turns; null conv_id forms a conversation of its own; roles other
than system, user and assistant are carried in base64 behind their mark; an empty
table gives no conversations; columns other than the four are ignored.
A conversation is one output row and thus one group; its turns are rendered and
checked before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: role -> (opening mark, closing mark)
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
_TURN = r"(?s)<<SYS>> (?:.*?) <</SYS>>|\[INST\] (?:.*?) \[/INST\]|<s> (?:.*?) </s>|\[ROLE\] (?:.*?) \[/ROLE\]"
_CONTROL = r"([<\[])(?=<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|/ROLE\])"
_ESCAPED = r"(?s)\\(.)"
#: What the grammar doesn't allow in a body: a control string, or a last backslash without a partner.
_FOREIGN = _CONTROL + r"|\\$"


def escape(text: Column) -> Column:
    """Double backslashes, then break every control string with one."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def render_turn(role: Column, body: Column) -> Column:
    other = F.concat(
        F.lit(f"{OTHER[0]} "), F.regexp_replace(F.base64(F.encode(role, "UTF-8")), r"\s", ""), F.lit("\n"), body, F.lit(f" {OTHER[1]}")
    )
    out = None
    for name, (a, b) in MARKS.items():
        text = F.concat(F.lit(f"{a} "), body, F.lit(f" {b}"))
        out = F.when(role == name, text) if out is None else out.when(role == name, text)
    return out.otherwise(other)


def _inside(turn: Column, marks: tuple[str, str]) -> Column:
    a, b = marks
    return F.substr(turn, F.lit(len(a) + 2), F.length(turn) - F.lit(len(a) + len(b) + 2))


def read_turn(turn: Column) -> Column:
    """struct(role, text) of one rendered turn."""
    out = None
    for name, marks in MARKS.items():
        got = F.struct(F.lit(name).alias("role"), unescape(_inside(turn, marks)).alias("text"))
        hit = turn.startswith(marks[0])
        out = F.when(hit, got) if out is None else out.when(hit, got)
    body = _inside(turn, OTHER)
    return out.otherwise(
        F.struct(
            F.decode(F.unbase64(F.substring_index(body, "\n", 1)), "UTF-8").alias("role"),
            unescape(F.substr(body, F.length(F.substring_index(body, "\n", 1)) + 2)).alias("text"),
        )
    )


def turns_of(formatted: Column) -> Column:
    """The rendered turns inside a formatted conversation."""
    return F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))


def parse(formatted: Column) -> Column:
    """array(struct(role, text)): what a reader recovers from the formatted text."""
    return F.transform(turns_of(formatted), read_turn)


def chat_format(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, formatted, turns (as read back), loss_mask.

    loss_mask is run-length coded over the formatted text: struct(chars, loss) per
    stretch, where loss is true on the bodies of assistant turns, escapes included.
    """
    rows = df.select(
        F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    plain = rows.withColumn("p", render_turn(F.col("r"), F.col("t")))
    source = F.array(F.struct(F.col("r").alias("role"), F.col("t").alias("text")))
    safe = plain.withColumn("safe", F.coalesce((parse(F.col("p")) == source) & ~F.col("t").rlike(_FOREIGN), F.lit(False)))
    checked = safe.select(
        "c", "n", "r", "t", F.when(F.col("safe"), F.col("p")).otherwise(render_turn(F.col("r"), escape(F.col("t")))).alias("p")
    )
    grouped = checked.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "r", "t", "p"))).alias("s"))
    joined = grouped.withColumn("f", F.array_join(F.col("s")["p"], "\n"))
    wanted = F.transform("s", lambda x: F.struct(x["r"].alias("role"), x["t"].alias("text")))
    every = F.array_join(F.transform("s", lambda x: render_turn(x["r"], escape(x["t"]))), "\n")
    final = joined.select("c", F.when(parse(F.col("f")) == wanted, F.col("f")).otherwise(every).alias("formatted"))
    a, b = MARKS["assistant"]

    def stretches(p: Column, i: Column) -> Column:
        gap = F.when(i == 0, 0).otherwise(1)
        return F.when(
            p.startswith(a),
            F.array(
                F.struct((gap + len(a) + 1).alias("chars"), F.lit(False).alias("loss")),
                F.struct((F.length(p) - (len(a) + len(b) + 2)).alias("chars"), F.lit(True).alias("loss")),
                F.struct(F.lit(len(b) + 1).alias("chars"), F.lit(False).alias("loss")),
            ),
        ).otherwise(F.array(F.struct((gap + F.length(p)).alias("chars"), F.lit(False).alias("loss"))))

    return final.select(
        F.col("c").alias(conv),
        "formatted",
        parse(F.col("formatted")).alias("turns"),
        F.flatten(F.transform(turns_of(F.col("formatted")), stretches)).alias("loss_mask"),
    )


def loss_texts(formatted: Column, loss_mask: Column) -> Column:
    """What lies under the mask, unescaped: an array of the texts of its stretches."""
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("texts"))

    def step(s: Column, m: Column) -> Column:
        found = F.array(unescape(F.substr(formatted, s["at"], m["chars"])))
        return F.struct((s["at"] + m["chars"]).alias("at"), F.when(m["loss"], F.concat(s["texts"], found)).otherwise(s["texts"]).alias("texts"))

    return F.aggregate(loss_mask, begin, step)["texts"]


PROBE = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = chat_format(talk.unionByName(probe))
    loss = F.array_join(loss_texts(F.col("formatted"), F.col("loss_mask")), "")
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = out.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), loss.alias("loss"))
    return read.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, CASE WHEN regexp_matches(text, '\\|<<SYS>>|<</SYS>>|\[/?INST\]|</?s>|\[/?ROLE\]') THEN
                  length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
                  + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|\[/?INST\]|</?s>|\[/?ROLE\]'))
                ELSE length(text) END
              + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
                ELSE 17 + length(to_base64(encode(role))) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) + count(*) - 1 AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
