"""Chat formatting as a grammar round trip, in SQL functions only.

    user       [INST] text [/INST]
    assistant  <s> text </s>
    any other  [ROLE] role\\ntext [/ROLE]        (role is URL-encoded)

Turns follow each other without separators. The parser splits at control strings and nothing else, so it is
deterministic. Each turn is rendered as it is and parsed; where that does not give the turn back, control strings in it
get one more backslash after their bracket, and the result is parsed and compared again. One escape always suffices:
escaping adds a backslash to every run before a name and the parser takes one away, so nothing is ambiguous. The query
fails if a turn should differ even then.

Nulls: a null text or role is empty; null conversation ids form one conversation; a null turn comes first. Ties in turn are
ordered by role and rendered text; repeated rows are repeated turns. A very long text is one value, as is its conversation; ``format_turns`` has no more than the
text. Extra columns go, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMES = r"(?:/?(?:INST|ROLE)\]|/?s>)"
CONTROL = rf"[\[<]{_NAMES}"
_ESCAPE = rf"([\[<])(\\*)({_NAMES})"
_UNESCAPE = rf"([\[<])\\(\\*)({_NAMES})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2$3"))


def render(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s> "), text, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("[ROLE] "), F.url_encode(role), F.lit("\n"), text, F.lit(" [/ROLE]")))
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text, loss>>; null if the control strings are not those of whole turns."""
    tokens = F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0))
    pieces = F.split(formatted, CONTROL, -1)
    pairs = F.zip_with(tokens, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1))), lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    opens = F.filter(pairs, lambda x: x["t"].isin("[INST]", "<s>", "[ROLE]"))

    def turn(x: Column) -> Column:
        body = x["p"].substr(F.lit(2), F.char_length(x["p"]) - 2)
        named = x["t"] == "[ROLE]"
        role = F.when(x["t"] == "[INST]", "user").when(x["t"] == "<s>", "assistant").otherwise(F.url_decode(F.substring_index(body, "\n", 1)))
        text = F.when(named, F.substr(body, F.instr(body, "\n") + 1)).otherwise(body)
        return F.struct(role.alias("role"), unescape(text).alias("text"), (x["t"] == "<s>").alias("loss"))

    # Joined, the control strings of whole turns leave nothing but known pairs.
    shape = F.regexp_replace(F.array_join(tokens, ""), F.lit(r"\[INST\]\[/INST\]|<s></s>|\[ROLE\]\[/ROLE\]"), F.lit(""))
    return F.when(shape == "", F.transform(opens, turn))


def format_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv, turn, role, part (rendered), escaped, and where its text under the loss mask lies in part
    (loss_start from 0, loss_length in code points; null without loss)."""
    d = rows.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    want = F.array(F.struct("role", "text", (F.col("role") == "assistant").alias("loss")))
    d = d.withColumn("plain", render(F.col("role"), F.col("text"))).withColumn("clean", F.coalesce(parse(F.col("plain")) == want, F.lit(False)))
    d = d.withColumn("part", F.when(F.col("clean"), F.col("plain")).otherwise(render(F.col("role"), escape(F.col("text")))))
    same = F.col("clean") | F.coalesce(parse(F.col("part")) == want, F.lit(False))
    d = d.withColumn("part", F.when(same, F.col("part")).otherwise(F.raise_error(F.lit("a turn does not survive formatting"))))
    loss = F.col("role") == "assistant"
    return d.select(
        "conv", "turn", "role", "part", (~F.col("clean")).alias("escaped"), F.when(loss, F.lit(4)).alias("loss_start"), F.when(loss, F.char_length("part") - 9).alias("loss_length")
    )


def format_conversations(rows: DataFrame, **names: str) -> DataFrame:
    """One row per conversation: conv, formatted. A conversation's whole text is one value, by its nature."""
    parts = format_turns(rows, **names)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "part")))
    return parts.groupBy("conv").agg(ordered.alias("parts")).select("conv", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("formatted"))


def read_back(conversations: DataFrame) -> DataFrame:
    """conv, formatted, turns: the turns that the parser recovers."""
    return conversations.select("conv", "formatted", parse(F.col("formatted")).alias("turns"))
