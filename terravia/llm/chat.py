"""Chat formatting with typed content parts.

A conversation is a list of turns, each with a role and a list of parts: text, image,
audio or document. A visitor, one method for each kind, turns every part into a segment:
text is escaped, an attachment becomes a placeholder numbered in the order of the
conversation, and its reference and the number of tokens it will expand to are recorded.
The segments are joined by the template

    <|im_start|>role newline content <|im_end|> newline

Escaping. A control string (of this template, or one of the other common ones in
CONTROLS) inside a text gets a backslash behind its first character, and one that has
backslashes there already gets one more; reading back takes one away. So no control
string of the output comes from a text, and every text comes back as it was. Roles are
URL-encoded, which leaves plain names as they are.

The loss mask is a list of (start, end) positions in code points of the formatted text:
the contents of the assistant's turns.

Defined cases: a null text is an empty one, a null role an empty role. Turns are ordered
by turn, then role and contents; repeated rows are turns of their own. A null
conv_id is a conversation like any other. A conversation's turns meet in one row, as its
text does: its length is bounded by what one row can hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravia.llm.common import bound, running

START, END = "<|im_start|>", "<|im_end|>\n"
#: After the first character of the control strings of common templates.
CONTROLS = r"(<)(\\*)(\||/?s>|</?SYS>>)|(\[)(\\*)(/?INST\]|/?TOOL|AVAILABLE_TOOLS)"
ESCAPED = r"(<)\\(\\*)(\||/?s>|</?SYS>>)|(\[)\\(\\*)(/?INST\]|/?TOOL|AVAILABLE_TOOLS)"
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$4$2$5$3$6")


class Visitor:
    """Turns a part into a segment: struct<text, kind, uri, tokens>. Subclass it to format parts otherwise."""

    patch, tokens_a_second, tokens_a_page = 28, 25.0, 640

    def segment(self, text: Column, kind: str, uri: Column, tokens: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(kind).alias("kind"), uri.cast("string").alias("uri"), tokens.cast("long").alias("tokens"))

    def text(self, part: Column) -> Column:
        return self.segment(escape(F.coalesce(part["text"], F.lit(""))), "text", F.lit(None), F.lit(None))

    def image(self, part: Column) -> Column:
        across = lambda n: F.ceil(F.coalesce(n, F.lit(self.patch)) / self.patch)
        return self.segment(F.lit("image"), "image", part["uri"], across(part["width"]) * across(part["height"]))

    def audio(self, part: Column) -> Column:
        return self.segment(F.lit("audio"), "audio", part["uri"], F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.tokens_a_second))

    def document(self, part: Column) -> Column:
        return self.segment(F.lit("document"), "document", part["uri"], F.coalesce(part["pages"], F.lit(1)) * self.tokens_a_page)

    def visit(self, part: Column) -> Column:
        """A part of another kind is shown by its text."""
        kinds: dict[str, Callable[[Column], Column]] = {"image": self.image, "audio": self.audio, "document": self.document}
        out = self.text(part)
        for kind, method in kinds.items():
            out = F.when(part["kind"] == kind, method(part)).otherwise(out)
        return out


def text_part(text: Column) -> Column:
    empty = F.lit(None)
    return F.struct(
        F.lit("text").alias("kind"), text.alias("text"), empty.cast("string").alias("uri"), empty.cast("int").alias("width"),
        empty.cast("int").alias("height"), empty.cast("double").alias("seconds"), empty.cast("int").alias("pages"),
    )


def format_chat(turns: DataFrame, visitor: Visitor | None = None, trained: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_mask, attachments, expanded_tokens. turns: conv_id, turn, role, parts."""
    visitor = visitor or Visitor()
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.transform("parts", visitor.visit).alias("segments"))
    talks = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "segments"))).alias("turns"))
    # attachments in order, so that placeholders can be numbered
    talks = talks.withColumn("attached", F.filter(F.flatten(F.transform("turns", lambda t: t["segments"])), lambda s: s["uri"].isNotNull() | (s["kind"] != "text")))
    counts = F.transform("turns", lambda t: F.size(F.filter(t["segments"], lambda s: s["kind"] != "text")))
    several = F.size("attached") > 0
    talks = talks.withColumn("firsts", F.when(several, bound(counts, lambda n: F.zip_with(n, running(n, lambda x, y: x + y), lambda x, y: y - x))))

    def content(turn: Column, at: Column) -> Column:
        first = F.coalesce(F.get("firsts", at), F.lit(0))

        def shown(s: Column, k: Column) -> Column:
            nth = first + F.size(F.filter(F.slice(turn["segments"], F.lit(1), k), lambda x: x["kind"] != "text"))
            return F.when(s["kind"] == "text", s["text"]).otherwise(F.concat(F.lit("<|"), s["kind"], F.lit(":"), nth.cast("string"), F.lit("|>")))

        return F.array_join(F.when(several, F.transform(turn["segments"], shown)).otherwise(F.transform(turn["segments"], lambda s: s["text"])), "")

    talks = talks.withColumn("shown", F.transform("turns", lambda t, i: F.struct(F.url_encode(t["role"]).alias("role"), content(t, i).alias("content"), (t["role"] == trained).alias("trained"))))
    heads = F.transform("shown", lambda t: F.struct(F.concat(F.lit(START), t["role"], F.lit("\n")).alias("head"), t["content"].alias("content"), t["trained"].alias("trained")))
    talks = talks.withColumn("pieces", heads).drop("shown")
    ends = running(F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["content"]) + len(END)), lambda x, y: x + y)
    placed = F.zip_with("pieces", ends, lambda p, e: F.struct((e - len(END) - F.length(p["content"])).cast("long").alias("start"), (e - len(END)).cast("long").alias("end"), p["trained"].alias("trained")))
    mask = F.transform(F.filter(placed, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(END))), "").alias("formatted"),
        mask.alias("loss_mask"),
        F.transform("attached", lambda s, i: F.struct(i.cast("int").alias("placeholder"), s["kind"].alias("kind"), s["uri"].alias("uri"), s["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("attached", F.lit(0).cast("long"), lambda a, s: a + s["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted text; roles and texts are as they went in."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")
    whole = F.transform(pieces, lambda p: F.regexp_replace(p, r"<\|im_end\|>\n\z", ""))
    return F.transform(
        whole,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.locate("\n", p) + F.lit(1), F.length(p))).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask, nothing between its parts."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def op7(conversations: DataFrame) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    done = format_chat(turns.withColumn("parts", F.array(text_part(F.col("text")))))
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("under"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same figures from the turns themselves; the template's length is added up.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*(?:\||/?s>|</?SYS>>)|\[\\*(?:/?INST\]|/?TOOL|AVAILABLE_TOOLS)')) AS shown FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + shown + 11) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
