"""Chat formatting of typed content parts.

A turn's content is an array of parts: text, image, audio or document. A visitor flattens
them in order: text is escaped, every other part becomes a placeholder with its position,
``[IMG:1]``, and is recorded as an attachment with its reference and the number of tokens
that it expands to. Parts are joined by ``[+]`` and a turn is

    [INST] role [/INST] parts </s>      (without the blanks)

Control strings inside texts and roles get a backslash behind their first character, those
that have backslashes there one more, so taking one away gives back every text. The loss
mask lists, per turn, where the texts of assistant turns stand. All of it is DataFrame
functions: parts are visited in the turn's own row, before turns meet; a conversation is
gathered once, as its formatted text must be one value (at most 2 GB, Spark's bound).

Null text and role are ''; a null or empty content is one empty text. A null conv_id is a
conversation of its own. Turns are sorted by turn (null first), equal ones by role and
text, so repeated rows stay repeated turns in a fixed order; an empty table gives an empty
result. Columns other than conv_id, turn, role and text or content are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END, JOIN = "[INST]", "[/INST]", "</s>", "[+]"
#: Kinds of attachments and the names of their placeholders.
PLACEHOLDERS = {"image": "IMG", "audio": "AUDIO", "document": "DOC"}
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

_NAMES = "|".join(PLACEHOLDERS.values())
_BODIES = r"/?s>", rf"(?:/?INST|\+|(?:{_NAMES}):[0-9]+)\]"
_ESCAPE = rf"<(?=\\*{_BODIES[0]})|\[(?=\\*{_BODIES[1]})"
_UNESCAPE = rf"(<(?=\\+{_BODIES[0]})|\[(?=\\+{_BODIES[1]}))\\"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def expanded_tokens(part: Column, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 1024) -> Column:
    """Tokens behind a placeholder: an image's patches, an audio's frames, a document's pages."""
    number = lambda c: F.coalesce(c, F.lit(0))
    image = F.ceil(number(part["width"]) / patch) * F.ceil(number(part["height"]) / patch)
    return (F.when(part["kind"] == "image", image)
            .when(part["kind"] == "audio", F.ceil(number(part["seconds"]) * audio_rate))
            .when(part["kind"] == "document", number(part["pages"]).cast("long") * page_tokens)
            .otherwise(F.lit(0)).cast("long"))


def text_parts(text: Column) -> Column:
    """A plain text as content: one text part."""
    none = {f: F.lit(None).cast(t) for f, t in (("ref", "string"), ("width", "int"), ("height", "int"),
                                                ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            *[c.alias(f) for f, c in none.items()]))


def _placeholder(part: Column, i: Column) -> Column:
    name = None
    for kind, label in PLACEHOLDERS.items():
        name = F.when(part["kind"] == kind, label) if name is None else name.when(part["kind"] == kind, label)
    return F.concat(F.lit("["), name, F.lit(":"), i.cast("string"), F.lit("]"))


def visit(content: Column) -> tuple[Column, Column]:
    """A turn's flattened parts as strings, and its attachments.

    A part of no known kind is a text; nothing is left out.
    """
    known = lambda p: F.coalesce(p["kind"].isin(*PLACEHOLDERS), F.lit(False))
    strings = F.transform(content, lambda p, i: F.when(known(p), _placeholder(p, i)).otherwise(
        escape(F.coalesce(p["text"], F.lit("")))))
    attachments = F.filter(F.transform(content, lambda p, i: F.when(known(p), F.struct(
        i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("n_tokens")))),
        lambda a: a.isNotNull())
    return strings, attachments


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss, attachments, attachment_tokens.

    ``turns`` has conv_id, turn, role and either content (an array of PART) or text.
    ``loss``: (turn, start, length) of each text under the mask, in code points from the
    turn's first one. ``attachments``: (turn, part, kind, ref, n_tokens) in order.
    """
    if "content" in turns.columns:
        empty = text_parts(F.lit(""))
        content = F.when(F.size(F.coalesce("content", F.array().cast(f"array<{PART}>"))) > 0, F.col("content")).otherwise(empty)
    else:
        content = text_parts(F.col("text"))
    d = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), content.alias("content"))
    strings, attachments = visit(F.col("content"))
    d = d.select("conv_id", "turn", "role", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"),
                 strings.alias("parts"), attachments.alias("attachments"))
    # Where each part begins: lengths of those before it, a turn's parts being few.
    begin = lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.char_length("head").cast("long"),
                                  lambda a, p: a + F.char_length(p) + len(JOIN))
    masked = F.transform("parts", lambda p, i: F.struct(begin(i).alias("start"), F.char_length(p).cast("long").alias("length"),
                                                        i.alias("part")))
    shown = F.filter(masked, lambda x: ~F.exists("attachments", lambda a: a["part"] == x["part"]))
    loss = F.when(F.col("role") == loss_role, shown).otherwise(F.filter(masked, lambda x: F.lit(False)))
    d = d.select("conv_id", F.struct(
        "turn", "role", F.concat("head", F.array_join("parts", JOIN), F.lit(END)).alias("piece"),
        loss.alias("loss"), "attachments").alias("t"))
    chats = d.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    spans = F.flatten(F.transform("turns", lambda t, i: F.transform(t["loss"], lambda x: F.struct(
        i.alias("turn"), x["start"].alias("start"), x["length"].alias("length")))))
    found = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(
        i.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"),
        a["n_tokens"].alias("n_tokens")))))
    pieces = F.transform("turns", lambda t: t["piece"])
    return chats.select("conv_id", F.array_join(pieces, "").alias("formatted"), spans.alias("loss"),
                        found.alias("attachments")).withColumn(
        "attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]))


def _pieces(formatted: Column) -> Column:
    """A formatted chat's turns; the last one's end leaves an empty string behind."""
    cut = F.split(formatted, END)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def read_turns(formatted: Column) -> Column:
    """Array of (role, parts) of a formatted chat: texts unescaped, placeholders as they stand."""
    def turn(piece):
        role = F.split_part(F.substr(piece, F.lit(len(OPEN) + 1)), F.lit(CLOSE), F.lit(1))
        body = F.substr(piece, F.char_length(role) + len(OPEN) + len(CLOSE) + 1)
        parts = F.transform(F.split(body, r"\[\+\]", -1), unescape)
        return F.struct(unescape(role).alias("role"), parts.alias("parts"))
    return F.transform(_pieces(formatted), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """Texts under the mask, unescaped, in order."""
    pieces = _pieces(formatted)
    return F.transform(loss, lambda x: unescape(F.substr(F.get(pieces, x["turn"]), x["start"] + 1, x["length"])))
