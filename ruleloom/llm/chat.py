"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a row (conversation, turn, role, parts); a part is a struct of PART: kind text, image, audio or
document, the text of a text part, the reference of any other, and its measures. The visitor walks the parts
in order and turns each into a piece of the prompt: text parts that follow one another into one escaped text, any other
into the placeholder of its kind, whose reference and expanded token count are recorded as an attachment.

    <|turn|>role<|says|>pieces</s>

Control strings inside texts and roles are escaped reversibly: a backslash becomes two, and one is put behind
the first character of a control string. No control string is left in escaped text, so the output can be cut
at its marks and read back exactly.

Edge cases: null text or role is empty; a null part or an unknown kind is an empty piece that does not part the texts
around it; a conversation's rows go by turn (null first), then role, then unescaped text; equal rows stay, each as a turn
of its own; a null conversation id is a conversation; an empty table gives no rows; texts of any length are
formatted whole; a conversation is one row of the result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "</s>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Control strings of common chat templates, besides the marks above; none may pass unescaped from a text.
FOREIGN = ("<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
CONTROL = (TURN, SAYS, END, *PLACEHOLDER.values(), *FOREIGN)
PART = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens of a part: one for each patch of an image, each frame of audio, and so many for a page.
PATCH, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 14, 25, 256


def _quoted(x: str) -> str:
    return "".join("\\" + c if c in "|[]/<>\\.*+?()^$" else c for c in x)


def escape(text: Column) -> Column:
    """The text with backslashes doubled and control strings broken by one."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for first in sorted({c[0] for c in CONTROL}):
        rest = "|".join(_quoted(c[1:]) for c in CONTROL if c[0] == first)
        out = F.regexp_replace(out, f"{_quoted(first)}({rest})", f"{first}\\\\$1")
    return out


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, "\\\\(\\\\?)", "$1")


def text_part(text: str | Column) -> Column:
    """A plain text as an array of one part."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


_PIECES = "array<struct<text:string,mark:string>>"


def pieces(parts: Column) -> Column:
    """What the visitor makes of the parts: (text, mark) pieces, each the text before a placeholder and the placeholder.

    Texts that no placeholder parts are one text, so what is split over their seam is seen by escape().
    """
    def visit(done: Column, part: Column) -> Column:
        mark = F.lit(None).cast("string")
        for kind, place in PLACEHOLDER.items():
            mark = F.when(part["kind"] == kind, F.lit(place)).otherwise(mark)
        said = F.when(part["kind"] == "text", F.coalesce(part["text"], F.lit(""))).otherwise(F.lit(""))
        last = F.element_at(done, -1)
        grown = F.struct(F.concat(last["text"], said).alias("text"), mark.alias("mark"))
        fresh = F.struct(said.alias("text"), mark.alias("mark"))
        return F.when((F.size(done) > 0) & last["mark"].isNull(), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    return F.aggregate(parts, F.array().cast(_PIECES), visit)


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment takes in the model's input: at least one; missing measures count as 1."""
    one = lambda x: F.greatest(F.coalesce(x, F.lit(1)), F.lit(1))
    image = F.ceil(one(part["width"]) / PATCH) * F.ceil(one(part["height"]) / PATCH)
    audio = F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES_PER_SECOND), F.lit(1))
    return F.when(part["kind"] == "image", image).when(part["kind"] == "audio", audio).when(part["kind"] == "document", one(part["pages"]) * TOKENS_PER_PAGE).otherwise(0).cast("long")


def format_chats(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", loss_role: str = "assistant") -> DataFrame:
    """Format each conversation; messages: conversation, turn, role, parts (PART).

    Returns conversation, formatted (string), n_turns, loss_spans: array of (turn, offset, start, length), the
    code points of formatted from start on (offset: within the turn) that a model is trained on, and attachments:
    array of (turn, ordinal, kind, ref, tokens), and attachment_tokens, their sum.
    """
    none = F.lit("")
    said = pieces(F.coalesce("parts", F.array().cast(PART)))
    rows = messages.select(
        F.col(conversation).alias("c"),
        F.col(turn).alias("t"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(said, lambda x: F.concat(x["text"], F.coalesce(x["mark"], none))), "").alias("raw"),
        F.array_join(F.transform(said, lambda x: F.concat(escape(x["text"]), F.coalesce(x["mark"], none))), "").alias("body"),
        F.transform(F.filter(F.coalesce("parts", F.array().cast(PART)), lambda p: p["kind"].isin(*PLACEHOLDER)), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))).alias("files"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)))
    turns = F.sort_array(F.collect_list(F.struct("t", "role", "raw", "body", "head", "files")))
    chats = rows.groupBy("c").agg(turns.alias("turns"))
    # where each turn starts: running sums of the turns' lengths
    lengths = F.transform("turns", lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END))
    chats = chats.withColumn("lengths", lengths).withColumn("starts", _running("lengths"))
    chats = chats.withColumn("formatted", F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""))
    spans = F.transform("turns", lambda x, i: F.struct(i.alias("turn"), F.length(x["head"]).alias("offset"), (F.get("starts", i) + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"), x["role"].alias("role")))
    spans = F.transform(F.filter(spans, lambda s: s["role"] == loss_role), lambda s: s.dropFields("role"))
    files = F.flatten(F.transform("turns", lambda x, i: F.transform(x["files"], lambda f, k: F.struct(i.alias("turn"), k.alias("ordinal"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return chats.select(
        F.col("c").alias(conversation),
        "formatted",
        F.size("turns").cast("long").alias("n_turns"),
        spans.alias("loss_spans"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("attachment_tokens"),
    )


def _running(lengths: str) -> Column:
    """Start of each item when items of these lengths follow one another."""
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))
    return F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")), step, lambda a: a["starts"])


def _turns(formatted: Column) -> Column:
    pieces = F.split(formatted, _quoted(TURN))
    return F.slice(pieces, F.lit(2), F.size(pieces))


def read_back(formatted: str | Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped. Placeholders stay in the text."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted
    halves = F.transform(_turns(formatted), lambda x: F.split(F.substring(x, F.lit(1), F.length(x) - len(END)), _quoted(SAYS), 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def loss_texts(formatted: str, spans: str) -> Column:
    """The unescaped texts under the loss mask, cut from the formatted string, in order."""
    turns = _turns(F.col(formatted))
    return F.transform(spans, lambda s: unescape(F.substring(F.get(turns, s["turn"]), s["offset"] - len(TURN) + 1, s["length"])))


def digests(chats: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What op1_chat_formatting returns, read back from the output of format_chats()."""
    out = chats.withColumns({"turns": read_back("formatted"), "learnt": F.array_join(loss_texts("formatted", "loss_spans"), "")})
    return out.select(
        conversation,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "attachment_tokens",
    )


#: The conversation that the query adds: both turns say what another template would take for control strings.
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def sql() -> str:
    """DuckDB SQL for op1_chat_formatting."""
    escaped = "replace({x}, '\\', '\\\\')"
    for first in sorted({c[0] for c in CONTROL}):
        rest = "|".join(_quoted(c[1:]) for c in CONTROL if c[0] == first)
        escaped = f"regexp_replace({escaped}, '{_quoted(first)}({rest})', '{first}\\\\\\1', 'g')"
    planted = " UNION ALL ".join(f"SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in PLANTED)
    marks = len(TURN) + len(SAYS) + len(END)
    return f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL {planted}),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
  sum({marks} + length({escaped.format(x="role")}) + length({escaped.format(x="text")})) AS formatted_chars
  FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens FROM g"""
