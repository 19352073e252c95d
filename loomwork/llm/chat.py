"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags by segment.

All of it is built-in DataFrame functions. A conversation is one output row, so its turns are gathered by
their key; nothing else is. Turns are ordered by turn, then role, then text, so ties and repeated rows have a
defined order (repeated rows are turns of their own). Null texts and roles count as empty, a null turn comes
first, rows with a null conv_id form one conversation. Roles that the machine doesn't know end in its state
"reject"; such conversations are formatted too and have valid = false. Other columns are ignored, an empty
table gives no rows.

The control strings of a template begin with its mark, <| here, of two characters or more. In texts and roles a
backslash is written as two and a mark with a backslash behind its first character (in roles a line feed as \\n too), so
no text can forge a control string and reading back is exact. What stands between role and text is a line feed or begins
with the mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the role, between role and text, after the text; roles whose texts bear loss.
TEMPLATE = {"mark": "<|", "open": "<|im_start|>", "middle": "\n", "close": "<|im_end|>\n", "loss": ["assistant"]}

#: (state, role): next state. A conversation may open with system, then user and assistant take turns.
MACHINE = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
ENDS = ["user", "assistant"]


def quoted(text: str) -> str:
    """A regular expression of exactly this text."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def checked(template: dict) -> dict:
    mark = template["mark"]
    if len(mark) < 2 or "\\" in mark or not all(template[k].startswith(mark) for k in ("open", "close")) or not (template["middle"] == "\n" or template["middle"].startswith(mark)):
        raise ValueError("open and close have to begin with the mark, middle too if it isn't a line feed; a mark has two characters or more and no backslash")
    return template


def escape(text: Column, mark: str) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))


def unescape(text: Column, mark: str) -> Column:
    return F.regexp_replace(text, rf"\\(\\|{quoted(mark[1])})", "$1")


def escape_role(role: Column, mark: str) -> Column:
    return F.replace(escape(role, mark), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # \\ first becomes a character that no escaped string holds next to a backslash of its own: each escape is read once, from the left.
    parts = F.regexp_extract_all(role, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    read = lambda x: F.when(x == "\\n", "\n").when(F.length(x) == 2, F.when(x.startswith("\\"), F.substring(x, 2, 1)).otherwise(x)).otherwise(x)
    return F.array_join(F.transform(parts, read), "")


def format_chat(turns: DataFrame, template: dict = TEMPLATE, machine: dict = MACHINE, ends: list[str] = ENDS) -> DataFrame:
    """One row per conversation: conv_id, state, valid, segments (array of text and loss), formatted."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", empty("role").alias("role"), empty("text").alias("text")))).alias("turns"))
    template = checked(template)
    mark = template["mark"]
    # The state's length keeps apart which part of a key is the role.
    steps = F.create_map(*[F.lit(x) for (state, role), then in machine.items() for x in (f"{len(state)}:{state}{role}", then)])
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(steps, F.concat(F.length(s).cast("string"), F.lit(":"), s, t.role)), F.lit("reject")))
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        plain(F.concat(F.lit(template["open"]), escape_role(t.role, mark), F.lit(template["middle"]))),
        F.struct(escape(t.text, mark).alias("text"), t.role.isin(template["loss"]).alias("loss")),
        plain(F.lit(template["close"])),
    )))
    out = grouped.select("conv_id", state.alias("state"), segments.alias("segments"))
    return out.select("conv_id", "state", F.col("state").isin(ends).alias("valid"), "segments", F.array_join("segments.text", "").alias("formatted"))


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted conversation."""
    middle, mark = checked(template)["middle"], template["mark"]
    marks = F.split(formatted, quoted(template["close"]), -1)
    cut = lambda x: F.instr(x, middle)
    body = F.transform(F.slice(marks, 1, F.size(marks) - 1), lambda x: F.substring(x, len(template["open"]) + 1, F.length(x)))
    return F.transform(body, lambda x: F.struct(
        unescape_role(F.substring(x, F.lit(1), cut(x) - 1)).alias("role"), unescape(F.substring(x, cut(x) + len(middle), F.length(x)), mark).alias("text")
    ))


def read_loss(segments: Column, template: dict = TEMPLATE) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text, template["mark"])), "")


def digest(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """What is read back from the output of format_chat."""
    back = formatted.select("conv_id", "valid", read_turns(F.col("formatted"), template).alias("turns"), read_loss(F.col("segments"), template).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid",
    )
