r"""Chat formatting as relational expressions.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role share a pair of marks. The output looks like::

    <|im_start|>user
    first text<|im_sep|>second text<|im_end|>
    <|im_start|>assistant
    answer<|im_end|>

Strings of this and of other common templates are escaped inside texts and
roles: a backslash follows their first character, one more if backslashes
are there already. So the escape adds to hardly any text, takes nothing
away, and is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What follows the first character of a control string.
_REST = r"(/?s>|<?/?SYS>>|\|\w+\|>|/?INST\])"
ESCAPE = (r"([<\[])(\\*)" + _REST, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def escape(text: Column) -> Column:
    """A text without any control string; ``unescape`` gives it back."""
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _role_in(role: Column) -> Column:
    """A role on one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss.

    ``loss`` has a flag for each turn in the order of the output: whether its
    text, as ``read_chats`` returns it, is trained on. Turns sort by number,
    then role, then text, nulls first; rows that repeat a turn are turns of
    their own. A null text or role counts as empty; a null conversation id is
    a conversation. An empty table gives no rows; other columns are ignored.

    A conversation's formatted text is one value by its nature. Turns are
    escaped before the shuffle, and no step is quadratic in their number.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
        ).alias("at"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("at")).alias("turns"))
    roles = grouped.select("conv_id", "turns", F.transform("turns", lambda t: t["role"]).alias("roles"))

    def piece(turn: Column, i: Column) -> Column:
        opens = F.concat(F.lit(START), _role_in(turn["role"]), F.lit("\n"), turn["text"])
        same = F.get(F.col("roles"), i - 1) == turn["role"]
        return F.when(i == 0, opens).when(same, F.concat(F.lit(SEP), turn["text"])).otherwise(F.concat(F.lit(END), opens))

    return roles.select(
        F.col("conv_id").alias(conv_col),
        F.concat(F.array_join(F.transform("turns", piece), ""), F.lit(END)).alias("formatted"),
        F.transform("roles", lambda r: r == F.lit(loss_role)).alias("loss"),
    )


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs of role and text."""
    groups = F.split(formatted, r"\Q" + END + r"\E", -1)
    groups = F.slice(groups, 1, F.size(groups) - 1)

    def parts(group: Column) -> Column:
        role = F.substring_index(group, "\n", 1)
        body = F.substring(group, F.length(role) + 2, F.length(group))
        said = F.split(body, r"\Q" + SEP + r"\E", -1)
        return F.transform(
            said, lambda x: F.struct(_role_out(F.substring(role, F.lit(len(START) + 1), F.length(role))).alias("role"), unescape(x).alias("text"))
        )

    return F.flatten(F.transform(groups, parts))
