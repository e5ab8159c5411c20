"""Column functions over messages: array<struct<role, content>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: The marks of a turn.
USER, ASSISTANT = "<|user|>\n", "<|assistant|>\n"


def of_role(messages: Column | str, role: str) -> Column:
    return F.filter(col(messages), lambda m: m["role"] == role)


def turn(messages: Column | str, role: str, index: int, strict: bool = False) -> Column:
    """Content of a role's turn, counted from 1, or from the end if negative. Without one: null, or an error if strict."""
    at = F.element_at if strict else F.try_element_at
    return at(of_role(messages, role), index if strict else F.lit(index))["content"]


def last_assistant(messages: Column | str) -> Column:
    return turn(messages, "assistant", -1)


def first_assistant(messages: Column | str) -> Column:
    return turn(messages, "assistant", 1)


def first_user(messages: Column | str) -> Column:
    return turn(messages, "user", 1)


def context(messages: Column | str) -> Column:
    """The messages before the last of the assistant; null without one."""
    m = col(messages)
    at = F.array_max(F.transform(m, lambda x, i: F.when(x["role"] == "assistant", i)))
    return F.when(at.isNotNull(), F.slice(m, 1, at))


def from_instruction(instruction: Column, input: Column, output: Column) -> Column:
    """Messages of an instruction record; missing fields are empty, an input follows after a blank line."""
    i, x, o = (F.coalesce(c, F.lit("")) for c in (instruction, input, output))
    said = F.when(x != "", F.concat(i, F.lit("\n\n"), x)).otherwise(i)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("user", said), message("assistant", o))


def rendered(messages: Column | str, eos: str, prompt: bool = False) -> Column:
    """The turns of user and assistant with their marks; other roles render nothing."""
    one = lambda m: (
        F.when(m["role"] == "user", F.concat(F.lit(USER), m["content"], F.lit("\n")))
        .when(m["role"] == "assistant", F.concat(F.lit(ASSISTANT), m["content"], F.lit(eos)))
        .otherwise("")
    )
    return F.concat(F.array_join(F.transform(col(messages), one), ""), F.lit(ASSISTANT if prompt else ""))


def prompt(text: Column | str) -> Column:
    return F.concat(F.lit(USER), col(text), F.lit("\n" + ASSISTANT))


def training_text(messages: Column | str, eos: str) -> Column:
    """Prompt of the context, then the last answer and the end mark."""
    return F.concat(rendered(context(messages), eos, prompt=True), last_assistant(messages), F.lit(eos))
