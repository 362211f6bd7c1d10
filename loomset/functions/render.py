"""Rendering of prompt/response examples to training text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the text templates.
TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>"
REASONING_LEAD = "让我们一步步思考："

# Task types that have a chat template; any other task is plain continuation.
CHAT_TASKS = ("instruction", "cot", "classification")


def _turn(role: str, content: Column) -> Column:
    return F.concat(F.lit(f"{TURN_OPEN}{role}\n"), content, F.lit(TURN_CLOSE))


def _three_turns(system: Column, prompt: Column, answer: Column) -> Column:
    return F.concat_ws(
        "\n", _turn("system", system), _turn("user", prompt), _turn("assistant", answer)
    )


def _reasoned(cot: Column, response: Column) -> Column:
    return F.concat(F.lit(REASONING_LEAD), cot, F.lit("\n"), response)


def render(task_type: str, prompt: Column, response: Column, system: Column, cot: Column) -> Column:
    """Training text of one example; the four columns must not be NULL.

    A task outside ``CHAT_TASKS`` (``text_completion``, ``chat``, …) is the
    response behind its prompt, if there is one.
    """
    if task_type == "instruction":
        return F.when(prompt != "", _three_turns(system, prompt, response)).otherwise(response)
    if task_type == "classification":
        return _three_turns(system, prompt, response)
    if task_type == "cot":
        # Without reasoning only the response is kept.
        return F.when(
            cot != "", _three_turns(system, prompt, _reasoned(cot, response))
        ).otherwise(response)
    return F.when(prompt != "", F.concat_ws("\n", prompt, response)).otherwise(response)


def chat_messages(
    task_type: str, prompt: Column, response: Column, system: Column, cot: Column
) -> Column:
    """Message array (role, content); an empty system message is left out."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    answer = response
    if task_type == "cot":
        answer = F.when(cot != "", _reasoned(cot, response)).otherwise(response)
    return F.filter(
        F.array(message("system", system), message("user", prompt), message("assistant", answer)),
        lambda m: (m["role"] != "system") | (m["content"] != ""),
    )


def render_chat(messages: Column, add_generation_prompt: bool = True) -> Column:
    """ChatML text of a message array, one line break behind each turn."""
    body = F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                F.lit(TURN_OPEN), m["role"], F.lit("\n"), m["content"], F.lit(TURN_CLOSE + "\n")
            ),
        ),
        "",
    )
    return F.concat(body, F.lit(f"{TURN_OPEN}assistant\n")) if add_generation_prompt else body
