"""Generated text columns: prompts, a pluggable batch backend, and fall-backs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlight.functions.text import strip
from trawlight.session import materialise

# A backend answers a list of message lists; None stands for no answer.
Backend = Callable[[list[list[dict]]], list[str | None]]

# Prompt wording and generation limits.
SUMMARY_PROMPT = "Please summarize the following text in 2-3 sentences:\n\n"
SUMMARY_INPUT_LENGTH = 2000
SUMMARY_OPTIONS = {"max_tokens": 150}
REWRITE_PROMPT = (
    "Rephrase or improve the following search query for better results, "
    "focusing on clarity and effectiveness. "
    "Return only the improved query, without any preamble or explanation. "
    "Original query: "
)
REWRITE_OPTIONS = {"max_tokens": 100, "temperature": 0.3}


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(prompt: Column, system: Column | None = None) -> Column:
    """The message list of a prompt; an empty or missing system text adds no message."""
    user = F.array(_message("user", prompt))
    if system is None:
        return user
    return F.when(system != "", F.array(_message("system", system), _message("user", prompt))).otherwise(user)


def generate(
    rows: DataFrame,
    messages: str,
    make_backend: Callable[..., Backend],
    output: str,
    model: str | None = None,
    **options,
) -> DataFrame:
    """Replace the ``messages`` column by the ``output`` text, NULL where none was produced.

    Equal message lists are asked once. Only they go to Python; the answers are stored and joined
    back, so a backend that answers differently each time still gives one answer, whatever reads the
    result how often. ``rows`` is read twice and must not change in between. ``make_backend(model=..., **options)``
    runs once per task. Rows with NULL messages are not sent. When a batch fails, its rows are tried one
    by one, so one bad row costs one NULL.
    """
    key = F.when(F.col(messages).isNotNull(), F.sha2(F.to_json(messages), 256))
    keyed = rows.withColumn("_asked", key)
    lists = keyed.where("_asked IS NOT NULL").groupBy("_asked").agg(F.any_value(messages).alias("_list"))

    def answer(backend: Backend, batch: list[list[dict]]) -> list[str | None]:
        try:
            answers = list(backend(batch))
            if len(answers) == len(batch):
                return answers
        except Exception:
            pass
        if len(batch) <= 1:
            return [None] * len(batch)
        return [answer(backend, [one])[0] for one in batch]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            backend = make_backend(model=model, **options)
        except Exception:
            backend = lambda batch: [None] * len(batch)
        for batch in batches:
            asked = [[dict(message) for message in one] for one in batch["_list"]]
            yield pd.DataFrame({"_asked": batch["_asked"], output: pd.Series(answer(backend, asked), dtype="object")})

    answers = materialise(lists.mapInPandas(run, f"_asked string, `{output}` string"), "answers")
    return keyed.join(answers, "_asked", "left").drop(messages, "_asked")


def summary_prompt(text: Column, enabled: bool = True) -> Column:
    """The request for a page summary; NULL when switched off or the text is empty."""
    head = F.substring(text, 1, SUMMARY_INPUT_LENGTH)
    return F.when(F.lit(enabled) & (text != ""), F.concat(F.lit(SUMMARY_PROMPT), head))


def with_summary(
    pages: DataFrame, make_backend: Callable[..., Backend] | None, model: str | None = None, enabled: bool = True
) -> DataFrame:
    """Add ``llm_summary`` from the ``text`` column; without a backend it is NULL."""
    if make_backend is None or not enabled:
        return pages.withColumn("llm_summary", F.lit(None).cast("string"))
    prompt = summary_prompt(F.col("text"), enabled)
    asked = pages.withColumn("_messages", F.when(prompt.isNotNull(), chat_messages(prompt)))
    return generate(asked, "_messages", make_backend, "llm_summary", model, **SUMMARY_OPTIONS)


def rewrite_prompt(query: Column) -> Column:
    return F.concat(F.lit(REWRITE_PROMPT), query)


def rewritten_or_original(query: Column, answer: Column) -> Column:
    """The stripped answer, or the query when the answer is missing, blank or says the same."""
    text = strip(answer)
    same = F.lower(text) == F.lower(strip(query))
    return F.when(text.isNull() | (text == "") | same, query).otherwise(text)


def rewrite_queries(
    queries: DataFrame, make_backend: Callable[..., Backend] | None, model: str | None = None
) -> DataFrame:
    """Add ``enhanced`` to a table with a ``query`` column."""
    if make_backend is None:
        return queries.withColumn("enhanced", F.col("query"))
    asked = queries.withColumn("_messages", chat_messages(rewrite_prompt(F.col("query"))))
    answered = generate(asked, "_messages", make_backend, "_answer", model, **REWRITE_OPTIONS)
    return answered.withColumn("enhanced", rewritten_or_original(F.col("query"), F.col("_answer"))).drop("_answer")
