"""Token completion for llm ends that report no usage, with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

# fixed values: encodings of model names
MODEL_ENCODINGS = {
    "gpt-4o": "o200k_base", "gpt-4": "cl100k_base", "gpt-3.5-turbo": "cl100k_base", "gpt-3.5": "cl100k_base", "gpt-35-turbo": "cl100k_base",
    "davinci-002": "cl100k_base", "babbage-002": "cl100k_base",
    "text-embedding-ada-002": "cl100k_base", "text-embedding-3-small": "cl100k_base", "text-embedding-3-large": "cl100k_base",
    "text-davinci-003": "p50k_base", "text-davinci-002": "p50k_base", "text-davinci-001": "r50k_base", "text-curie-001": "r50k_base",
    "text-babbage-001": "r50k_base", "text-ada-001": "r50k_base", "davinci": "r50k_base", "curie": "r50k_base", "babbage": "r50k_base", "ada": "r50k_base",
    "code-davinci-002": "p50k_base", "code-davinci-001": "p50k_base", "code-cushman-002": "p50k_base", "code-cushman-001": "p50k_base",
    "davinci-codex": "p50k_base", "cushman-codex": "p50k_base", "text-davinci-edit-001": "p50k_edit", "code-davinci-edit-001": "p50k_edit",
    "text-similarity-davinci-001": "r50k_base", "text-similarity-curie-001": "r50k_base", "text-similarity-babbage-001": "r50k_base",
    "text-similarity-ada-001": "r50k_base", "text-search-davinci-doc-001": "r50k_base", "text-search-curie-doc-001": "r50k_base",
    "text-search-babbage-doc-001": "r50k_base", "text-search-ada-doc-001": "r50k_base", "code-search-babbage-code-001": "r50k_base",
    "code-search-ada-code-001": "r50k_base", "gpt2": "gpt2", "gpt-2": "gpt2",
}
# fixed values: encodings of model name prefixes, first match wins
PREFIX_ENCODINGS = {
    "gpt-4o-": "o200k_base", "gpt-4-": "cl100k_base", "gpt-3.5-turbo-": "cl100k_base", "gpt-35-turbo-": "cl100k_base",
    "ft:gpt-4o": "o200k_base", "ft:gpt-4": "cl100k_base", "ft:gpt-3.5-turbo": "cl100k_base", "ft:davinci-002": "cl100k_base", "ft:babbage-002": "cl100k_base",
}
DEFAULT_ENCODING = "cl100k_base"
PER_MESSAGE, PER_ROLE, REPLY = 3, 1, 3
WORD_OR_MARK = r"\w+|[^\w\s]"


def encoding_of(model: Column | str) -> Column:
    m = F.col(model) if isinstance(model, str) else model
    exact = F.create_map(*[F.lit(x) for kv in MODEL_ENCODINGS.items() for x in kv])
    prefix = F.lit(None).cast("string")
    for p, e in reversed(list(PREFIX_ENCODINGS.items())):
        prefix = F.when(m.startswith(p), F.lit(e)).otherwise(prefix)
    return F.when(m.contains("claude"), F.lit(DEFAULT_ENCODING)).otherwise(F.coalesce(F.try_element_at(exact, m), prefix, F.lit(DEFAULT_ENCODING)))


def word_count(text: Column) -> Column:
    """Default counter: words and punctuation marks, inside the JVM."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD_OR_MARK)))


def python_counter(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """Wrap any ``text → tokens`` callable, e.g. the encode of a byte-pair tokenizer."""

    @pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t)) if t is not None else 0).astype("int32")

    return count


def by_encoding(counters: dict[str, Callable[[Column], Column]], model: Column) -> Callable[[Column], Column]:
    """The counter of each model's encoding; encodings without one use the default encoding's. A counter sees
    only the texts of its own models, the others as null."""
    own = {e: c for e, c in counters.items() if e != DEFAULT_ENCODING}
    encoding, rest = encoding_of(model), counters.get(DEFAULT_ENCODING, word_count)

    def count(text: Column) -> Column:
        counts = [rest(F.when(~encoding.isin(*own), text) if own else text), *[c(F.when(encoding == e, text)) for e, c in own.items()]]
        total = F.coalesce(counts[0], F.lit(0))
        for c in counts[1:]:
            total = total + F.coalesce(c, F.lit(0))
        return total

    return count


def prompt_tokens(input_: Column, params: Column, count: Callable[[Column], Column]) -> Column:
    """Message arrays pay per message, per value and per role; other input pays for its JSON.

    Messages are joined value by value into one text with separators that count for nothing,
    so the counter runs once per run and not once per value.
    """
    msgs = F.from_json(input_, "array<map<string,string>>")
    values = F.flatten(F.transform(msgs, lambda m: F.map_values(m)))
    text = F.array_join(values, "\n")
    roles = F.size(F.filter(msgs, lambda m: F.map_contains_key(m, "role")))
    tools = F.coalesce(F.get_json_object(params, "$.functions"), F.get_json_object(params, "$.tools"))
    listed = F.size(msgs) * PER_MESSAGE + roles * PER_ROLE + count(text) + count(F.coalesce(tools, F.lit(""))) + REPLY
    return F.when(F.substring(F.ltrim(input_), 1, 1) == "[", listed).otherwise(count(input_))


def complete_tokens(runs: DataFrame, count: Callable[[Column], Column] | dict[str, Callable[[Column], Column]] = word_count) -> DataFrame:
    """Fill prompt_tokens and completion_tokens of llm runs where the reported ones are missing or 0. ``count`` is one
    counter, or one for each encoding that ``encoding_of`` may give a run's model."""
    if isinstance(count, dict):
        count = by_encoding(count, F.col("name"))
    lacking = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    out_text = F.coalesce(F.get_json_object("output", "$.text"), F.col("output"))
    llm = F.col("type") == "llm"
    return runs.withColumn(
        "prompt_tokens", F.when(llm & lacking("prompt_tokens") & F.col("input").isNotNull(), prompt_tokens(F.col("input"), F.col("params"), count)).otherwise(F.col("prompt_tokens"))
    ).withColumn(
        "completion_tokens", F.when(llm & lacking("completion_tokens") & F.col("output").isNotNull(), count(out_text)).otherwise(F.col("completion_tokens"))
    )
