"""Template rendering and score extraction over rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = r"\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}"


def render(template: Column, variables: Column) -> Column:
    """``{{name}}`` → the variable, or nothing when it is missing. One pass: values are never rendered again."""
    pieces = F.split(template, PLACEHOLDER, -1)
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))
    values = F.transform(names, lambda n: F.coalesce(F.try_element_at(variables, n), F.lit("")))
    return F.array_join(F.zip_with(pieces, values, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def render_messages(messages: Column, variables: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), render(m["content"], variables).alias("content")))


def fill_prompt(template: Column, input_: Column, ground_truth: Column, output: Column) -> Column:
    values = F.create_map(F.lit("input"), input_, F.lit("ground_truth"), ground_truth, F.lit("output"), output)
    return render(template, values)


def extract_score(text: Column) -> Column:
    """First number in a text."""
    return F.nullif(F.regexp_extract(text, r"-?\d+(\.\d+)?", 0), F.lit("")).try_cast("double")
