"""The key functions and the template parser for use from SQL.

The keys are SQL functions, which Catalyst inlines: a query that uses them has the plan of their expressions, without
Python. Templates are a table function. All are temporary, so a session registers them for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakewright.sources.feeds import template_calls

_ALNUM = "regexp_replace(lower(x), '[^a-z0-9]+', '')"
#: As `functions.text.code_key` and `number_key`.
KEYS = {
    "code_key": rf"regexp_replace({_ALNUM}, r'(^|[^0-9])0+([0-9])', '$1$2')",
    "number_key": rf"nullif(regexp_replace(regexp_replace({_ALNUM}, '^[a-z]{{1,2}}([0-9])', '$1'), '^0+([0-9a-z])', '$1'), '')",
    "numeric_part": "try_cast(nullif(regexp_replace(x, '[^0-9].*$', ''), '') AS INT)",
}


class TemplateCalls:
    """Each call of a template in a text: its place, its named parameters and the lines of the others."""

    def eval(self, text: str | None, name: str | None) -> Iterator[tuple]:
        for k, call in enumerate(template_calls(text, name) if name else []):
            yield k, dict(call["named"]), call["lines"]


def register(spark: SparkSession) -> None:
    """Registers code_key(text), number_key(text), numeric_part(text), and the table function template_calls(text, name)."""
    for name, body in KEYS.items():
        kind = "INT" if name == "numeric_part" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    table_function = F.udtf(TemplateCalls, returnType="call int, named map<string,string>, lines array<string>")
    spark.udtf.register("template_calls", table_function)
