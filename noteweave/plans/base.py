"""What the query modules share: the register, the tables and the SQL of text keys.

The SQL is written for DuckDB, whose patterns know no look-around.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noteweave.functions import text as tx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FOLD = "translate({}, '" + tx.ACCENTED + "', '" + tx.BARE + "')"
KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '[\\[\\]()\\x7B\\x7D\"''`,;:“”‘’]', ' ', 'g'), '[–—−]', '-', 'g'), ' *([/-]) *', '\\1', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
WORDS = "regexp_extract_all(" + FOLD.format("lower({0})") + ", '[\\pL\\pN_]+')"
SQUEEZE = "trim(regexp_replace({}, '[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+', ' ', 'g'))"
# a pattern without braces, as these texts are formatted several times over
STRIP = "regexp_replace(" + FOLD + ", '\\pM+', '', 'g')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, if given, its SQL under the function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
