"""Validation of DataFrames: verdicts, error columns, quarantine, and the exact slow path for JSON text."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.interpreter import SchemaError, Validator, parse_json
from ..plans.compiler import ERROR, Compiler, UnsupportedSchema

ERRORS = T.ArrayType(ERROR)


@dataclass(frozen=True)
class Compiled:
    """A schema with its options. columns=None stands for all columns of the frame it is applied to."""

    schema: dict | bool
    formats: tuple[str, ...] | str = ()
    documents: dict = field(default_factory=dict)
    null_means: str = "absent"

    def compiler(self) -> Compiler:
        return Compiler(self.schema, self.formats, self.documents, self.null_means)

    def interpreter(self) -> Validator:
        return Validator(self.schema, self.formats, self.documents)


def compile_schema(schema, formats=(), documents: dict | None = None, null_means: str = "absent") -> Compiled:
    """Checks what can be checked without data: references lead somewhere."""
    own = Compiled(schema, formats if formats == "all" else tuple(formats), documents or {}, null_means)
    own.interpreter()
    return own


def _row(df: DataFrame) -> tuple[Column, T.DataType]:
    return F.struct(*(F.col(f"`{f.name}`") for f in df.schema.fields)), df.schema


def is_valid(df: DataFrame, cs: Compiled, column: str | None = None) -> Column:
    """The verdict on each row as an object of its columns, or on one column."""
    col, dtype = _row(df) if column is None else (F.col(column), df.schema[column].dataType)
    return cs.compiler().valid(col, dtype)


def errors(df: DataFrame, cs: Compiled, column: str | None = None) -> Column:
    col, dtype = _row(df) if column is None else (F.col(column), df.schema[column].dataType)
    return cs.compiler().errors(col, dtype)


def validate(df: DataFrame, cs: Compiled, column: str | None = None, to: str = "_errors") -> DataFrame:
    """df with the column of errors; where the schema has no exact expression, the interpreter runs on JSON text."""
    try:
        return df.withColumn(to, errors(df, cs, column))
    except UnsupportedSchema:
        value = _row(df)[0] if column is None else F.col(column)
        # to_json leaves out null fields, which is what a null column means here
        return validate_json(df.withColumn("__tessera_json", F.to_json(value)), cs, "__tessera_json", to).drop("__tessera_json")


def validate_json(df: DataFrame, cs: Compiled, column: str, to: str = "_errors") -> DataFrame:
    """Errors of JSON text by the interpreter, Arrow batches at a time; null text has none, broken text has one."""
    schema, formats, documents = json.dumps(cs.schema), cs.formats, json.dumps(cs.documents)

    @F.pandas_udf(ERRORS)
    def run(texts):
        import pandas as pd

        own = Validator(json.loads(schema), formats, json.loads(documents))

        def one(t):
            if t is None:
                return []
            try:
                value = parse_json(t)
            except ValueError:
                return [{"message": "must be JSON", "path": ""}]
            return own.errors(value)

        return pd.Series([one(t) for t in texts])

    return df.withColumn(to, run(F.col(column)))


def split(df: DataFrame, cs: Compiled, column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, the other rows with _errors)."""
    try:
        ok = is_valid(df, cs, column)
        return df.where(ok), df.where(~ok).withColumn("_errors", errors(df, cs, column))
    except UnsupportedSchema:
        checked = validate(df, cs, column)
        return checked.where(F.size("_errors") == 0).drop("_errors"), checked.where(F.size("_errors") > 0)


def explode_errors(df: DataFrame, *keys: str, first_only: bool = False, errors_in: str = "_errors") -> DataFrame:
    """(keys, ord, message, path): a row for each error."""
    own = F.slice(errors_in, 1, 1) if first_only else F.col(errors_in)
    return df.select(*keys, F.posexplode(own).alias("ord", "e")).select(*keys, "ord", "e.message", "e.path")


def assert_valid(df: DataFrame, cs: Compiled, column: str | None = None) -> DataFrame:
    """df; reading it fails at the first row that is not valid, with that row's errors."""
    checked = validate(df, cs, column)
    fine = F.when(F.size("_errors") == 0, F.lit(True)).otherwise(F.raise_error(F.to_json("_errors")).cast("boolean"))
    return checked.where(fine).drop("_errors")


def summary(findings: DataFrame, *by: str) -> DataFrame:
    """Counts by the given columns; partial sums are taken before rows move."""
    return findings.groupBy(*by).agg(F.count("*").alias("n"))


__all__ = ["Compiled", "SchemaError", "UnsupportedSchema", "assert_valid", "compile_schema", "errors", "explode_errors", "is_valid", "split", "summary", "validate", "validate_json"]
