"""Reading the given tables, and the page bodies composed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sectioned(text: Column) -> Column:
    """Lines of a document as paragraphs under h2 headings."""
    return F.concat(F.lit("<p>"), F.replace(text, F.lit("\n"), F.lit("</p><h2>Part</h2><p>")), F.lit("</p>"))


SQL_SECTIONED = "'<p>' || replace(text, chr(10), '</p><h2>Part</h2><p>') || '</p>'"


def definition_list(text: Column) -> Column:
    """Lines of a document as alternating terms and definitions."""
    lines = F.split(text, "\n")
    return F.concat(
        F.lit("<dl>"),
        F.array_join(
            F.transform(
                lines,
                lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("<dt>"), x, F.lit("</dt>"))).otherwise(
                    F.concat(F.lit("<dd>"), x, F.lit("</dd>"))
                ),
            ),
            "",
        ),
        F.lit("</dl>"),
    )


SQL_DEFINITIONS = (
    "'<dl>' || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: "
    "case when (i - 1) % 2 = 0 then '<dt>' || x || '</dt>' else '<dd>' || x || '</dd>' end), '') || '</dl>'"
)
