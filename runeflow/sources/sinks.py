"""Writers of tagged text, XML and model tables (IO)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runeflow.operators.rules import escaped

VERSION = "1"


def wtl_lines(tokens: DataFrame) -> DataFrame:
    """IO14: ``word TAB tag TAB lemma`` lines; the lemma defaults to the lower-cased word."""
    return tokens.select(F.concat_ws("\t", "tok", "tag", F.coalesce("lemma", F.lower("tok"))).alias("value"))


def marked(tok: Column, is_marked: Column, mode: str) -> Column:
    """IO15: a token in one of the output modes plain, html, xml."""
    if mode == "plain":
        return F.when(is_marked, F.concat(F.lit("*"), tok, F.lit("*"))).otherwise(tok)
    tag = {"html": "b", "xml": "emph"}[mode]
    return F.when(is_marked, F.concat(F.lit(f"<{tag}>"), escaped(tok), F.lit(f"</{tag}>"))).otherwise(escaped(tok))


def element(name: str, content: Column, **attributes: Column) -> Column:
    """IO16: an XML element; content is taken as it is, attributes are escaped."""
    attrs = [x for k, v in attributes.items() for x in (F.lit(f' {k}="'), escaped(v.cast("string")), F.lit('"'))]
    return F.concat(F.lit(f"<{name}"), *attrs, F.lit(">"), content, F.lit(f"</{name}>"))


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """IO8: fitted tables as Parquet, with the version that wrote them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    next(iter(tables.values())).sparkSession.createDataFrame([(VERSION, sorted(tables))], "version string, tables array<string>").write.mode("overwrite").json(f"{path}/_model")


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """IO8: the tables of a saved model; another version is an error."""
    m = spark.read.schema("version string, tables array<string>").json(f"{path}/_model").first()
    if m["version"] != VERSION:
        raise ValueError(f"model version {m['version']}, expected {VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in m["tables"]}
