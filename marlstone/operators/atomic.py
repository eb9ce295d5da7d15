"""All-or-nothing results in a lazy engine: rows and conflicts side by side, and a gate that looks at the conflicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "struct<document:string,record_index:int,json_path:string,category:string,code:string>"


@dataclass(frozen=True)
class Result:
    """Rows that hold only if there is no conflict."""

    rows: DataFrame
    conflicts: DataFrame

    def ok(self) -> bool:
        """One action, over the conflicts alone."""
        return self.conflicts.isEmpty()


class Rejected(Exception):
    """A gate found conflicts."""

    def __init__(self, conflicts: DataFrame):
        super().__init__("the input has conflicts")
        self.conflicts = conflicts


def gate(result: Result) -> DataFrame:
    """The rows, if there is no conflict at all."""
    if not result.ok():
        raise Rejected(result.conflicts)
    return result.rows


def issue(record: Column, path: Column, category: str, code: Column | str, document: str = "listings") -> Column:
    """An issue struct; null where the code is null."""
    code = F.lit(code) if isinstance(code, str) else code
    made = F.struct(
        F.lit(document).alias("document"), record.cast("int").alias("record_index"), path.alias("json_path"), F.lit(category).alias("category"), code.alias("code")
    )
    return F.when(code.isNotNull(), made)


def issue_rows(df: DataFrame, issues: Column) -> DataFrame:
    """The issues of an array column as rows, distinct."""
    return df.select(F.explode(issues).alias("i")).select("i.*").distinct()


def ordered_issues(issues: DataFrame) -> DataFrame:
    rank = F.when(F.col("document") == "listings", 0).otherwise(1)
    return issues.orderBy(rank, F.coalesce("record_index", F.lit(-1)), "json_path", "category", "code")
