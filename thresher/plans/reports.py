"""Reports: how much text compression saves, and how many terms survive it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import text as X


def quality(spans: DataFrame, group: str, ratio_millis: int = 500) -> DataFrame:
    """Of each group of prose spans (``text``): tokens and term coverage of compression and of the first-and-last baseline."""
    prose = spans.where(X.classify(F.col("text")) == "prose")
    done = prose.withColumn("c", X.compress("text", F.lit(ratio_millis))).withColumn("b", X.first_last("text", F.lit(ratio_millis)))
    done = done.select(group, "text", F.col("c.text").alias("short"), F.col("c.input_tokens").alias("i"), F.col("c.output_tokens").alias("o"), "b")
    terms = done.select(group, "i", "o", X.token_count("b").alias("bo"), *[F.array_distinct(X.word_tokens(F.col(c))).alias(f"w_{c}") for c in ("text", "short", "b")])
    numeric = lambda c: F.filter(c, X.has_digit)
    common = lambda a, b: F.sum(F.size(F.array_intersect(a, b))).cast("long")
    return terms.groupBy(group).agg(
        F.count("*").alias("spans"),
        F.sum("i").alias("input_tokens"),
        F.sum("o").alias("output_tokens"),
        F.sum("bo").alias("baseline_tokens"),
        F.sum(F.size("w_text")).cast("long").alias("terms"),
        common(F.col("w_text"), F.col("w_short")).alias("terms_kept"),
        common(F.col("w_text"), F.col("w_b")).alias("baseline_terms_kept"),
        F.sum(F.size(numeric(F.col("w_text")))).cast("long").alias("digit_terms"),
        common(numeric(F.col("w_text")), F.col("w_short")).alias("digit_terms_kept"),
    )


def coverage(spans: DataFrame, ratio_millis: int = 500) -> DataFrame:
    """``spans`` (text) with the share of terms that the first-and-last baseline keeps."""
    both = spans.withColumn("__b", X.first_last("text", F.lit(ratio_millis)))
    return both.withColumn("coverage", X.coverage(X.word_tokens(F.coalesce("text", F.lit(""))), X.word_tokens(F.col("__b")))).drop("__b")


def agreement(left: DataFrame, right: DataFrame, key: str, group: str) -> DataFrame:
    """Of each group, how many rows (key, json) of both sides there are, and how many agree.

    Values agree if they are equal as JSON: objects in any order of keys, arrays in order, numbers by value.
    """
    sides = [df.select(key, group, M.canonical_json("json").alias(c)) for df, c in ((left, "a"), (right, "b"))]
    both = sides[0].join(sides[1], [key, group], "full")
    return both.groupBy(group).agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("long")).alias("agree"))


def dashboard(table: DataFrame, title: str) -> tuple[str, bool]:
    """An agreement table as Markdown, and whether all rows agree; a row for each group."""
    rows = table.orderBy(table.columns[0]).collect()  # one row for each group of a report
    lines = [f"# {title}", "", "| " + " | ".join(table.columns) + " | match |", "|" + "---|" * (len(table.columns) + 1)]
    lines += ["| " + " | ".join(str(v) for v in r) + f" | {'yes' if r['rows'] == r['agree'] else 'no'} |" for r in rows]
    return "\n".join(lines) + "\n", all(r["rows"] == r["agree"] for r in rows)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines, a file for each partition."""
    report.write.mode("overwrite").json(path)


def workload(stats: DataFrame, usd_per_1000: float) -> DataFrame:
    """One row: lists, tokens before and after, the share saved, and what that costs."""
    out = stats.agg(F.count("*").alias("lists"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = lambda c: F.col(c) / 1000 * usd_per_1000
    saved = F.col("input_tokens") - F.col("output_tokens")
    percent = F.when(F.col("input_tokens") > 0, saved / F.col("input_tokens") * 100).otherwise(F.lit(0.0))
    return out.withColumns({"saved_tokens": saved, "saved_percent": percent, "cost_before": cost("input_tokens"), "cost_after": cost("output_tokens"), "cost_saved": saved / 1000 * usd_per_1000})
