"""Named and numbered sections of long documents, cleaning and validators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^#{2,}[^\n]*$", " "), r"\s+", " "))


def split_sections(docs: DataFrame, names: Sequence[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, section, found, content): from `## name` to the next listed heading or the end; sub-headings go.

    The first occurrence of a heading counts. A missing section is a row with found false.
    """
    body = F.concat(F.lit("\n"), F.col(text), F.lit("\n"))
    mark = {n: F.instr(body, f"\n## {n}\n") for n in names}
    rows = []
    for n in names:
        start = mark[n]
        ends = [F.when(m > start, m) for o, m in mark.items() if o != n]
        end = F.coalesce(F.least(*ends) if len(ends) > 1 else ends[0], F.length(body) + 1) if ends else F.length(body) + 1
        content = F.when(start > 0, _clean(F.substring(body, start + len(n) + 4, end - start - len(n) - 4)))
        rows.append(F.struct(F.lit(n).alias("section"), (start > 0).alias("found"), content.alias("content")))
    return docs.select(key, F.explode(F.array(*rows)).alias("s")).select(key, "s.*")


def split_numbered(docs: DataFrame, numbers: Sequence[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, number, found, content): from a line `N.N Title` to the next such line; page numbers, dot leaders and blank lines go.

    The first line with a number counts. All work is on the row itself, and no line is shuffled. A number
    whose section holds nothing but such noise counts as not found.
    """
    lines = F.split(text, "\n")
    at = F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.regexp_extract(line, r"^\s*(\d+\.\d+)\s+\S", 1).alias("number")))
    headed = docs.select(key, lines.alias("lines"), F.filter(at, lambda x: x["number"] != "").alias("heads"))
    starts = headed.select(key, "lines", "heads", F.explode(F.array(*map(F.lit, numbers))).alias("number"))
    start = F.try_element_at(F.filter("heads", lambda x: x["number"] == F.col("number")), F.lit(1))["i"]
    end = F.coalesce(F.try_element_at(F.filter("heads", lambda x: x["i"] > F.col("start")), F.lit(1))["i"], F.size("lines"))
    part = F.slice("lines", F.col("start") + 1, F.col("end") - F.col("start"))
    noise = lambda line: line.rlike(r"^\s*\d*\s*$") | line.rlike(r"\.{4,}")
    shown = F.transform(part, lambda line, i: F.when(~noise(line), F.trim(F.when(i == 0, F.regexp_replace(line, r"^\s*\d+\.\d+\s+", "")).otherwise(line))))
    kept = F.filter(shown, lambda line: line.isNotNull())
    cut = starts.withColumn("start", start).withColumn("end", end).select(key, "number", F.when(F.col("start").isNotNull(), kept).alias("l"))
    found = F.coalesce(F.size("l") > 0, F.lit(False))
    return cut.select(key, "number", found.alias("found"), F.when(found, F.array_join("l", "\n")).alias("content"))


def validate_sections(sections: DataFrame, required: Sequence[str], min_len: int = 20, key: str = "doc_id") -> DataFrame:
    """(key, section, problem): required sections that are missing, and ones that are too short."""
    missing = sections.where(F.col("section").isin(list(required)) & ~F.col("found")).select(key, "section", F.lit("missing").alias("problem"))
    short = sections.where(F.col("found") & (F.length("content") < min_len)).select(key, "section", F.lit("short").alias("problem"))
    return missing.unionByName(short)


def clean_text(df: DataFrame, col: str = "text") -> DataFrame:
    """White space folded, and only letters, digits, underscores, blanks and .,!? kept; letters of any script."""
    return df.withColumn(col, F.trim(F.regexp_replace(F.regexp_replace(col, r"\s+", " "), r"[^\p{L}\p{N}_\s.,!?]", "")))


def format_sections(sections: DataFrame, order: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(key, training_text): `### NAME`, content, for each section found, in the order of the list."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("section"))
    one = F.concat(F.lit("### "), F.upper("section"), F.lit("\n"), F.col("content"), F.lit("\n"))
    return sections.where("found").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct(at.alias("at"), one.alias("t"))))["t"], "\n").alias("training_text"))


def is_address(col: str) -> Column:
    return F.col(col).rlike(r"^0x[a-fA-F0-9]{40}$")


def is_url(col: str) -> Column:
    return F.col(col).rlike(r"^https?://[A-Za-z0-9.-]+(:\d+)?(/\S*)?([?#]\S*)?$")


def is_config_shape(col: str) -> Column:
    """A JSON object whose values are strings, lists or objects."""
    parsed = F.try_parse_json(F.col(col))
    shape = F.schema_of_variant(parsed)
    kinds = F.regexp_extract_all(shape, F.lit(r"(?:^OBJECT<|, )[^:<>]+: ([A-Z]+)"), F.lit(1))
    return F.coalesce(shape.startswith("OBJECT") & F.forall(kinds, lambda k: k.isin("STRING", "ARRAY", "OBJECT", "VOID")), F.lit(False))


def validate_values(df: DataFrame, address: str, url: str, shape: str) -> DataFrame:
    """Add ok_address, ok_url and ok_shape."""
    return df.withColumns({"ok_address": is_address(address), "ok_url": is_url(url), "ok_shape": is_config_shape(shape)})
