"""Lines of documents and their kinds: bullet, heading or body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import WS, strip

# The line forms of the segmentation rules. Written without look-ahead, for engines that have none:
# group 1 of HEADING is the id, group 2 what follows; the first character of that is consumed instead.
BULLET = rf"^[{WS}]*(?:[•–—*\-]|[a-z]\)|[ivxlc]+\)|\([0-9]+\))[{WS}]+"
HEADING = (
    r"(?s)^("
    rf"Section[{WS}]+\p{{Nd}}[\p{{Nd}}.]*"
    r"|[A-Z]-\p{Nd}[\p{Nd}.]*"
    r"|\p{Nd}+(?:\.\p{Nd}+)+"
    r"|\p{Nd}+"
    rf")(?:[{WS}]*[.:]?[{WS}]+|[{WS}]*\z)((?:[^\p{{Nd}}a-z].*)?)\z"
)
FAKE = rf"^\p{{Nd}}+\.[{WS}]+[a-z]"
#: How each line that HEADING matches begins; cheaper to test.
MAYBE = r"^(?:Section|[A-Z]-|\p{Nd})"
MARK = "\u0000"
TITLE_WORDS, NOISE_CHARS = 7, 20
#: Why a line that looks like a heading is body text; the first that holds counts.
VETOES = ("fake", "lowercase_title", "year", "bad_first_char", "long_title", "colon_end", "bare_integer", "noise")


def explode_lines(docs: DataFrame, text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, line_no, line, stripped) for the lines that aren't blank, and the columns ``carried``; numbers count blank lines too, from 0."""
    lines = docs.select("doc_id", *carried, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("stripped", strip("line")).where("stripped <> ''")


def veto(line: Column, heading_id: Column, rest: Column) -> Column:
    """The name of the first veto against a line that matches the heading pattern; null if it stands."""
    single, titled = heading_id.rlike(r"^\p{Nd}+\z"), rest != ""
    tests = {
        "fake": line.rlike(FAKE),
        "lowercase_title": single & F.substring(rest, 1, 1).rlike(r"\p{IsLowercase}"),
        "year": heading_id.rlike(r"^(?:19|20)\p{Nd}{2}\z"),
        "bad_first_char": single & titled & ~rest.rlike(r"^[\p{IsUppercase}\p{Nd}\"'(]"),
        "long_title": single & titled & (F.size(F.split(rest, rf"[{WS}]+", -1)) > TITLE_WORDS),
        "colon_end": single & rest.endswith(":"),
        "bare_integer": single & ~titled,
        "noise": F.substring(rest, 1, NOISE_CHARS).rlike(rf"[^\p{{L}}\p{{N}}_.:\-{WS}]"),
    }
    out = F.lit(None).cast("string")
    for name in reversed(VETOES):
        out = F.when(tests[name], name).otherwise(out)
    return out


def classify(lines: DataFrame) -> DataFrame:
    """Adds kind ('bullet', 'heading' or 'body'), heading_id, title and veto to rows with line and stripped.

    heading_id and title are null but for headings; veto tells why a line that matches the heading
    pattern is body text.
    """
    # one pass of the pattern gives both groups; a line that it doesn't match stays as it is, without the mark in front
    marked = F.when(F.col("stripped").rlike(MAYBE), F.regexp_replace("stripped", F.lit(HEADING), F.lit(f"{MARK}$1{MARK}$2")))
    found = lines.withColumns({"_groups": F.when(marked.startswith(MARK), F.split(marked, MARK, 3)), "_bullet": F.col("line").rlike(BULLET)})
    found = found.withColumns({"_id": F.coalesce(F.col("_groups")[1], F.lit("")), "_rest": strip(F.coalesce(F.col("_groups")[2], F.lit("")))}).drop("_groups")
    found = found.withColumn("veto", F.when((F.col("_id") != "") & ~F.col("_bullet"), veto(F.col("stripped"), F.col("_id"), F.col("_rest"))))
    heads = (F.col("_id") != "") & F.col("veto").isNull()
    found = found.withColumn("kind", F.when(F.col("_bullet"), "bullet").when(heads, "heading").otherwise("body"))
    own = lambda c: F.when(F.col("kind") == "heading", F.col(c))
    return found.withColumns({"heading_id": own("_id"), "title": own("_rest")}).drop("_id", "_rest", "_bullet")
