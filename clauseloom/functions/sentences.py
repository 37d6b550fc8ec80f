"""Sentences, and the short context that the first of them make."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions.text import WS, replace, strip
from clauseloom.functions.words import ABBREVIATIONS

MARK = "\u0001"
BOUNDARY = rf"([.?!]+[\"'”’)\]}}]*)([{WS}]+)"
INITIAL = r"(?:^|[^\p{L}\p{N}])\p{Lu}\.\z"
NUMBER = r"(?:^|[^\p{L}\p{N}])\p{Nd}+\.\z"


def abbreviated(abbreviations: tuple[str, ...]) -> str:
    names = "|".join(a.replace(".", r"\.") for a in abbreviations)
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}.])(?:{names})\.\z"


def context(text: Column | str, sentences: int = 2, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """The first sentences of a text, joined by a space; '' for a text without any.

    Text is cut behind periods, question and exclamation marks (and closing quotes or brackets) that white
    space follows; a piece goes on if it ends with an abbreviation, a single capital, or a number with a
    lower-case word behind.
    """
    pieces = F.split(replace(text, BOUNDARY, f"$1{MARK}$2"), MARK, -1)
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"), F.lit(None).cast("string").alias("now"))

    def add(s: Column) -> Column:
        return F.when(s["n"] == 0, strip(s["now"])).otherwise(F.concat(s["out"], F.lit(" "), strip(s["now"])))

    def take(s: Column, piece: Column) -> Column:
        goes_on = s["now"].rlike(abbreviated(abbreviations)) | s["now"].rlike(INITIAL) | (s["now"].rlike(NUMBER) & piece.rlike(rf"^[{WS}]*\p{{IsLowercase}}"))
        glued = F.struct(s["n"].alias("n"), s["out"].alias("out"), F.concat(F.coalesce(s["now"], F.lit("")), piece).alias("now"))
        ended = F.struct((s["n"] + 1).alias("n"), add(s).alias("out"), piece.alias("now"))
        return F.when(s["n"] >= sentences, s).when(s["now"].isNull() | goes_on, glued).otherwise(ended)

    end = lambda s: F.when((s["n"] < sentences) & (F.coalesce(strip(s["now"]), F.lit("")) != ""), add(s)).otherwise(s["out"])
    return F.coalesce(F.aggregate(pieces, start, take, end), F.lit(""))
