"""Word tokens of English-style text, and the lists that the keyword and sentence rules use."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions.text import WS, replace

# The abbreviations after which a period doesn't end a sentence.
ABBREVIATIONS = tuple("mr mrs ms dr prof sr jr st vs etc no fig inc ltd co corp dept sec art e.g i.e u.s".split())
# English stop words, as usual in public lists, with the stems that contractions leave.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are was
    were be been being have has had having do does did doing would should could ought i'm you're he's she's it's
    we're they're i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll
    isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't
    cannot couldn't mustn't let's that's who's what's here's there's when's where's why's how's a an the and but if
    or because as until while of at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when where why how all any both
    each few more most other some such no nor not only own same so than too very s t can will just don should now
    ain aren couldn didn doesn hadn hasn haven isn mightn mustn needn shan shouldn wasn weren won wouldn""".split()
)
STOP_WORDS = tuple(sorted(set(STOP_WORDS) - {"could", "would", "ought", "cannot"}))
LEAST_LETTERS = 3

#: Besides two hyphens.
ALWAYS_SPLIT = ";?!@#$%&*\"“”«»()[]{}<>`"
COMMA_SPLIT = r"[,:]+([^\p{Nd},:]|\z)"
CONTRACTION = r"(?i)(\p{L})(n['’]t|['’](?:s|ll|re|ve|m|d))\b"
JOINED = r"(?i)(?=[cglw])\b(?:(can)(not)|(gon)(na)|(gim)(me)|(lem)(me)|(got)(ta)|(wan)(na))\b"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is asked for."""
    return F.transform(F.array(value), use)[0]


def marks_apart(text: Column | str) -> Column:
    """Text with white space where the treebank rules split at marks, quotes and contractions."""
    out = F.translate(F.col(text) if isinstance(text, str) else text, ALWAYS_SPLIT, " " * len(ALWAYS_SPLIT))
    out = F.replace(out, F.lit("--"), F.lit(" "))
    out = replace(out, COMMA_SPLIT, " $1")
    out = F.when(out.rlike("['’]"), replace(out, CONTRACTION, "$1 $2")).otherwise(out)
    return replace(out, JOINED, "$1$3$5$7$9$11 $2$4$6$8$10$12")


def word_tokens(text: Column | str, abbreviations: tuple[str, ...] = ABBREVIATIONS, ends: Column | None = None) -> Column:
    """Tokens in order, cut by the usual treebank rules.

    Marks and quotes split, as do contractions; hyphens, slashes and inner periods don't. A token's last
    period goes, unless the token is an abbreviation inside the text; ``ends`` tells where a line is the last one of its text.
    """
    tokens = F.filter(F.split(marks_apart(text), rf"[{WS}]+", -1), lambda t: t != "")
    listed = F.array(*map(F.lit, (f"{a}." for a in abbreviations)))
    bare = lambda t: F.ltrim(F.rtrim(F.rtrim(t, F.lit("'’")), F.lit(".")), F.lit("'‘’"))

    def cut(tokens: Column) -> Column:
        inside = lambda i: i < F.size(tokens) - 1 if ends is None else (i < F.size(tokens) - 1) | ~ends
        # a token that is listed ends with a period
        return F.transform(tokens, lambda t, i: F.when(t.endswith(".") & F.array_contains(listed, F.lower(t)) & inside(i), t).otherwise(bare(t)))

    return bound(tokens, cut)


def letter_words(text: Column, abbreviations: tuple[str, ...], last: bool) -> Column:
    """Of the tokens that :func:`word_tokens` cuts ``text`` (:func:`marks_apart`) into those of ``LEAST_LETTERS`` letters or more, by one pattern.

    These are letters with quotes around them and periods behind. ``last`` tells that the text's last token is an abbreviation no more.
    """
    names = "|".join(re.escape(a) for a in abbreviations)
    kept = rf"(?:(?!\.)|(?!(?<=(?<![^{WS}])(?i:{names}))\.{f'[{WS}]+[^{WS}]' if last else f'(?![^{WS}])'}))" if names else ""
    word = rf"(?<![^{WS}])['‘’]*+(\p{{L}}{{{LEAST_LETTERS},}}+){kept}\.*+['’]*+(?![^{WS}])"
    return F.regexp_extract_all(text, F.lit(word), F.lit(1))


def key_words(text: Column | str, stop_words: tuple[str, ...] = STOP_WORDS, ends: Column | None = None, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Lower-cased tokens of three letters or more, without stop words, in order."""
    found = letter_words(marks_apart(text), abbreviations, last=True)
    if ends is not None:
        found = F.when(ends, found).otherwise(letter_words(marks_apart(text), abbreviations, last=False))
    lower = F.transform(found, lambda t: F.lower(t))
    return F.filter(lower, lambda t: ~t.isin(*stop_words)) if stop_words else lower


def top_words(words: Column, top_n: int) -> Column:
    """Of an array of words the ``top_n`` most frequent ones, ties by first occurrence: equal words are runs of the sorted array."""

    def of_sorted(s: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (s[i]["w"] != s[F.greatest(i - 1, F.lit(0))]["w"]))
        return bound(F.when(F.size(s) > 0, opens).otherwise(F.array().cast("array<int>")), lambda at: runs(s, at))

    def runs(s: Column, at: Column) -> Column:
        stop = lambda k: F.when(k + 1 < F.size(at), at[k + 1]).otherwise(F.size(s))
        found = F.transform(at, lambda i, k: F.struct((i - stop(k)).alias("less"), s[i]["i"].alias("i"), s[i]["w"].alias("w")))
        return F.transform(F.slice(F.sort_array(found), 1, top_n), lambda x: x["w"])

    return bound(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), of_sorted)
