"""Toxicity by noisy-channel deobfuscation.

A word that looks disguised (symbols or digits between letters, a letter three times in a row, letters
spaced out) is read as a lattice: a symbol may stand for a letter or be filler, a repeated letter may be
one letter, and between letters that are spaced out a word may end. Viterbi decoding under a character
trigram model picks the reading; the restored text is then scored by words and word beginnings that labelled toxic documents have and others lack.

The trigram counts come from all documents; a small share of the model's mass is given to the learned
words. The scorer learns from at most ``PER_CLASS`` labelled documents of each class, taken in hash order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mapped

PER_CLASS = 6000
#: Letters of the trigram model; 0 is the space between words and the last code any other character.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëìíîïñòóôöùúûüœæ"
CODES = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER, V = len(LETTERS) + 1, len(LETTERS) + 2
#: What symbols and digits may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou", "#": "h", "%": "x"}
#: Costs in nats: a symbol read as a letter, filler left out, a repeated letter left out.
AS_LETTER, AS_FILLER, AS_REPEAT = 0.5, 3.0, 1.0
EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "“”„«»‘’…–—·¡¿"
DISGUISED = re.compile(r"[^\W\d_](?:[\W\d_]+)[^\W\d_]|([^\W\d_])\1\1|\d[^\W\d_]|[^\W\d_]\d")
PLAIN_JOIN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]{2,})+\Z")
SPACED = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\w)")
GAP = re.compile(r"\s+")
#: Between the letters of a spaced token: as wide as any of its gaps, or wider than the narrowest.
NARROW, WIDE = " ", "\n"
REMEMBERED = 100_000
#: Letters in the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7, 8)


def code_table() -> np.ndarray:
    table = np.full(0x2100, OTHER, np.int64)
    for c, i in CODES.items():
        table[ord(c)] = i
    for c in " \t\n\r\x0b\x0c":
        table[ord(c)] = 0
    return table


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each three characters follow each other in all texts (V ** 3 sums come to the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = code_table(), np.zeros(V**3, np.int64)
        for batch in batches:
            for start in range(0, len(batch), 200):
                text = "  ".join(t for t in batch.column(0).slice(start, 200).to_pylist() if t)
                for k in range(0, len(text), 1 << 20):
                    codes = np.frombuffer(text[max(0, k - 2) : k + (1 << 20)].lower().encode("utf-32-le", "replace"), "<u4")
                    codes = table[np.minimum(codes, len(table) - 1)]
                    if len(codes) > 2:
                        total += np.bincount((codes[:-2] * V + codes[1:-1]) * V + codes[2:], minlength=V**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    rows = mapped(docs.select("text"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(V**3, np.float64)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out.reshape(V, V, V)


class Restorer:
    """Reads disguised words under trigram counts and, with a small share of the mass, a list of known words."""

    def __init__(self, counts: np.ndarray, words: list[str] = (), share: float = 0.1):
        own = np.zeros_like(counts)
        for word in words:
            codes = [0, 0, *(CODES.get(c, OTHER) for c in word), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
                own[a, b, c] += 1
        if own.sum():
            counts = counts + own * (share * max(counts.sum(), 1.0) / own.sum())
        single = counts.sum((0, 1)) + 1.0
        single /= single.sum()
        pair = counts.sum(0) + 5.0 * single
        pair /= pair.sum(-1, keepdims=True)
        triple = counts + 5.0 * pair[None]
        self.cost = -np.log(triple / triple.sum(-1, keepdims=True)).astype(np.float32)

    def __call__(self, seen: str) -> str:
        """The likeliest reading of a disguised word; of letters that are spaced out, words with blanks between."""
        cost = self.cost
        # the best (cost, reading) for each two last letters; a reading is (the one it goes on from, letter)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for c in seen:
            if c in (NARROW, WIDE):
                stay = AS_FILLER if c == WIDE else 0.0
                ends = [(so_far + float(cost[a, b, 0]), read) for (a, b), (so_far, read) in states.items() if read and read[1] != " "]
                states = {k: (so_far + stay, read) for k, (so_far, read) in states.items()}
                if ends:
                    total, read = min(ends, key=lambda e: e[0])
                    if (0, 0) not in states or total < states[0, 0][0]:
                        states[0, 0] = (total, (read, " "))
                before = c
                continue
            options = [(c, 0.0)] if c.isalpha() else [(x, AS_LETTER) for x in STANDS_FOR.get(c, "")]
            skip = AS_REPEAT if c == before else AS_FILLER if not c.isalnum() else None
            if not options and c.isdigit():
                options = [(c, 0.0)]
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, read) in states.items():
                if skip is not None:
                    if (a, b) not in step or so_far + skip < step[a, b][0]:
                        step[a, b] = (so_far + skip, read)
                for x, extra in options:
                    code = CODES.get(x, OTHER)
                    total = so_far + extra + float(cost[a, b, code])
                    if (b, code) not in step or total < step[b, code][0]:
                        step[b, code] = (total, (read, x))
            states, before = step, c
        read, letters = min(((so_far + float(cost[a, b, 0]), read) for (a, b), (so_far, read) in states.items()), key=lambda e: e[0], default=(0.0, None))[1], []
        while read:
            read, x = read
            letters.append(x)
        return "".join(reversed(letters))


def restored(token: str, restorer: Restorer) -> str:
    """A token of lower-cased text without marks at its edges, read anew if it looks disguised."""
    core = token.strip(EDGE)
    if core.isalpha() and not re.search(r"(.)\1\1", core):
        return core
    marks = token.rstrip(".,;:?!)]}\"'”»").lstrip("([{\"'“«")
    if DISGUISED.search(marks) and not PLAIN_JOIN.match(core):
        return restorer(core if core[:1].isalpha() and core[-1:].isalpha() else marks)
    return core


def tokens_of(text: str) -> set[str]:
    """Words, and runs of letters that are spaced out, their gaps as NARROW or WIDE."""
    lower = text.lower()
    tokens = set(lower.split())
    for m in SPACED.finditer(lower):
        least = min(map(len, GAP.findall(m[0])))
        tokens.add(GAP.sub(lambda gap: WIDE if len(gap[0]) > least else NARROW, m[0]))
    return tokens


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *[f"{word[:k]}~" for k in BEGINNINGS if len(word) >= k]] if len(word) > 2 else []


def features_of(token: str, restorer: Restorer) -> list[str]:
    """The features of each word that a token restores to."""
    return [f for word in restored(token, restorer).split() for f in features(word)]


def sampled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, toxic): labelled rows to learn from, ``per_class`` of each class at most, in hash order; repeated ids once."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.xxhash64("doc_id"))
    parts = [usable.where(F.col("toxic") == k).orderBy("turn", "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "toxic")


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, min_rate: float = 0.8) -> tuple[np.ndarray, dict[str, float], float]:
    """(trigram counts, toxic share of documents by feature, share without any feature)."""
    counts = trigram_counts(docs)
    restorer = Restorer(counts)
    sample = sampled(docs, labels, per_class)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # 2 * per_class rows at most

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                words = (text or "").split()
                keys.append(min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(keys, pa.int64())], ["doc_id", "toxic", "copy_of"])

    # of near copies, which share their least shingle mostly, one counts
    apart = mapped(texts.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text"), mark, "doc_id long, toxic int, copy_of long")
    apart = apart.groupBy("copy_of", "toxic").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(F.broadcast(cut(apart)), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        found = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own: set[str] = {""}  # counts documents
                for t in tokens_of(text or ""):
                    if t not in known:
                        if len(known) > REMEMBERED:
                            known.clear()
                        known[t] = features_of(t, restorer)
                    own.update(known[t])
                found[toxic].update(own)
        names = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([f[x] for x in names], pa.int64()) for f in found]], ["feature", "clean", "toxic"])

    sums = mapped(texts, count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = cut(sums)
    total = sums.where("feature = ''").select("clean", "toxic").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return counts, {}, 0.0
    base = total["toxic"] / (total["toxic"] + total["clean"])
    n = F.col("toxic") + F.col("clean")
    # log-likelihood ratio against the base rate; of as many features that mean nothing about one gets so far
    gain = F.col("toxic") * F.log(F.col("toxic") / (n * base)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - base)))).otherwise(0.0)
    rate = F.col("toxic") / (F.col("toxic") + 2 * F.col("clean") + 0.5)
    rows = sums.where((F.col("feature") != "") & (F.col("toxic") > 1) & (rate >= min_rate) & (gain >= math.log(sums.count()))).select("feature", rate.alias("rate"), gain.alias("gain")).collect()
    # of a beginning and the longer features under it the stronger one stays
    best = {r["feature"]: (round(r["gain"], 6), r["feature"].endswith("~"), len(r["feature"]), r["feature"]) for r in rows}
    rates, under = {}, {}
    for f, g in best.items():
        for k in BEGINNINGS:
            if len(f.rstrip("~")) >= k:
                under[f"{f[:k]}~"] = max(g, under.get(f"{f[:k]}~", g))
    for r in rows:
        own = r["feature"]
        above = [best[x] for x in features(own.rstrip("~")) if x in best]
        if max([*above, best[own], under.get(own, best[own])]) == best[own]:
            rates[own] = r["rate"]
    return counts, rates, 0.02


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str = "score", **options: float) -> DataFrame:
    """``keep`` and the score ``name`` (0 to 1) for each row of ``docs``; labels of rows whose crc32(doc_id) % 5 is 0 aren't used.

    A score joins the toxic shares of all learned features in the restored text: 1 - product of (1 - share).
    Null and empty texts score like texts without features. Repeated rows stay, other columns are
    ignored; without labels every score is 0; an empty table gives an empty result.
    """
    counts, rates, rest = learn(docs, labels, **options)
    words = [f.rstrip("~") for f in rates]
    types = {c: docs.schema[c] for c in keep}
    spark: SparkSession = docs.sparkSession
    model = spark.sparkContext.broadcast((counts.astype(np.float32), rates, words))  # bounded by the alphabet and the sample
    schema = ", ".join(f"`{c}` {t.dataType.simpleString()}" for c, t in types.items()) + f", `{name}` double"

    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rates, words = model.value
        restorer, known = Restorer(counts.astype(np.float64), words), {}
        for batch in batches:
            scores = []
            for text in batch.column(at).to_pylist():
                clean, hits = 1.0 - rest, set()
                for t in tokens_of(text) if text else ():
                    found = known.get(t)
                    if found is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        found = known[t] = tuple(f for f in features_of(t, restorer) if f in rates)
                    if found:
                        hits.update(found)
                for f in sorted(hits):
                    clean *= 1.0 - rates[f]
                scores.append(1.0 - clean)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], [*keep, name])

    return mapped(docs.select(*keep, *[F.col("text").alias("_text")] * ("text" not in keep)), run, schema)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, whole and with their columns."""
    found = scored(docs, labels, keep=tuple(docs.columns), name="_score")
    return found.where(F.col("_score") < threshold).select(*docs.columns)
