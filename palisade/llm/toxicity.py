"""Toxicity: class-conditional Kneser-Ney models over the letters of expressions and of whole texts."""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Collection

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.shared import chunks, written

#: A cell is a letter and the three before it; cells are as many as the corpus has.
ORDER = 4
LETTERS = [f"x{i}" for i in range(ORDER)]
DISCOUNT = 0.75
#: Characters of different words that a task keeps, about; a word counts 40 more.
MEMO = 12_000_000
#: Evidence of texts' expressions and of whole texts is gathered in steps of this for the final curve.
STEP, FINE = 1 / 64, 1 / 256


def symbol(letter: str) -> int:
    """The letter, digit or combining mark itself, in lower case; 0 for all else."""
    return ord(letter.lower()[0]) if letter.isalnum() or unicodedata.category(letter)[0] == "M" else 0


#: Symbols by code point, filled as letters are met; -1 is unknown.
SYMBOLS = np.full(0x110000, -1, np.int32)


def laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the expressions of ``words``, end to end: a row of ``ORDER`` letters each, where each expression begins, and its word's number.

    An expression is a run of letters and digits. A cell holds a letter and the three before it in the run, none folded with others; 0 stands
    before a run, and behind it as its last letter.
    """
    codes = np.frombuffer((" ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    own = SYMBOLS[codes]
    if (own < 0).any():
        for code in np.unique(codes[own < 0]):
            SYMBOLS[code] = symbol(chr(code)) if not 0xD800 <= code < 0xE000 else 0
        own = SYMBOLS[codes]
    own = np.concatenate([np.zeros(ORDER - 1, np.int32), own])
    at = np.flatnonzero((own[ORDER - 1 :] > 0) | (own[ORDER - 2 : -1] > 0)) + ORDER - 1
    cells, alive = np.zeros((ORDER, len(at)), np.int32), np.ones(len(at), bool)
    cells[-1] = own[at]
    for back in range(1, ORDER):
        before = own[at - back]
        alive &= before > 0
        cells[-1 - back] = np.where(alive, before, 0)
    # A run begins after a sign that is none of its symbols; every word ends with a space.
    starts = np.flatnonzero(own[at - 1] == 0)
    number = np.cumsum(codes == 32)[at - (ORDER - 1)] - (codes[at - (ORDER - 1)] == 32)
    return cells.T, starts, number[starts]


def keys_of(letters: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cells as numbers; ``letters``: all there are, in order. Up to 65,536 different letters the numbers tell all cells apart."""
    out = np.zeros(len(cells), np.uint64)
    for own in cells.T:
        out = out * np.uint64(len(letters)) + np.searchsorted(letters, own).astype(np.uint64)
    return out


def counted(words: Counter) -> pd.DataFrame:
    cells, starts, number = laid_out(list(words))
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words))[number], np.diff(np.append(starts, len(cells))))
    _, one, place = np.unique(keys_of(np.unique(cells), cells), return_index=True, return_inverse=True)
    return pd.DataFrame(cells[one], columns=LETTERS).assign(n=np.bincount(place, times, len(one)).astype(np.int64))


class Ratios:
    """Log-ratios of cells, of all that the corpus has."""

    def __init__(self, cells: np.ndarray, ratio: np.ndarray):
        self.letters = np.unique(cells)
        keys = keys_of(self.letters, cells)
        order = np.argsort(keys)
        self.keys, self.ratio = keys[order], ratio[order].astype(np.float32)

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        return self.ratio[np.searchsorted(self.keys, keys_of(self.letters, cells))].astype(float)


def evidence_of(words: list[str], ratios: Ratios) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By word: the largest mean log-ratio of its expressions, -inf without any; their log-ratios' sum; their letters, ends included."""
    cells, starts, number = laid_out(words)
    most, total, size = np.full(len(words), -np.inf), np.zeros(len(words)), np.zeros(len(words))
    if len(cells):
        sums, sizes = np.add.reduceat(ratios(cells), starts), np.diff(np.append(starts, len(cells)))
        np.maximum.at(most, number, sums / sizes)
        np.add.at(total, number, sums)
        np.add.at(size, number, sizes)
    return most, total, size


def held(words: Collection[str]) -> bool:
    """Whether a task keeps so many words that it has to let go of them."""
    return sum(map(len, words)) + 40 * len(words) > MEMO


#: What tasks count, without the class.
COUNTS = ", ".join(f"{x} int" for x in LETTERS) + ", n long"


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``x0 ... x3, n, toxic``: the cells of all texts; toxic: -1."""

    def count(batches):
        words: Counter = Counter()
        for batch in batches:
            for _, texts in chunks(batch["text"]):
                for text in texts:
                    words.update(text.split())
                if held(words):
                    yield counted(words)
                    words = Counter()
        yield counted(words)

    return docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, COUNTS).withColumn("toxic", F.lit(-1))


def class_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The same for ordinary and toxic labelled texts. What is joined with the labels are packed texts."""

    def packed_texts(batches):
        for batch in batches:
            for at, texts in chunks(batch["text"]):
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at : at + len(texts)].array, "words": [zlib.compress(x.encode(), 1) for x in texts]})

    def count(batches):
        words: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for n, (packed, toxic) in enumerate(zip(batch["words"], batch["toxic"], strict=True)):
                words[toxic].update(zlib.decompress(packed).decode().split())
                if n % 500 == 499 and held(words[toxic]):
                    yield counted(words[toxic]).assign(toxic=toxic)
                    words[toxic] = Counter()
        for toxic, own in words.items():
            yield counted(own).assign(toxic=toxic)

    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(packed_texts, f"doc_id {kind}, words binary")
    return packed.join(labels.hint("merge"), "doc_id").select("words", "toxic").mapInPandas(count, f"{COUNTS}, toxic int")


def gathered(*counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The corpus's cells and how often ordinary and toxic labelled texts have each: counted in tasks, summed by Spark; one row a cell reaches the driver."""
    both = counts[0].unionByName(counts[1])
    sums = [F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)]
    rows = both.groupBy(*LETTERS).agg(*sums).toPandas()
    return rows[LETTERS].to_numpy(np.int32), rows[["n0", "n1"]].to_numpy(np.int64).T


def places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different row, and each row's number among them."""
    if not rows.shape[1]:
        return np.arange(min(1, len(rows))), np.zeros(len(rows), np.int64)
    _, one, own = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return one, own.ravel()


def shared_model(cells: np.ndarray) -> np.ndarray:
    """P(letter | the two before it) of each cell: Kneser-Ney continuation counts of all texts, down to the even share."""
    probability = np.full(len(cells), 1 / max(1, len(np.unique(cells))))
    for order in range(1, ORDER):
        # How many different letters stand before each sequence of this length.
        longer, _ = places(cells[:, -order - 1 :])
        one, own = places(cells[:, -order:])
        kinds = np.bincount(own[longer], minlength=len(one)).astype(float)
        _, context = places(cells[:, -order:-1])
        total, types = np.bincount(context[one], kinds), np.bincount(context[one])
        probability = (np.maximum(kinds - DISCOUNT, 0)[own] + DISCOUNT * types[context] * probability) / total[context]
    return probability


def log_ratio(cells: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """By cell, log P(letter | context, toxic) - log P(letter | context, ordinary), both backing off to the shared model."""
    lower = shared_model(cells)
    _, context = places(cells[:, :-1])
    out = []
    for own in classes:
        total, types = np.bincount(context, own)[context], np.bincount(context, own > 0)[context]
        with np.errstate(divide="ignore", invalid="ignore"):
            smooth = (np.maximum(own - DISCOUNT, 0) + DISCOUNT * types * lower) / total
        out.append(np.log(np.maximum(np.where(total > 0, smooth, lower), 1e-12)))
    return out[1] - out[0]


def evidence(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """``doc_id, evidence, whole``: the largest length-normalised log-likelihood ratio of a text's expressions, and that of the whole text; null without any."""

    def score(batches):
        place: dict[str, int] = {}
        known = np.zeros((3, 0))
        for batch in batches:
            for at, texts in chunks(batch["text"]):
                words = [x.split() for x in texts]
                new = list(set().union(*words).difference(place))
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                known = np.concatenate([known, evidence_of(new, ratios)], axis=1)
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                some, out = np.flatnonzero(sizes), np.full((3, len(words)), np.nan)
                if len(some):
                    own = known[:, np.fromiter((place[x] for text in words for x in text), np.int64, sizes.sum())]
                    starts = (np.cumsum(sizes) - sizes)[some]
                    out[0, some] = np.maximum.reduceat(own[0], starts)
                    out[1:, some] = np.add.reduceat(own[1:], starts, axis=1)
                if held(place):
                    place, known = {}, np.zeros((3, 0))
                most, total, size = np.where(out[2] > 0, out, np.nan)
                found = {"doc_id": batch["doc_id"].iloc[at : at + len(texts)].array, "evidence": most, "whole": total / size}
                yield pd.DataFrame(found).astype({"evidence": "Float64", "whole": "Float64"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(score, f"doc_id {kind}, evidence double, whole double")


def curve(steps: pd.DataFrame) -> tuple[float, float, float]:
    """Slopes and constant of a logistic curve through ``evidence`` and ``whole`` steps, ``toxic`` and ``n``; lightly held back."""
    x, y, n = steps[["evidence", "whole"]].to_numpy(float), steps["toxic"].to_numpy(float), steps["n"].to_numpy(float)
    if not len(x) or len(set(y)) < 2:
        return 1.0, 0.0, 0.0 if not len(x) else -float(x[:, 0].max() + 5 if not y.any() else x[:, 0].min() - 5)
    weight = np.where(y > 0, n / n[y > 0].sum(), n / n[y == 0].sum())
    center, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1
    z, w = np.column_stack([(x - center) / spread, np.ones(len(x))]), np.zeros(3)
    back = np.array([1e-3, 1e-3, 1e-9])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + back * w * [1, 1, 0]
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(back)
        w -= np.linalg.solve(hess, grad)
    slopes = w[:2] / spread
    return slopes[0], slopes[1], w[2] - slopes @ center


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score``: how likely each text is toxic, from 0 to 1.

    ``labels``: ``doc_id`` and ``toxic`` (0 or 1; others and nulls are left out). Rows whose crc32(doc_id as
    text) mod 3 is 1 are held out of all fitting. An expression is a run of letters and digits, of whole letters in lower case: its
    log-likelihood under the toxic and under the ordinary model, over its letters; both models back off to counts of all texts, so that
    rare forms share what is known of their parts. A text is judged by its most toxic expression and by the same of
    all its expressions together, over all their letters; a logistic curve over all labelled rows that aren't held out makes both a probability. Texts without
    letters or digits, null ones too, score 0. Without labels of both kinds no text is told from another.
    Repeated rows score alike; an empty table gives no rows; other columns are ignored.
    """
    learnt = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    cells, classes = gathered(class_counts(docs.where(~is_held_out(F.col("doc_id"))), learnt), corpus_counts(docs))
    found = written(evidence(docs, Ratios(cells, log_ratio(cells, classes))), "evidence")
    steps = [(F.round(F.col(c) / step) * step).alias(c) for c, step in (("evidence", STEP), ("whole", FINE))]
    steps = found.where("evidence is not null").join(learnt, "doc_id").groupBy(*steps, "toxic").agg(F.count("*").alias("n")).toPandas()
    slope, other, constant = (F.lit(float(x)) for x in curve(steps))
    score = 1 / (1 + F.exp(-(slope * F.col("evidence") + other * F.col("whole") + constant)))
    return found.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce(score, F.lit(0.0)).alias("score"))
