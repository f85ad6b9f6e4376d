"""Toxicity: whole letters of any script, plain Kneser-Ney sums, the likelihood of whole texts."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from test_operators import documents

from palisade.llm import toxicity


def test_letters_are_told_apart():
    """Each pair was one sequence of cells while letters were folded."""
    for a, b in (("жид", "кид"), ("été", "ete"), ("x123", "x987"), ("数据", "林据"), ("ab1", "ab2")):
        assert toxicity.laid_out([a])[0].tolist() != toxicity.laid_out([b])[0].tolist(), (a, b)
    assert toxicity.laid_out(["AbC"])[0].tolist() == toxicity.laid_out(["abc"])[0].tolist() == [[0, 0, 0, 97], [0, 0, 97, 98], [0, 97, 98, 99], [97, 98, 99, 0]]


def plain(counts: list[Counter]):
    """P(letter | three before, class) by the textbook, from all cells and those of a class."""
    corpus = {tuple(c) for own in counts for c in own}
    letters = {x for c in corpus for x in c}

    def lower(gram):
        if not gram:
            return 1 / len(letters)
        order = len(gram)
        before = {c[-order - 1 :] for c in corpus}
        own = sum(g[1:] == gram for g in before)
        same = [g for g in before if g[1:-1] == gram[:-1]]
        return (max(own - 0.75, 0) + 0.75 * len({g[-1] for g in same}) * lower(gram[1:])) / len(same)

    def top(cell, own):
        same = {c: n for c, n in own.items() if c[:-1] == cell[:-1]}
        total = sum(same.values())
        return (max(own[cell] - 0.75, 0) + 0.75 * len(same) * lower(cell[1:])) / total if total else lower(cell[1:])

    return {c: math.log(top(c, counts[1])) - math.log(top(c, counts[0])) for c in corpus}


def test_ratios_as_by_the_textbook():
    random.seed(3)
    texts = [["".join(random.choices("abдж", k=random.randint(1, 5))) for _ in range(30)] for _ in range(2)]
    counts = [Counter(map(tuple, toxicity.laid_out(own)[0].tolist())) for own in texts]
    cells = np.array(sorted({c for own in counts for c in own}), np.int32)
    classes = np.array([[own[tuple(c)] for c in cells.tolist()] for own in counts])
    wanted = plain(counts)
    ratio = toxicity.log_ratio(cells, classes)
    assert ratio == pytest.approx([wanted[tuple(c)] for c in cells.tolist()])
    words = ["ab-жд", "a", "..."]
    own = toxicity.laid_out(words)[0]
    most, total, size = toxicity.evidence_of(words, toxicity.Ratios(own, np.ones(len(own))))
    assert most.tolist() == [1.0, 1.0, -np.inf] and total.tolist() == size.tolist() == [6.0, 2.0, 0.0]


def test_whole_texts_count(spark):
    """What stands in every word of toxic texts a little is in the sum over the text; digits and other scripts are learnt as they are."""
    found = toxicity.evidence(documents(spark, ["ab ab ab cd", "cd", None, "...", "ab"]), toxicity.Ratios(toxicity.laid_out(["ab", "cd"])[0], np.array([1.0, 1, 1, 0, 0, 0]))).collect()
    rows = {r["doc_id"]: (r["evidence"], r["whole"]) for r in found}
    assert rows == {0: (1.0, 0.75), 1: (0.0, 0.0), 2: (None, None), 3: (None, None), 4: (1.0, 1.0)}
    steps = pd.DataFrame({"evidence": [0.5] * 4, "whole": [-0.2, -0.1, 0.1, 0.2], "toxic": [0, 0, 1, 1], "n": [1] * 4})
    slope, other, constant = toxicity.curve(steps)
    score = 1 / (1 + np.exp(-(slope * 0.5 + other * steps["whole"] + constant)))
    assert (score[:2] < 0.3).all() and (score[2:] > 0.7).all()


def test_other_scripts(spark):
    """The toxic form differs from ordinary ones only in letters that were one symbol."""
    random.seed(4)
    # Letters four places apart.
    swap = str.maketrans({"к": chr(ord("к") + 4), "р": chr(ord("р") - 4)})
    words = ["крат", "прок", "карп", "трак", "корт"]
    texts = [" ".join([*random.choices(words, k=30), "крокр".translate(swap) if i % 3 == 0 else "крокр"]) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    held = [r for r in toxicity.classify(documents(spark, texts), labels).collect() if r["held_out"]]
    assert len(held) > 60 and all((r["score"] >= 0.7) == (r["doc_id"] % 3 == 0) for r in held)
