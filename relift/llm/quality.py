"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Tokens are runs of word characters, or of other visible characters, as they are written; their 1- and
2-grams are features, and so are the 1- to 3-grams of their shapes (case, digits, signs, and whether a
token repeats the one before), which carry over to words that no training row has.  Defined
cases: NULL and empty texts have no features and get the score of the model's bias; repeated rows
are scored each; an empty table gives no rows; without labels of both classes the score is constant.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from . import labelled
from .linear import Hashes, bucket

TOKEN = re.compile(r"\w+|[^\w\s]+")
FOLDS, HELD_OUT = 3, 1


class Shapes(dict):
    """Word to a small number: lower, title and upper case, mixed, digits, signs by their first and count."""

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            shape = 1 if word.islower() else 2 if word.istitle() else 3 if word.isupper() else 4
        elif word.isdigit():
            shape = 5
        else:
            shape = 6 if word[0].isalnum() or word[0] == "_" else 16 + ord(word[0]) % 4096 * 4 + min(len(word), 4) - 1
        self[word] = shape
        return shape

    def trim(self, most: int = 150_000) -> None:
        if len(self) > most:
            self.clear()


def features():
    """Texts to distinct buckets of their token and shape n-grams."""
    hashes, shapes = Hashes(), Shapes()
    times = np.uint64(0x100000001B3)

    def rows(texts: list[str | None]) -> list[np.ndarray]:
        hashes.trim()
        shapes.trim()
        out = []
        for text in texts:
            tokens = TOKEN.findall(text or "")
            h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
            one = np.fromiter(map(shapes.__getitem__, tokens), np.uint64, len(tokens)) * np.uint64(2)
            one[1:] += h[1:] == h[:-1]
            two = one[:-1] * times + one[1:]
            three = two[:-1] * times + one[2:]
            shaped = [np.unique(x) for x in (one, two, three)]
            out.append(np.unique(np.concatenate([bucket(h, 1), bucket(h[:-1] * times + h[1:], 2), *(bucket(x, 6 + k) for k, x in enumerate(shaped))])))
        return out

    return rows


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return labelled.query(docs, labels, "quality", features, FOLDS, HELD_OUT)
