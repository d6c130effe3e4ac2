"""Toxicity by noisy-channel deobfuscation.

A writer hides a word by look-alike signs, by separators between its letters and by repeated
letters.  Places where this may be so (a sign beside a letter, a letter thrice, single letters
apart) are found over whole texts by array operations.  Each such token becomes a lattice: what
every character may stand for, whether it may be skipped, each with a channel cost, and whether a word
ends at a separator, which costs what the character model says.  The cheapest
path under a character trigram model of the corpus is the restored token.  Elsewhere only repeated
letters are in question; their cheapest paths do not depend on each other and come from array
operations too.  ``!`` and ``*`` after a word are punctuation.  Before all that, letters of other
scripts that look Latin become so in words that mix both.  The restored text is then scored by a
linear model over its words and their beginnings.

The trigram model counts all letters of all documents.  Defined cases: NULL and empty texts have no
features; tokens and texts of any length are restored whole; of equally cheap readings the first found
counts, which is the same one each time; a score of just 0.5 is toxic; repeated rows are scored each;
other columns are not read, and a filter hands them on; an empty table gives no rows.  A word whose
parts are set apart by single blanks, as long as they are not single letters, is not joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from ..shipping import ship
from .common import documents, fold, letters, map_rows, release, steps
from .linear import Hashes, Model, bucket

FOLDS, HELD_OUT = 5, 0
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*~"
#: Channel costs in nats: a sign read as a letter, a repeated letter dropped, a separator dropped, a character kept against its look.
READ, DROP_REPEAT, DROP_SEPARATOR, KEEP_SIGN = 0.5, 0.2, 0.2, 8.0
#: Symbols of the character model: 0 is the word's edge, 1 any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"
SYMBOL = {c: i + 2 for i, c in enumerate(LETTERS)}
N = 64
#: Code points beyond this table count as one letter of class 1, or as one sign that is none.
TABLE = 0x250
WORD = re.compile(r"\w+")
#: Letters of other scripts that look like Latin ones (fixed values), and where both meet in a word.
LOOKS = str.maketrans("аеорсухіѕјһԁԛԝкмтвнгοανιρτυκεɡ", "aeopcyxisjhdqwkmtbhroaviptukeg")
MIXED = re.compile(r"[a-z][ɡͰ-ԯ]|[ɡͰ-ԯ][a-z]")
#: Separators between two spelled letters, at most.
WIDE = 3


def _among(signs) -> np.ndarray:
    return np.isin(np.arange(TABLE + 2), [ord(c) for c in signs])


def _tables() -> tuple[np.ndarray, ...]:
    chars = [chr(i) for i in range(TABLE)]
    symbol = np.array([*(SYMBOL.get(c.lower(), 1 if c.isalpha() else 0) for c in chars), 1, 0], np.int64)
    return symbol, symbol > 0, _among(c for c in LEET if ord(c) < TABLE), _among(SEPARATORS)


SYMBOLS, IS_LETTER, IS_SIGN, IS_SEPARATOR = _tables()
#: Characters of a token whose reading is remembered, at most.
LONG = 40
#: Signs that are letters after a word too.
ENDING = "$@+€£|("
IS_OPEN = _among("!*")
#: Signs that end sentences or set words apart, where they follow a letter.
IS_PUNCTUATION = _among("!|(+*")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def points(text: str) -> np.ndarray:
    """Code points, those beyond the table as one of its two last entries."""
    p = code_points(text).astype(np.int64)
    if len(far := np.flatnonzero(p >= TABLE)):
        p[far] = np.where(letters()[0][p[far]], TABLE, TABLE + 1)
    return p


def unmixed(low: str) -> str:
    """Words of Latin letters and others that look so, all in Latin letters."""

    def latin(found) -> str:
        new = found[0].translate(LOOKS) if MIXED.search(found[0]) else found[0]
        return found[0] if any(0x370 <= ord(c) < 0x530 for c in new) else new

    return WORD.sub(latin, low) if MIXED.search(low) else low


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all documents: each task adds up its own, Spark the rest."""

    def work(batches) -> Iterator[dict]:
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            for _, texts in steps(batch.column(0), batch.column(1)):
                s = np.concatenate([[0, 0], SYMBOLS[points("\n".join(t for t in texts if t))], [0, 0]])
                total += np.bincount((s[:-2] * N + s[1:-1]) * N + s[2:], minlength=N**3)
        at = np.flatnonzero(total)
        yield {"gram": at, "n": total[at]}

    found = map_rows(documents(docs), work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(N**3)
    counts[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return counts.reshape(N, N, N)


def costs(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), each order smoothed by the one below."""
    uni = counts.sum((0, 1)) + 0.5
    uni /= uni.sum()
    two = counts.sum(0)
    two = (two + 5 * uni) / (two.sum(1, keepdims=True) + 5)
    three = (counts + 5 * two[None]) / (counts.sum(2, keepdims=True) + 5)
    return -np.log(three)


class Restorer:
    """``text(s)`` is ``s`` in lower case, suspicious tokens replaced by the cheapest reading."""

    def __init__(self, cost: np.ndarray):
        self.array, self.cost, self.known = cost, cost.tolist(), {}

    def text(self, text: str) -> str:
        low = text.lower()
        p = points(low)
        if not len(p):
            return low
        if not low.isascii() and (plain := unmixed(low)) != low:
            low, p = plain, points(plain)
        letter, sign = IS_LETTER[p], IS_SIGN[p]
        hits = np.flatnonzero(sign[:-1] & letter[1:] | letter[:-1] & (sign & ~IS_OPEN[p])[1:])
        real = code_points(low)
        again = (real[1:] == real[:-1]) & letter[1:]
        hits = np.concatenate([hits, np.flatnonzero(again[1:] & again[:-1])])
        spans = [(a, b, None) for a, b in self._spans(low, hits.tolist())] if len(hits) else []
        after_letter = np.concatenate([[False], letter[:-1]])
        spans += [(a, b, None) for a, b in self._spaced(p, letter | sign & ~(IS_PUNCTUATION[p] & after_letter))]
        if again.any():
            spans += self._repeats(low, SYMBOLS[p], again)
        if not spans:
            return low
        out, last = [], 0
        for a, b, to in sorted(spans, key=lambda s: (s[0], -s[1])):
            if a >= last:
                out += [low[last:a], self.token(low[a:b]) if to is None else to]
                last = b
        return "".join([*out, low[last:]])

    def _repeats(self, low: str, symbol: np.ndarray, again: np.ndarray) -> list[tuple[int, int, str]]:
        """Runs of one letter that are cheaper with fewer of it: start, end, what to write.

        The lattice's costs of a run depend on the symbols beside it only.
        """
        edge = np.diff(np.concatenate([[0], again.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        more = np.concatenate([[0], symbol, [0]])
        b, c, d, m = more[start], symbol[start], more[end + 1], end - start
        two = self.array[b, c, c] + self.array[c, c, d]
        price = np.stack([two + (m - 2) * self.array[c, c, c], two + (m - 2) * DROP_REPEAT, self.array[b, c, d] + (m - 1) * DROP_REPEAT])
        keep = np.choose(price.argmin(0), [m, 2, 1])
        some = np.flatnonzero(keep < m)
        return [(i, j, low[i] * k) for i, j, k in zip(start[some].tolist(), end[some].tolist(), keep[some].tolist(), strict=True)]

    @staticmethod
    def _spans(low: str, hits: list[int]) -> list[tuple[int, int]]:
        found, end = [], -1
        for at in sorted(hits):
            if at < end:
                continue
            a = at
            while a > 0 and not low[a - 1].isspace():
                a -= 1
            b = at
            while b < len(low) and not low[b].isspace():
                b += 1
            end = b
            while b > a and not low[b - 1].isalnum():  # signs at the end are punctuation
                b -= 1
            tail = low[b : b + 3].rstrip()
            if 0 < len(tail) < 3 and all(c in ENDING for c in tail):  # but for one or two that look like letters
                b += len(tail)
            if 2 < b - a:
                found.append((a, b))
        return found

    @staticmethod
    def _spaced(p: np.ndarray, word: np.ndarray) -> list[tuple[int, int]]:
        edge = np.concatenate([[False], word, [False]])
        at = np.flatnonzero(edge[1:-1] & ~edge[:-2] & ~edge[2:])
        if len(at) < 3:
            return []
        # letters of a chain are equally far apart, with one kind of separator only between two of them
        gap = np.diff(at)
        near = np.flatnonzero((gap > 1) & (gap <= WIDE + 1))
        if len(near) < 2:
            return []
        many = np.concatenate([[0], np.cumsum(IS_SEPARATOR[p])])
        same = np.concatenate([[0], np.cumsum(p[1:] == p[:-1])])
        near = near[(many[at[near + 1]] - many[at[near]] == gap[near] - 1) & (same[at[near + 1] - 1] - same[at[near] + 1] == gap[near] - 2)]
        found, first, last = [], None, None
        for i in [*near.tolist(), None]:
            if i is not None and last is not None and i == last + 1 and gap[i] == gap[last]:
                last = i
                continue
            if last is not None and last > first:
                found.append((int(at[first]), int(at[last + 1]) + 1))
            first = last = i
        return found

    def token(self, token: str) -> str:
        if len(token) > LONG:
            return self.decode(token)
        if token not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[token] = self.decode(token)
        return self.known[token]

    def decode(self, token: str) -> str:
        """Viterbi over the lattice; a state is the last two symbols and the last written character."""
        cost = self.cost
        best: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}  # what was written, last first
        for c in token:
            arcs = [(x, READ) for x in LEET.get(c, "")]
            arcs.append((c, 0.0 if c.isalpha() else KEEP_SIGN))
            new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            for (a, b, last), (so_far, out) in best.items():
                skip = DROP_REPEAT if last and (c == last or last in LEET.get(c, "")) else DROP_SEPARATOR if c in SEPARATORS else None
                if skip is not None:
                    if (key := (a, b, last)) not in new or so_far + skip < new[key][0]:
                        new[key] = (so_far + skip, out)
                if last and c in SEPARATORS:  # a word ends here
                    total = so_far + cost[a][b][0]
                    if (key := (b, 0, "")) not in new or total < new[key][0]:
                        new[key] = (total, (" ", out))
                for x, channel in arcs:
                    s = SYMBOL.get(x, 1 if x.isalpha() else 0)
                    total = so_far + channel + cost[a][b][s]
                    if (key := (b, s, x)) not in new or total < new[key][0]:
                        new[key] = (total, (x, out))
            best = new
        out, found = min(((total + cost[a][b][0], out) for (a, b, _), (total, out) in best.items()), key=lambda x: x[0])[1], []
        while out is not None:
            found.append(out[0])
            out = out[1]
        return "".join(reversed(found))


def features_of(cost):
    """A function that tasks call: texts to distinct buckets of restored words and their first 5 and 7 letters."""

    def features():
        restore, whole = Restorer(cost.value if hasattr(cost, "value") else cost), Hashes()
        first: dict[str, tuple[int, int]] = {}

        def rows(texts: list[str | None]) -> list[np.ndarray]:
            if len(first) > 150_000:
                first.clear()
            out = []
            for text in texts:
                words = set(WORD.findall(restore.text(text))) if text else set()
                flat = []
                for word in words:
                    if (found := first.get(word)) is None:
                        found = first[word] = (whole.__missing__(word), whole.__missing__(word[:5]) if len(word) > 5 else 0, whole.__missing__(word[:7]) if len(word) > 7 else 0)
                        whole.clear()
                    flat.append(found)
                h = np.array(flat, np.uint64).reshape(-1, 3)
                out.append(np.unique(np.concatenate([bucket(h[:, 0], 3), bucket(h[h[:, 1] > 0, 1], 4), bucket(h[h[:, 2] > 0, 2], 5)])))
            return out

        return rows

    return features


def prepare(docs: DataFrame, labels: DataFrame) -> tuple[Model, object]:
    """(model, features) learnt from ``docs`` and ``labels``."""
    cost = docs.sparkSession.sparkContext.broadcast(costs(trigram_counts(docs)))  # 64**3 floats, whatever the corpus
    features = features_of(cost)
    return labelled.train(docs, labels, "toxic", features), features


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; trained outside the held-out fold."""
    model, features = prepare(docs, labels.where(fold("doc_id", FOLDS) != HELD_OUT))
    return labelled.score(docs, model, features).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; trained on all the labels."""
    model, features = prepare(docs, labels)
    kind = docs.schema
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        f = features()
        for batch in batches:
            verdict: list[bool] = []
            for _, texts in steps(batch.column(at), batch.column(at)):
                verdict += (held.value.score(f(texts)) < 0.5).tolist()
            yield batch.filter(pa.array(verdict, pa.bool_()))
        f = None
        release()

    ship(docs.sparkSession)
    return docs.mapInArrow(keep, kind)
