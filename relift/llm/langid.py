"""Language identification of mixed text: scripts, per-word scores, and Viterbi with a switching penalty.

A word is a run of letters.  Its script, by code-point ranges, narrows the candidates to the languages
learnt with that script (to all, if none was).  Its score under a candidate is the log likelihood of its
character trigrams, word edges included.  Viterbi over the words, with a penalty for each switch, labels
spans; a text's language is the one that most letters are labelled with, its score their share weighted
by how far the labelled words prefer it.

Letters are those of all of Unicode, and lower case is taken code point by code point.  Trained on a
bounded sample of documents with a known language.  Defined cases: NULL, empty and letterless texts are
``und`` with score 0 and have no spans; with no training rows all are ``und``; equal scores go to the
language first in order; repeated rows are labelled each; long texts are scored in parts and labelled
whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, documents, fold, letters, map_rows, map_texts, steps

FOLDS, HELD_OUT = 5, 0
#: Documents that the model is trained on, at most about; buckets of character trigrams.
TRAIN_ROWS, BUCKETS = 6000, 1 << 17
#: Characters whose trigrams are held at once.
PART = 250_000
#: Nats that a switch between words costs, and the most that one word may prefer a language by.
SWITCH, WORD_CAP = 6.0, 8.0
#: First code points of ranges and their scripts, up to the next entry.
RANGES = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other")]
SCRIPTS = sorted({name for _, name in RANGES})
STARTS = np.array([a for a, _ in RANGES], np.uint32)
SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in RANGES], np.int64)


@dataclass
class Words:
    """The words of several texts, text after text: owner, letters, script, and their trigrams' buckets."""

    owner: np.ndarray
    size: np.ndarray
    script: np.ndarray
    start: np.ndarray  # place of the first letter in the owner's text
    grams: np.ndarray
    first: np.ndarray  # of each word in grams; a word has size + 1 of them


def words(texts: list[str | None]) -> Words:
    joined = "\n".join(t or "" for t in texts) + "\n"
    p = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    known, lower = letters()
    p, is_letter = lower[p], known[p]
    edge = np.diff(is_letter.astype(np.int8), prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    owner = np.searchsorted(begins, a, "right") - 1
    # the trigram ending at each letter and at the place after the word; places outside words count as 0
    q = np.where(is_letter, p, 0).astype(np.uint64)
    pad = np.concatenate([np.zeros(2, np.uint64), q, np.zeros(1, np.uint64)])
    here = is_letter | np.concatenate([[False], is_letter[:-1]])
    at = np.flatnonzero(np.append(here, is_letter[-1:])) if len(p) else np.zeros(0, int)
    hashed = (pad[at] * np.uint64(0x9E3779B97F4A7C15) + pad[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + pad[at + 2]
    grams = ((hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64)
    size = b - a
    return Words(owner, size, SCRIPT_OF[np.searchsorted(STARTS, p[a], "right") - 1] if len(a) else np.zeros(0, int), a - begins[owner], grams, np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if len(a) else np.zeros(0, int))


@dataclass
class Model:
    langs: list[str]
    cost: np.ndarray  # [BUCKETS, languages], log likelihoods
    allowed: np.ndarray  # [scripts, languages]
    switch: float = SWITCH

    def word_scores(self, w: Words) -> np.ndarray:
        if not len(w.size):
            return np.zeros((0, len(self.langs)), np.float32)
        s = np.add.reduceat(self.cost[w.grams], w.first, 0)
        s = np.maximum(s - s.max(1, keepdims=True), -WORD_CAP)
        return np.where(self.allowed[w.script], s, np.float32(-1e4))

    def scored(self, texts: list[str | None]) -> tuple[Words, np.ndarray]:
        """The words of the texts, without trigrams, and their scores; trigrams are made for some texts at a time."""
        parts, first, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= PART or i + 1 == len(texts):
                w = words(texts[first : i + 1])
                parts.append((w.owner + first, w.size, w.script, w.start, self.word_scores(w)))
                first, size = i + 1, 0
        owner, many, script, start, s = (np.concatenate(c) for c in zip(*parts, strict=True))
        none = np.zeros(0, np.int64)
        return Words(owner, many, script, start, none, none), s

    def label(self, w: Words, s: np.ndarray, n: int) -> np.ndarray:
        """The language of each word, by Viterbi over each of ``n`` texts.

        All texts advance together, longest first, so a step is one array operation.
        """
        out = np.zeros(len(w.size), np.int16)
        count = np.bincount(w.owner, minlength=n)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        order = np.argsort(-count, kind="stable")
        count, first = count[order], first[order]
        alive = int((count > 0).sum())
        if not alive:
            return out
        steps_ = int(count[0])
        active = np.searchsorted(-count, -np.arange(1, steps_ + 1), "right")  # texts with more than t words
        best = s[first[:alive]].astype(np.float64)
        jump, top = np.zeros(s.shape, bool), np.zeros(len(s), np.int16)
        for t in range(1, steps_):
            k = active[t]
            now = best[:k]
            lead = now.argmax(1)
            other = now[np.arange(k), lead] - self.switch
            at = first[:k] + t
            top[at] = lead
            jump[at] = other[:, None] > now
            best[:k] = np.maximum(now, other[:, None]) + s[at]
        state = best.argmax(1)
        for t in range(steps_ - 1, -1, -1):
            k = active[t]
            at = first[:k] + t
            out[at] = state[:k]
            if t:
                state[:k] = np.where(jump[at, state[:k]], top[at], state[:k])
        return out


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From at most about ``rows`` documents with a language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    some = bounded(known, rows, "lang")

    def work(batches) -> Iterator[dict]:
        counts: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for langs, texts in steps(batch.column(2), batch.column(1), PART):
                for lang in sorted(set(langs)):
                    w = words([t for t, k in zip(texts, langs, strict=True) if k == lang])
                    held = counts.setdefault(lang, [np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64)])
                    held[0] += np.bincount(w.grams, minlength=BUCKETS)
                    held[1] += np.bincount(w.script, w.size, len(SCRIPTS)).astype(np.int64)
        for lang, (grams, scripts) in counts.items():
            at, on = np.flatnonzero(grams), np.flatnonzero(scripts)
            yield {"lang": [lang] * (len(at) + len(on)), "place": np.concatenate([at, -1 - on]), "n": np.concatenate([grams[at], scripts[on]])}

    found = map_rows(some, work, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    cost, allowed = np.zeros((BUCKETS, max(1, len(langs))), np.float32), np.zeros((len(SCRIPTS), max(1, len(langs))), bool)
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        place, n = own["place"].to_numpy(np.int64), own["n"].to_numpy(float)
        grams = np.full(BUCKETS, 0.05)
        grams[place[place >= 0]] += n[place >= 0]
        cost[:, k] = np.log(grams / grams.sum())
        scripts = np.zeros(len(SCRIPTS))
        scripts[-1 - place[place < 0]] = n[place < 0]
        allowed[:, k] = scripts >= 0.01 * max(1, scripts.sum())
    allowed[~allowed.any(1)] = True
    return Model(langs, cost, allowed)


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """One row a span: doc_id, lang, start and end in characters, words, letters, margin.

    ``margin`` is how far the span's words prefer its language to the best other one, in nats.  A
    document without letters has one row whose lang is NULL.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**17 floats a language

    def work():
        m = held.value

        def columns(ids: list, texts: list) -> dict:
            w, s = m.scored(texts)
            names = {k: [] for k in ("doc_id", "lang", "start", "end", "words", "letters", "margin")}
            if not m.langs or not len(w.size):
                return names | {"doc_id": ids, "lang": [None] * len(ids)} | {k: [0] * len(ids) for k in ("start", "end", "words", "letters", "margin")}
            label = m.label(w, s, len(ids))
            rows = np.arange(len(label))
            other = s.copy()
            other[rows, label] = -np.inf
            gain = s[rows, label] - (other.max(1) if s.shape[1] > 1 else 0)
            new = np.flatnonzero(np.concatenate([[True], (w.owner[1:] != w.owner[:-1]) | (label[1:] != label[:-1])]))
            last = np.append(new[1:], len(label)) - 1
            none = np.setdiff1d(np.arange(len(ids)), w.owner)
            pad = [0] * len(none)
            return {
                "doc_id": [ids[i] for i in w.owner[new]] + [ids[i] for i in none],
                "lang": [m.langs[i] for i in label[new]] + [None] * len(none),
                "start": w.start[new].tolist() + pad,
                "end": (w.start + w.size)[last].tolist() + pad,
                "words": (last - new + 1).tolist() + pad,
                "letters": np.add.reduceat(w.size, new).tolist() + pad,
                "margin": np.add.reduceat(np.clip(gain, -WORD_CAP, WORD_CAP), new).astype(float).tolist() + pad,
            }

        return columns

    return map_texts(docs, work, "doc_id long, lang string, start long, end long, words long, letters long, margin double")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages (distinct ones labelled), spans: one row a document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        m = held.value

        def columns(ids: list, texts: list) -> dict:
            n, k = len(ids), max(1, len(m.langs))
            w, s = m.scored(texts)
            out = {"doc_id": ids, "lang_pred": ["und"] * n, "score": [0.0] * n, "languages": [0] * n, "spans": [0] * n}
            if not m.langs or not len(w.size):
                return out
            label = m.label(w, s, n)
            size = np.bincount(w.owner * k + label, w.size, n * k).reshape(n, k)
            best, total = size.argmax(1), size.sum(1)
            there = total > 0
            # the posterior of the text's language given the words labelled with it, times their share
            own = label == best[w.owner]
            sums = np.stack([np.bincount(w.owner[own], s[own, j], n) for j in range(k)], 1)
            odds = np.exp(np.clip(sums - sums.max(1, keepdims=True), -50, 0))
            share = size[np.arange(n), best] / np.maximum(total, 1)
            score = odds[np.arange(n), best] / odds.sum(1) * share
            turns = np.bincount(w.owner[1:][(w.owner[1:] == w.owner[:-1]) & (label[1:] != label[:-1])], minlength=n) + there
            return {"doc_id": ids, "lang_pred": [m.langs[i] if t else "und" for i, t in zip(best, there, strict=True)], "score": np.where(there, score, 0.0), "languages": (size > 0).sum(1).astype(np.int32), "spans": turns.astype(np.int64)}

        return columns

    return map_texts(docs, work, "doc_id long, lang_pred string, score double, languages int, spans long")


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, spans: trained on rows outside the held-out fold."""
    model = train(docs.where(fold("doc_id", FOLDS) != HELD_OUT))
    return identify(docs, model).withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT).select("doc_id", "held_out", "lang_pred", "score", "languages", "spans")
