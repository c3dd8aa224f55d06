"""Subject areas of documents: one-versus-rest linear classifiers over hashed word n-grams of a document's own sentences.

Quotes, signatures and edit notes are cut away, what is left is split into paragraphs and sentences. Weak labels come from
the hand labels of some documents and, for others, from the sections they stand in (their thread or board, where its labelled
documents agree). The model is fitted on a bounded sample in rounds: each round labels the sample's sentences anew with the
model of the round before, so wrong and missing labels wash out. Words that no labelled document has are reached through the
paragraphs in which they stand with known ones. Thresholds are then calibrated for each subject
on all hand-labelled documents, and a document gets every subject with which at least two of its sentences deal.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.session import ship

BITS = 18
_QUOTE_TAG = re.compile(r"<blockquote\b[^>]*>|</blockquote>|\[quote(?:=[^\]]*)?\]|\[/quote\]", re.IGNORECASE)
_LINE_TAG = re.compile(r"<br\s*/?>|</(?:p|div|li|tr|h[1-6])>|<(?:p|div|li|tr|h[1-6])\b[^>]*>", re.IGNORECASE)
_RULE_TAG = re.compile(r"<hr\s*/?>|\[size=1\]", re.IGNORECASE)
_ANY_TAG = re.compile(r"</?[A-Za-z][^<>]{0,400}>|\[/?[A-Za-z]+(?:=[^\[\]]{0,200})?\]")
_BLANK = r"[^\S\n]*"
_SIGNATURE = re.compile(rf"^{_BLANK}(?:-{{2,}}|~{{3,}}|_{{5,}}|\*{{5,}}|={{5,}}){_BLANK}$", re.MULTILINE)
#: Four lines of 80 characters.
SIGNATURE_CHARS = 320
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n|</p>|<br\s*/?>\s*<br\s*/?>", re.IGNORECASE)
#: Lines that are quoted, say when a post was edited, or who is quoted.
_NOT_OWN = re.compile(rf"""^{_BLANK}(?:(?:>|\|(?:\s|$)).*
    |[\[(*_]{{0,3}}{_BLANK}(?:last[^\S\n]+)?(?:edit(?:ed)?|bearbeitet|editado|modifié|édité)\b{_BLANK}(?:by|on|:|von|por|par|am|le|el).*
    |(?:\*\*)?[^\n]{{1,60}}\b(?:wrote|said|schrieb|escribió|a[ ]écrit|dijo|sagte){_BLANK}:?{_BLANK}:?(?:\*\*)?{_BLANK}$)\n?""",
    re.IGNORECASE | re.MULTILINE | re.VERBOSE)
#: The blanks and closing marks between sentences: after an end mark, a line break or a smiley.
_SENTENCE = re.compile(r"""[\s"')\]*_](?:(?<=[.!?…。！？](?s:.))[\s"')\]*_]*(?<=\s)|(?<=\n)\n*|(?:(?<=:-\)\s)|(?<=:\)\s))\s*)""")
#: Behind an end mark that needs no blank after it.
_FULL_STOP = re.compile(r"(?<=[。！？])(?![\s\"')\]*_]*\s)")
_TOKEN = re.compile(r"[^\W_]+|\n")
_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿]")


def _without_quotes(text: str) -> str:
    """`text` without quotes between tags, nested ones too. A quote that is never closed ends at the next paragraph break."""
    open_, closed = [], []
    for m in _QUOTE_TAG.finditer(text):
        if m[0][1] != "/":
            open_.append(m)
        elif open_:
            closed.append((open_.pop().start(), m.end()))
    outer: list[tuple[int, int]] = []
    for lo, hi in sorted(closed):
        if not outer or lo >= outer[-1][1]:
            outer.append((lo, hi))
    spans = list(outer)
    for m in open_:
        end = next((p.start() for p in _PARAGRAPH.finditer(text, m.end()) if not any(lo <= p.start() < hi for lo, hi in outer)), len(text))
        spans.append((m.start(), end))
    at, kept = 0, []
    for lo, hi in sorted(spans):
        if hi > at:
            kept += [text[at : max(at, lo)], "\n\n" if hi < len(text) or (lo, hi) in outer else ""]
            at = hi
    return "".join([*kept, text[at:]])


def own_text(text: str) -> str:
    """A post without quotes in any notation, its signature and edit notes; markup removed, entities decoded.

    A line that is only a rule begins the signature if at most SIGNATURE_CHARS characters of own lines follow up to the end of
    the text; else it divides sections.
    """
    if "<" in text or "[" in text or "&" in text:
        text = _RULE_TAG.sub("\n--\n", _without_quotes(text))
        text = html.unescape(_ANY_TAG.sub("", _LINE_TAG.sub("\n", text)))
    text = _NOT_OWN.sub("", _INVISIBLE.sub("", text))
    if not _SIGNATURE.search(text):
        return text
    lines, rules = text.split("\n"), []
    for i, line in enumerate(lines):
        if _SIGNATURE.match(line) and (rules or any(x.strip() for x in lines[:i])):
            rules.append(i)
            lines[i] = ""
    end, after, at = len(lines), 0, len(lines)
    for r in reversed(rules):
        after += sum(len(x.strip()) for x in lines[r:at])
        if after > SIGNATURE_CHARS:
            break
        end = at = r
    return "\n".join(lines[:end])


def own_paragraphs(text: str) -> list[list[str]]:
    """Sentences of a post's own words, by paragraph."""
    out = []
    text = own_text(text)
    if "。" in text or "！" in text or "？" in text:
        text = _FULL_STOP.sub("\n", text)
    for p in re.split(r"\n[ \t\r]*\n", text):
        s = [x.strip() for x in _SENTENCE.split(p) if x and x.strip()]
        if s:
            out.append(s)
    return out


class _Hashes(dict):
    """The hash of each word, below 2**32; 2**32 for the end of a sentence."""

    def __missing__(self, w: str) -> int:
        h = zlib.crc32(w.encode())
        if len(self) < 500_000:
            self[w] = h
        return h


_hashes = _Hashes({"\n": 1 << 32})


def features(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and pairs of words of all sentences, one after another, and where each sentence begins (one more at the end).

    Feature 0 is in each sentence and stands for it if it has no words.
    """
    n = len(sentences)
    words = _TOKEN.findall(unicodedata.normalize("NFKC", "\n".join(x.replace("\n", " ") for x in sentences) + "\n").casefold()) if n else []
    flat = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    ends = flat == np.uint64(1 << 32)
    sent = np.cumsum(ends) - ends
    word = ~ends
    both = word[1:] & word[:-1]
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    one, two = mix(flat), mix(flat[:-1] * np.uint64(0x9E3779B1) + flat[1:])
    one[ends] = 0
    # a word, or feature 0 at the end of a sentence, and the pair that begins with it
    idx = np.stack([one, np.append(two, 0)], axis=1).ravel()
    keep = np.stack([np.ones(len(flat), bool), np.append(both, False)], axis=1).ravel()
    of = np.repeat(sent, 2)[keep]
    return idx[keep], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray  # 2**BITS x subjects
    thresholds: np.ndarray

    def scores(self, idx: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of each subject for each sentence."""
        if len(at) < 2:
            return np.zeros((0, len(self.subjects)))
        z = np.add.reduceat(self.weights[idx], at[:-1], axis=0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def counts(self, p: np.ndarray, paragraph: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Sentences of each document that deal with each subject: p are the sentences' scores, `paragraph` (rising) and `doc` are where they stand.

        A sentence that is open between subjects goes with its paragraph, if that has two sure sentences on a subject.
        """
        k = len(self.subjects)
        n = np.zeros((docs, k), dtype=np.int64)
        if not len(p):
            return n
        sure = p >= self.thresholds
        np.add.at(n, doc, sure)
        at = np.flatnonzero(np.append(True, paragraph[1:] != paragraph[:-1]))
        total = np.add.reduceat(sure.astype(np.int64), at, axis=0)
        most = total.argmax(axis=1)
        place = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(p))))
        to = most[place]
        open_ = (total.max(axis=1) >= 2)[place] & ~sure.any(axis=1) & (p[np.arange(len(p)), to] >= self.thresholds[to] / 2)
        np.add.at(n, (doc[open_], to[open_]), 1)
        return n


def _occurrences(idx: np.ndarray, rows: np.ndarray, section: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (section, feature) pairs: each one's feature, and the pair of each entry of `idx`."""
    pair, to = np.unique(section[rows] * (1 << BITS) + idx, return_inverse=True)
    return pair & ((1 << BITS) - 1), to


def _select(occurrences: tuple[np.ndarray, np.ndarray], rows: np.ndarray, y: np.ndarray, weight: np.ndarray, purity: float, smooth: float) -> np.ndarray:
    """Features that stand mostly with one subject: mask over all of them.

    A feature counts for a subject with the square root of its sentences in each section, divided by the subject's own sum,
    so no long thread decides. `smooth` is added below, so a rare feature needs more purity; words that stand with
    everything, as those of common phrases, drop out.
    """
    of, to = occurrences
    w = y * weight[:, None]
    c = np.zeros((1 << BITS, y.shape[1]))
    for j in range(y.shape[1]):
        own = np.flatnonzero((w[:, j] > 0)[rows])
        each = np.bincount(to[own], weights=w[rows[own], j])
        some = np.flatnonzero(each)
        c[:, j] = np.bincount(of[some], weights=np.sqrt(each[some]), minlength=1 << BITS)
    share = c[0] / max(1e-9, c[0].sum())  # feature 0 is in every sentence
    r = c / np.maximum(share, 0.02) / y.shape[1]
    return r.max(axis=1) >= purity * (r.sum(axis=1) + smooth)


BIAS = -3.0


def _fit(idx: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, keep: np.ndarray, start: np.ndarray | None, l2: float = 0.02) -> np.ndarray:
    """Logistic regression for each column of y on the kept features, by full-batch steps with a rate for each weight.

    40 steps from nothing, or 15 from the weights of the round before (`start`). The weight of feature 0 stays as it is, so that a sentence without kept words has no subject; such sentences move no other
    weight and are left out.
    """
    entry = keep[idx] & (idx != 0) & (weight[rows] > 0)
    out = np.zeros((1 << BITS, y.shape[1]), dtype=np.float32)
    out[0] = BIAS
    if not entry.any():
        return out
    used, col = np.unique(idx[entry], return_inverse=True)
    row = rows[entry]
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    have = row[at]
    # sentences with the same kept words are one row, of the weight of them all
    alike = np.add.reduceat((used[col].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ ((used[col].astype(np.uint64) << np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)), at)
    _, first, to = np.unique(alike, return_index=True, return_inverse=True)
    length = np.diff(np.append(at, len(row)))
    col = np.concatenate([col[at[i] : at[i] + length[i]] for i in first.tolist()])
    row = np.repeat(np.arange(len(first)), length[first])
    for j in range(y.shape[1]):
        w = np.zeros(len(used)) if start is None else start[used, j].astype(float)
        seen, yj = np.full(len(used), 1e-6), y[have, j]
        each = weight[have] * np.where(yj > 0.5, 2.0, 1.0)
        much, said = np.bincount(to, weights=each, minlength=len(first)), np.bincount(to, weights=each * yj, minlength=len(first))
        for _ in range(40 if start is None else 15):
            z = BIAS + np.bincount(row, weights=w[col], minlength=len(first))
            g = much / (1 + np.exp(-np.clip(z, -30, 30))) - said
            grad = np.bincount(col, weights=g[row], minlength=len(used)) + l2 * w
            seen += grad**2
            w -= 0.8 * grad / np.sqrt(seen)
        out[used, j] = w
    return out


def _by_paragraph(sure: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    """Sums of the sentences of each paragraph; every paragraph has some, in a row."""
    return np.add.reduceat(sure.astype(np.int64), np.flatnonzero(np.append(True, paragraph[1:] != paragraph[:-1])), axis=0)


def _targets(p: np.ndarray, hinted: np.ndarray, paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New labels and weights of sentences: what the last model is sure of; elsewhere, with less weight, what the paragraph
    deals with (two sure sentences, no other subject), or the open subject that its document's label hints at.
    """
    sure = p >= 0.6
    out = np.where(sure, 1.0, 0.0)
    around = _by_paragraph(sure, paragraph)[paragraph]
    open_ = ~sure.any(axis=1)
    by_par = open_ & (around.max(axis=1) >= 2) & ((around > 0).sum(axis=1) == 1)
    out[by_par, around[by_par].argmax(axis=1)] = 1.0
    between = np.where(hinted > 0, p, 0)
    by_hint = open_ & ~by_par & (between.max(axis=1) > 0.2)
    out[by_hint, between[by_hint].argmax(axis=1)] = 1.0
    return out, np.where(sure.any(axis=1), 1.0, np.where(by_par | by_hint, 0.3, 0.2))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _returning(idx: np.ndarray, rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Features that come back within a document more often than by chance, as what a text is about does: mask over all of them."""
    both = _distinct(rows * (1 << BITS) + idx)
    row, f = both >> BITS, both & ((1 << BITS) - 1)
    n = np.bincount(f, minlength=1 << BITS)
    in_docs = np.bincount(_distinct(doc[row] * (1 << BITS) + f) & ((1 << BITS) - 1), minlength=1 << BITS)
    share = n / len(doc)
    chance = 1 - (1 - share) ** max(0.0, np.bincount(doc)[doc].mean() - 1)
    again = n - in_docs
    return (n >= 3) & (again >= 1) & (again / np.maximum(1, n) > 2 * chance + 0.05) & (share < 0.02)


def _grow(idx: np.ndarray, rows: np.ndarray, paragraph: np.ndarray, doc: np.ndarray, seed: np.ndarray, rounds: int = 4, margin: float = 2.0) -> np.ndarray:
    """The subject of paragraphs without one in `seed` (paragraphs x subjects): its returning words stand, by the log of their share over the
    mean share, with one subject by `margin` more than with any other. What is found counts in the next round.
    """
    k = seed.shape[1]
    ok = _returning(idx, rows, doc)[idx] & (idx != 0)
    both = _distinct(paragraph[rows[ok]] * (1 << BITS) + idx[ok])
    par = both >> BITS
    used, f = np.unique(both & ((1 << BITS) - 1), return_inverse=True)
    given, q = seed.max(axis=1) > 0, seed
    for _ in range(rounds):
        c = np.stack([np.bincount(f, weights=q[par, j], minlength=len(used)) for j in range(k)], axis=1)
        mean = (q.sum(axis=0) + 1) / (q.sum() + k)
        lift = np.log(np.maximum((c + mean) / (c.sum(axis=1, keepdims=True) + 1) / mean, 0.1))
        z = np.stack([np.bincount(par, weights=lift[f, j], minlength=len(seed)) for j in range(k)], axis=1)
        top = np.sort(z, axis=1)
        clear = (top[:, -1] > margin) & (top[:, -1] - (top[:, -2] if k > 1 else 0) > margin)
        q = np.where(given[:, None], seed, ((z == top[:, -1:]) & clear[:, None]).astype(float))
    return q


def _seeds(p: np.ndarray, paragraph: np.ndarray, hinted: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Subjects of paragraphs that are known: two sure sentences on one subject and none on another; where nothing is sure, the only hand label."""
    n = _by_paragraph(p >= 0.6, paragraph)
    one = ((n > 0).sum(axis=1) == 1)[:, None] & (n >= 2)
    said = _by_paragraph((hinted > 0) & ((base == 1) & (hinted.sum(axis=1) == 1))[:, None], paragraph) > 0
    return np.where((n.sum(axis=1) == 0)[:, None], said, one).astype(float)


def train(
    docs: list[tuple[list[list[str]], set[str], float, int]], subjects: list[str], purity: float = 0.45, smooth: tuple[float, ...] = (4.0, 4.0, 3.0, 2.0, 2.0, 2.0),
    again: tuple[float, ...] = (4.0, 4.0, 4.0),
) -> Model:
    """A model from (paragraphs, subjects, weight, section) of sample documents; weight 0 for those without a label of any kind.

    There is a round for each number in `smooth` (see `_select`), and after the paragraphs that are still open have been reached through their
    neighbours (see `_grow`) one for each in `again`. With fewer than ten hand-labelled documents a subject the numbers shrink
    with the root of them, as a feature can then stand in few labelled sentences. Thresholds are 0.5 until `calibrate` has set them.

    Without any labelled sentence all weights are 0 and no document gets a subject.
    """
    sents: list[str] = []
    doc_of: list[int] = []
    paragraph: list[int] = []
    for i, (paragraphs, *_) in enumerate(docs):
        for p in paragraphs:
            sents += p
            doc_of += [i] * len(p)
            paragraph += [paragraph[-1] + 1 if paragraph else 0] * len(p)
    k = len(subjects)
    if not sents or not any(w for _, _, w, _ in docs):
        return Model(subjects, np.zeros((1 << BITS, k), np.float32), np.full(k, 2.0))
    hint_doc = np.array([[s in ys for s in subjects] for _, ys, *_ in docs], dtype=float)
    of, par = np.array(doc_of), np.array(paragraph)
    hinted, base = hint_doc[of], np.array([w for _, _, w, _ in docs])[of]
    section = np.unique([g for *_, g in docs], return_inverse=True)[1][of]
    idx, at = features(sents)
    y, w = hinted, base / np.maximum(1, hinted.sum(axis=1))
    rows = np.repeat(np.arange(len(sents)), np.diff(at))
    occurrences = _occurrences(idx, rows, section)
    scale = min(1.0, (sum(w == 1 for _, _, w, _ in docs) / (10 * k)) ** 0.5)
    model = grown = None
    for i, much in enumerate((*smooth, *again)):
        if i == len(smooth):
            grown = _grow(idx, rows, par, of, _seeds(model.scores(idx, at), par, hinted, base))[par]
        if grown is not None:
            add = (w < 0.25) & (y.max(axis=1) == 0) & (grown.max(axis=1) > 0)
            y, w = np.where(add[:, None], grown == grown.max(axis=1, keepdims=True), y).astype(float), np.where(add, 0.5, w)
        keep = _select(occurrences, rows, y, w, purity, much * scale)
        model = Model(subjects, _fit(idx, rows, y, w, keep, model and model.weights), np.full(k, 0.5))
        y, w = _targets(model.scores(idx, at), hinted, par)
    return model


def tally(spark, model: Model, labelled: DataFrame, grid: tuple[float, ...], least: int = 2) -> np.ndarray:
    """Of hand-labelled documents (text, subjects as the model names them), for each threshold and subject: documents judged to
    have it, judged so and labelled so, labelled so. Documents are read whole on the executors; only sums come back.
    """
    k = len(model.subjects)
    used = np.flatnonzero(model.weights.any(axis=1)).astype(np.int32)
    shared = spark.sparkContext.broadcast((model.subjects, used, model.weights[used]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, used, weights = shared.value
        full = np.zeros((1 << BITS, k), dtype=np.float32)
        full[used] = weights
        sums = np.zeros((len(grid), 3, k), dtype=np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                scored = score_documents(Model(names, full, np.full(k, 0.5)), [own_paragraphs(t) for t in part["text"].to_pylist()])
                y = np.array([[s in ys for s in names] for ys in part["subjects"].to_pylist()]).reshape(-1, k)
                for i, t in enumerate(grid):
                    trial = Model(names, full, np.full(k, t))
                    hit = trial.counts(*scored, part.num_rows) >= least
                    sums[i] += np.stack([hit.sum(axis=0), (hit & y).sum(axis=0), y.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["place", "n"])

    out = np.zeros((len(grid), 3, k), dtype=np.int64)
    for r in labelled.select("text", "subjects").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out.ravel()[r.place] = r.n
    shared.unpersist()
    return out


def calibrate(spark, model: Model, labelled: DataFrame, grid: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7), least: int = 2) -> np.ndarray:
    """For each subject the threshold with the best F1 on all hand-labelled documents (see `tally`); 0.5 in a tie and without documents."""
    k = len(model.subjects)
    best, out = np.full(k, -1.0), np.full(k, 0.5)
    sums = tally(spark, model, labelled, grid, least)
    for t in sorted(grid, key=lambda t: abs(t - 0.5)):
        hit, both, said = sums[grid.index(t)]
        f1 = 2 * both / np.maximum(1, hit + said)
        better = f1 > best + 0.01
        best, out = np.where(better, f1, best), np.where(better, t, out)
    return out


def hand_labelled(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, subjects: list[str]) -> DataFrame:
    """(text, subjects): every document with a hand label among `subjects`."""
    said = labels.select(F.col(label_id).alias("id"), F.lower(F.trim(label_col)).alias("subject")).where(F.col("id").isNotNull() & F.col("subject").isin(subjects))
    said = said.groupBy("id").agg(F.collect_set("subject").alias("subjects"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(said, "id").select("text", "subjects")


def score_documents(model: Model, docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all sentences of documents (lists of paragraphs), the number of the paragraph and of the document of each."""
    n = [[len(p) for p in ps] for ps in docs]
    of = np.repeat(np.arange(len(docs)), [len(x) for x in n])
    size = np.array([x for xs in n for x in xs], dtype=np.int64)
    return model.scores(*features([s for ps in docs for p in ps for s in p])), np.repeat(np.arange(len(size)), size), np.repeat(of, size)


def section_name(c: Column) -> Column:
    """A section without blanks around it and regardless of letter case and of - and _; null for an empty one."""
    name = F.translate(F.lower(F.trim(c.cast("string"))), "-", "_")
    return F.when(name != "", name)


def sample(
    docs: DataFrame, id_col: str, text_col: str, section_cols: Sequence[str], labels: DataFrame, label_id: str, label_col: str,
    *, hand_docs: int, other_docs: int, fit_chars: int,
) -> DataFrame:
    """(paragraphs, subjects, weight, section): the rows that the model is fitted on, each with all its own sentences.

    At most `hand_docs` documents with hand labels and `other_docs` without, those first of which a section's labelled documents mostly
    agree (the sections in the order of `section_cols`), both in the order of the id's hash; of those, documents without a text or of more than
    `fit_chars` characters are left out, so the sample is bounded. `section` is the first of the sections.
    """
    said = labels.where(F.col(label_id).isNotNull()).select(F.col(label_id).alias("id"), F.lower(F.trim(label_col)).alias("subject")).where("subject IS NOT NULL").distinct()
    names = [f"s{i}" for i in range(len(section_cols))]
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[section_name(F.col(c)).alias(n) for c, n in zip(section_cols, names)])
    labelled = said.join(ids, "id")
    hand = labelled.groupBy("id").agg(F.first(names[0]).alias("section"), F.sort_array(F.collect_set("subject")).alias("subjects"))
    hand = hand.orderBy(F.xxhash64("id"), "id").limit(hand_docs).withColumn("weight", F.lit(1.0))
    other = ids.join(said.select("id").distinct(), "id", "left_anti").withColumn("subject", F.lit(None).cast("string"))
    for n in names:
        agreed = labelled.where(F.col(n).isNotNull()).groupBy(n, "subject").agg(F.count("*").alias("n")).groupBy(n).agg(
            F.max_by("subject", F.struct("n", "subject")).alias("most"), (F.max("n") / F.sum("n")).alias("share")).where("share >= 0.6").select(n, "most")
        other = other.join(agreed, n, "left").withColumn("subject", F.coalesce("subject", "most")).drop("most")
    other = other.orderBy(F.col("subject").isNull(), F.xxhash64("id"), "id").limit(other_docs).select(
        "id", F.col(names[0]).alias("section"), F.when(F.col("subject").isNull(), F.array().cast("array<string>")).otherwise(F.array("subject")).alias("subjects"),
        F.when(F.col("subject").isNull(), 0.0).otherwise(0.5).alias("weight"))
    chosen = hand.unionByName(other)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.char_length("text") <= fit_chars).join(F.broadcast(chosen), "id")
    rows = rows.select("text", "subjects", "weight", F.coalesce(F.xxhash64("section"), F.xxhash64("id")).alias("section"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [own_paragraphs(text) for text in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.string()))), b["subjects"], b["weight"], b["section"]], names=["paragraphs", "subjects", "weight", "section"])

    return rows.mapInArrow(run, "paragraphs array<array<string>>, subjects array<string>, weight double, section long")


def subject_counts(
    docs: DataFrame, id_col: str, text_col: str, section_cols: Sequence[str], labels: DataFrame, label_id: str, label_col: str, areas: DataFrame, area_col: str,
    *, least: int = 2, hand_docs: int = 8_000, other_docs: int = 6_000, fit_chars: int = 100_000, max_subjects: int = 1_000,
) -> DataFrame:
    """(id, subject, sentences): the subjects with which at least `least` of a document's own sentences deal.

    Only the fit is made on a sample (see `sample` for its bounds); thresholds are calibrated on every hand-labelled document, and
    every document is read whole and judged. Subjects come out as
    `areas` spells them, labels of other subjects are ignored. Null, empty and blank texts have no subject, nor has anything
    if there are no labels or no areas. Repeated ids are judged row by row. The driver holds the sample and a model of
    2**18 weights for each subject; more than `max_subjects` subjects are an error.
    """
    spark = docs.sparkSession
    ship(spark)
    spelled = [r[0] for r in areas.select(area_col).where(F.col(area_col).isNotNull()).distinct().limit(max_subjects + 1).collect()]
    if len(spelled) > max_subjects:
        raise ValueError(f"more than {max_subjects} subjects")
    spelled.sort()
    subjects = [s.strip().lower() for s in spelled]
    how = {"hand_docs": hand_docs, "other_docs": other_docs, "fit_chars": fit_chars}
    section_cols = [section_cols] if isinstance(section_cols, str) else section_cols
    taken = sample(docs, id_col, text_col, section_cols, labels, label_id, label_col, **how).collect() if subjects else []
    rows = sorted(((r.paragraphs, set(r.subjects) & set(subjects), r.weight, r.section) for r in taken), key=lambda r: (r[3], r[0]))
    model = train([(p, y, w if y else 0.0, g) for p, y, w, g in rows], subjects)
    if model.weights.any():
        model.thresholds = calibrate(spark, model, hand_labelled(docs, id_col, text_col, labels, label_id, label_col, subjects), least=least)
    used = np.flatnonzero(model.weights.any(axis=1)).astype(np.int32)
    shared = spark.sparkContext.broadcast((used, model.weights[used], model.thresholds))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, thresholds = shared.value
        full = np.zeros((1 << BITS, len(spelled)), dtype=np.float32)
        full[used] = weights
        m = Model(spelled, full, thresholds)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                n = m.counts(*score_documents(m, [own_paragraphs(t) for t in part["text"].to_pylist()]), part.num_rows)
                doc, subject = np.nonzero(n >= least)
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(doc)), pa.array([spelled[k] for k in subject], pa.string()), pa.array(n[doc, subject])], names=["id", "subject", "sentences"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND text <> ''")
    schema = f"id {id_type}, subject string, sentences long"
    return picked.mapInArrow(run, schema) if subjects else spark.createDataFrame([], schema)
