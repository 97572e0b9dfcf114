"""Language identification of mixed texts: script ranges, then Viterbi over per-word scores.

The script of a word's first letter (any of Unicode's, by the letter's name;
Han with kana counts as Kana) narrows its candidate languages: those of the
labelled rows that are written in it, else the script's usual one (DEFAULTS);
a single candidate decides it.  Within a shared script a word scores the sum of
its letter-trigram log-probabilities in each candidate (of its characters, for
Han), less the mean, clipped so that no single word forces a switch.  Viterbi
picks the sequence of labels of the highest total, each change of language
costing a fixed penalty.

Most texts hold one language, and for those the best constant label is proven
optimal without the dynamic program: if no stretch of words gains more than
half the penalty by any other label, no path with changes can win.

The tables are fitted here, on at most TRAIN_DOCS labelled rows (lowest hash of
the id) and LANGUAGE_DOCS more of each language, TRAIN_DOCS again in all, so
that rare languages are learned; the labelling covers every word of every text.
Whole texts are counted where they lie: what reaches the driver are counts of
trigrams and letters of a language and script, not texts.  An id on several
rows counts with all of them, so the sample doesn't depend on the order of rows.

Defined results: a null or empty text, or one without words of a script that
has a language, is "und" with confidence 0 and no spans; a null id is kept; a
repeated row is labelled again; languages of fewer than MIN_DOCS labelled rows
are not learned; a script's usual language gives way to labelled ones; with no
labelled rows at all, or no column lang, Latin-script words stay unknown;
accepted() rejects only what could be told: a text whose words are all of
scripts that have no language stays; equal totals go to the language that comes
first by name; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, lowered, pieces

TRAIN_DOCS, LANGUAGE_DOCS, MIN_DOCS = 4_000, 50, 5
#: Of the letters of a language's rows that a script must hold for the language to be written in it.
MIN_SHARE = 0.1
PENALTY, CLIP, OTHER = 16.0, 6.0, -8.0
MIN_CONFIDENCE = 0.5
#: Words whose scores are kept, and words that are looked up at once; rows that are held as texts at once.
MEMO, STEP, ROWS = 200_000, 1 << 14, 1024
def _runs(codes: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of successive numbers."""
    cut = [i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1]
    return [(codes[i], codes[j - 1]) for i, j in zip([0, *cut], [*cut, len(codes)])]


MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in _runs([c for c in range(0x300, 0x1F000) if unicodedata.category(chr(c)) in ("Mn", "Mc")]))
#: Letters with the vowel signs and other marks between them.
LETTERS = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*")
#: The language of a script of which no labelled rows are learned.
DEFAULTS = dict(
    x.split(":")
    for x in "Greek:el Cyrillic:ru Hebrew:he Arabic:ar Devanagari:hi Thai:th Hangul:ko Kana:ja Han:zh Bopomofo:zh Bengali:bn Tamil:ta Telugu:te Gujarati:gu Gurmukhi:pa Oriya:or Kannada:kn Malayalam:ml Sinhala:si Lao:lo "
    "Tibetan:bo Myanmar:my Georgian:ka Armenian:hy Ethiopic:am Khmer:km Mongolian:mn Thaana:dv Cherokee:chr Syriac:syr Canadian:iu Yi:ii Tifinagh:zgh Nko:nqo Javanese:jv Balinese:ban Sundanese:su Meetei:mni Vai:vai Adlam:ff Coptic:cop Gothic:got".split()
)
_OF_NAME = {"Cjk": "Han", "Ideographic": "Han", "Hiragana": "Kana", "Katakana": "Kana", "Katakana-Hiragana": "Kana", "Hentaigana": "Kana"}


@lru_cache(None)
def script(char: str) -> str | None:
    """By the letter's Unicode name, whose first words are its script's."""
    name = unicodedata.name(char, "").title().split()
    if char < "\u0250":
        return "Latin"
    if not name:
        return "Tangut" if 0x17000 <= ord(char) < 0x18B00 else None
    if name[0] in ("Fullwidth", "Halfwidth"):
        name = name[1:]
    kind = " ".join(name[:2]) if name[0] in ("Old", "New", "Ol", "Tai", "Linear") else name[0]
    return _OF_NAME.get(kind, kind)


def script_of(word: str) -> str | None:
    """Of the first letter; Han with kana is Kana."""
    kind = script(word[0])
    return "Kana" if kind == "Han" and any("Kana" == script(c) for c in word) else kind


def grams(word: str, kind: str) -> list[str]:
    """Trigrams; the characters themselves where each is a word."""
    if kind == "Han":
        return list(word)
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def counted(rows) -> Counter:
    """(language, script, gram) -> n of (language, text) rows; gram None counts letters, script None rows."""
    words: dict[str, Counter] = {}
    out: Counter = Counter()
    for lang, text in rows:
        out[lang, None, None] += 1
        words.setdefault(lang, Counter()).update(LETTERS.findall(lowered(text)))
    for lang, own in words.items():
        for word, n in own.items():
            kind = script_of(word)
            for g in grams(word, kind):
                out[lang, kind, g] += n
            for c in word:
                if c.isalpha():
                    out[lang, script(c), None] += n
    return out


class Table:
    """Gram scores of the languages of one script."""

    def __init__(self, kind: str, languages: list[str], counts: dict[str, list[int]]):
        self.kind, self.languages = kind, languages
        self.index = {g: i + 1 for i, g in enumerate(sorted(counts))}
        table = np.array([np.zeros(len(languages)), *(counts[g] for g in sorted(counts))]) + 0.2
        logs = np.log(table / table.sum(axis=0))
        self.logs = (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)
        self.logs[0] = 0

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.languages) == 1:
            return np.full((len(words), 1), CLIP, np.float32)
        known, flat, start = self.index.get, [], []
        for w in words:
            start.append(len(flat))
            flat += [known(g, 0) for g in grams(w, self.kind)]
        x = np.add.reduceat(self.logs[flat], start, axis=0)
        return np.clip(x - x.mean(axis=1, keepdims=True), -CLIP, CLIP)


class Model:
    """Languages, and for each script the table of those that are written in it; from counted() or rows (language, text)."""

    def __init__(self, counts: Counter | list[tuple[str, str]]):
        counts = counts if isinstance(counts, Counter) else counted(counts)
        size: dict[str, Counter] = {lang: Counter() for (lang, kind, _), n in counts.items() if kind is None and n >= MIN_DOCS}
        seen: dict[str | None, set] = {}
        for (lang, kind, g), n in counts.items():
            if lang in size and (kind is not None or g is not None):
                if g is None:
                    size[lang][kind] += n
                else:
                    seen.setdefault(kind, set()).add(lang)
        self.candidates = {k: [v] for k, v in DEFAULTS.items()}
        for kind in seen:
            if kind and (own := sorted(k for k in seen[kind] if size[k][kind] >= MIN_SHARE * size[k].total())):
                self.candidates[kind] = own
        self.languages = sorted({x for v in self.candidates.values() for x in v})
        tables: dict[str, dict[str, list[int]]] = {k: {} for k in self.candidates}
        for (lang, kind, g), n in counts.items():
            own = self.candidates.get(kind, ())
            if g is not None and lang in own and len(own) > 1:
                tables[kind].setdefault(g, [0] * len(own))[own.index(lang)] += n
        self.tables = {k: Table(k, v, tables[k]) for k, v in self.candidates.items()}
        self.at = {k: np.array([self.languages.index(x) for x in v], np.int64) for k, v in self.candidates.items()}

    def score(self, words: list[str]) -> np.ndarray:
        """Of each word in each language; all 0 for a word of no known script."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        of: dict[str | None, list[int]] = {}
        for i, w in enumerate(words):
            of.setdefault(script_of(w), []).append(i)
        for kind, rows in of.items():
            if kind in self.tables:
                out[rows] = OTHER
                out[np.ix_(rows, self.at[kind])] = self.tables[kind].scores([words[i] for i in rows])
        return out


class _Scores(dict):
    """word -> row of a score table of fixed size; the rows of new words are filled together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table, self.new = model, np.zeros((MEMO + STEP, len(model.languages)), np.float32), []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        if len(words) > STEP:
            return np.concatenate([self.of(words[i : i + STEP]) for i in range(0, len(words), STEP)])
        if len(self) > MEMO:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self._fill()
        return self.table[at]

    def _fill(self):
        first, words = len(self) - len(self.new), self.new
        self.new = []
        self.table[first : first + len(words)] = self.model.score(words)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Labels of the best path; a tie keeps the earlier label, then the lower index."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int32)
    best = scores[0].astype(np.float64).tolist()
    rows = scores.astype(np.float64).tolist()
    states = range(k)
    for t in range(1, n):
        top = max(states, key=best.__getitem__)
        jump = best[top] - penalty
        row, b = rows[t], back[t]
        for j in states:
            if best[j] >= jump:
                b[j] = j
                best[j] += row[j]
            else:
                b[j] = top
                best[j] = jump + row[j]
    label = np.zeros(n, np.int32)
    label[-1] = max(states, key=best.__getitem__)
    for t in range(n - 1, 0, -1):
        label[t - 1] = back[t, label[t]]
    return label


def labels(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """As viterbi; texts whose best constant label is provably optimal skip the dynamic program."""
    top = int(scores.sum(axis=0, dtype=np.float64).argmax())
    better = (scores > scores[:, top : top + 1]).any(axis=0)
    better[top] = True
    used = np.flatnonzero(better)  # a label that the best constant one never falls behind is in no better path
    if len(used) < 2:
        return np.full(len(scores), top, np.int32)
    scores, top = scores[:, used], int(np.searchsorted(used, top))
    gain = np.cumsum(scores - scores[:, top : top + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty / 2:
        return np.full(len(scores), used[top], np.int32)
    return used[viterbi(scores, penalty)]


def identify(text: str | None, scores: _Scores) -> tuple[str, float, int, list[tuple[int, int, str]]]:
    """Dominant language, confidence, number of words, spans (first and last character, language)."""
    low = lowered(text) if text else ""
    words = LETTERS.findall(low)
    s = scores.of(words) if words else np.zeros((0, 0))
    known = s.any(axis=1) if len(s) else np.zeros(0, bool)
    if not known.any():
        return "und", 0.0, len(words), []
    names = scores.model.languages
    path = labels(s)
    if (path == path[0]).all():
        spans = [(0, len(text), names[path[0]])]
        main = int(path[0])
        own = s
    else:
        at = [m.span() for m in LETTERS.finditer(low)]
        cut = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]).tolist()
        start = [0, *(at[i][0] for i in cut[1:])]
        spans = [(a, b, names[path[i]]) for a, b, i in zip(start, [*start[1:], len(text)], cut)]
        size = np.bincount(path, weights=[e - b for b, e in at], minlength=len(names))
        main = int(size.argmax())
        own = s[path == main]
    z = own.sum(axis=0, dtype=np.float64)
    return names[main], float(1 / np.exp(z - z[main]).sum()), len(words), spans


def untold(text: str, model: Model) -> bool:
    """Whether no word of a text is of a script that has a language."""
    return not any(script_of(w) in model.tables for w in LETTERS.findall(lowered(text)))


SPAN = "doc_id long, lang string, confidence double, n_words int, spans array<struct<start:int,end:int,lang:string>>"


def fit(docs: DataFrame) -> Model:
    """A model of at most 2 x TRAIN_DOCS ids with a label in lang: those of lowest hash, of all and of each language."""
    if "lang" not in docs.columns:
        return Model([])
    labelled = docs.where("lang is not null and text is not null")
    keys = labelled.where("doc_id is not null").select("doc_id", "lang").distinct()
    lowest = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = {r[0] for r in keys.select("doc_id").distinct().orderBy(*lowest).limit(TRAIN_DOCS).collect()}
    at = F.row_number().over(Window.partitionBy("lang").orderBy(*lowest)).alias("_lw_at")
    ids |= {r[0] for r in keys.select("doc_id", "lang", at).where(F.col("_lw_at") <= LANGUAGE_DOCS).orderBy("_lw_at", "lang").limit(TRAIN_DOCS).collect()}
    if not ids:
        return Model([])
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            total.update(counted(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        rows = [(*k, n) for k, n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    chosen = labelled.where(F.col("doc_id").isin(sorted(ids))).select(F.col("lang").cast("string"), "text")
    found = arrow_map(chosen, run, "lang string, kind string, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    return Model(Counter({(r[0], r[1], r[2]): r[3] for r in found.collect()}))


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, confidence, n_words, spans) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # TRAIN_DOCS bounds its size
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int32()), ("spans", pa.list_(struct))])

    def run(batches):
        scores = _Scores(shared.value)
        for b in pieces(batches, ROWS):
            found = [identify(x, scores) for x in b.column(1).to_pylist()]
            spans = [[{"start": a, "end": e, "lang": k} for a, e, k in f[3]] for f in found]
            cols = [pa.array([f[i] for f in found], schema.field(i + 1).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(spans, schema.field(4).type)], schema=schema)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SPAN)


def _accepts(shared, min_confidence: float):
    def run(batches):
        scores = _Scores(shared.value)
        for b in pieces(batches, ROWS):
            texts = b.column("text").to_pylist()
            found = [identify(x, scores) for x in texts]
            yield b.filter(pa.array([f[1] >= min_confidence if f[0] != "und" else f[2] > 0 and untold(x, scores.model) for x, f in zip(texts, found)], pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """docs with a known language of at least min_confidence; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    return arrow_map(docs, _accepts(shared, min_confidence), docs.schema)
