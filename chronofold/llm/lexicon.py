"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first, each character by itself: lower case, accents and invisible
joiners go, letters that look alike in other scripts and full-width forms become Latin
letters, and digits or signs that stand for letters
inside a word become those letters. An entry matches at the start of a word; a whole-word
entry also needs the word's end, a stem does not. Matches inside an exception phrase do
not count. The matches' weights, and their rate per word, give a probability.

The weights are learned from labelled rows: at most ``SAMPLE`` of them, chosen by the
hash of their id, each distinct text once (texts with both labels are left out). Stems
have four to eight letters; words of two and three letters are entries as whole words.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, text_of, unused

#: Labelled rows that the lexicon and its calibration are learned from, at most.
SAMPLE = 12_000

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = "аaеeоoрpсcуyхxіiјjѕsԁdһhӏlкkмmтtвbнhɑaοoαaεeιiκkνvρpτtυuχxıi"
# Digits and signs that stand for letters.
SUBSTITUTES = "0o1i3e4a5s7t8b@a$s!i"
# Phrases in which an entry is harmless.
EXCEPTIONS = ("class clown", "clown fish", "clownfish", "pond scum", "trash can", "trash bin", "loser bracket", "pathetic fallacy")

_FOLD = {ord(HOMOGLYPHS[k]): HOMOGLYPHS[k + 1] for k in range(0, len(HOMOGLYPHS), 2)} | {0xFF01 + k: chr(0x21 + k) for k in range(94)}
_SUBST = {ord(SUBSTITUTES[k]): SUBSTITUTES[k + 1] for k in range(0, len(SUBSTITUTES), 2)}
_GONE = re.compile("[\u0300-\u036f\u200b-\u200d\u2060\ufeff\u00ad]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes to Latin; combining marks and invisible joiners go."""
    text = text.lower()
    return text if text.isascii() else _GONE.sub("", unicodedata.normalize("NFD", text)).translate(_FOLD)


class Lexicon:
    """entries: (pattern, weight, whole word?); calibration: bias, per log weight, per log rate."""

    def __init__(self, entries: list[tuple[str, float, bool]], calibration: tuple[float, float, float] = (-3.0, 3.0, 0.5), exceptions: tuple[str, ...] = EXCEPTIONS):
        self.calibration = calibration
        self.automaton = ahocorasick.Automaton()
        for pattern, weight, whole in entries:
            self.automaton.add_word(pattern, (len(pattern), weight, whole))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), 0.0, None))
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()

    def _weights(self, plain: str, view: str) -> list[tuple[int, float]]:
        hits, safe = [], []
        for end, (size, weight, whole) in self.automaton.iter(view):
            start = end - size + 1
            if start and plain[start - 1].isalnum():
                continue
            if whole is None:
                safe.append((start, end))
            elif not whole or end + 1 == len(plain) or not plain[end + 1].isalpha():
                hits.append((start, weight))
        if safe:
            hits = [h for h in hits if not any(a <= h[0] <= b for a, b in safe)]
        return hits

    def match(self, text: str | None) -> tuple[float, int, int]:
        """(sum of weights, matches, words). Of several entries at one place the heaviest counts."""
        plain = fold(text or "")
        words = len(plain.split())
        if self.empty or not words:
            return 0.0, 0, words
        best = dict[int, float]()
        for start, weight in self._weights(plain, plain.translate(_SUBST)):
            best[start] = max(weight, best.get(start, 0.0))
        if "1" in plain:  # it stands for i or for l
            for start, weight in self._weights(plain, plain.replace("1", "l").translate(_SUBST)):
                best[start] = max(weight, best.get(start, 0.0))
        return sum(best.values()), len(best), words

    def features(self, text: str | None) -> tuple[float, float]:
        weight, _, words = self.match(text)
        return math.log1p(weight), math.log1p(1000 * weight / (words + 20))

    def score(self, text: str | None) -> float:
        return self.score_of(self.match(text))

    def score_of(self, match: tuple[float, int, int]) -> float:
        bias, per_weight, per_rate = self.calibration
        weight, _, words = match
        x = bias + per_weight * math.log1p(weight) + per_rate * math.log1p(1000 * weight / (words + 20))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _words(text: str | None) -> frozenset[str]:
    return frozenset(w for w in _WORD.findall(fold(text or "").translate(_SUBST)) if len(w) >= 2)


def frequent(texts: list[frozenset[str]], least: int, longest: int = 8) -> dict[str, int]:
    """Stems of four to ``longest`` letters and whole words (marked by a blank behind) in at least ``least`` of the texts.

    A longer stem is at most as frequent as its shorter ones, so each length counts only
    words whose shorter stem is frequent: memory holds the frequent stems and their next letters.
    """
    kept: dict[str, int] = {}
    for size in (*range(4, longest + 1), None):
        seen: Counter = Counter()
        for words in texts:
            if size is None:
                seen.update({w + " " for w in words if len(w) < 4 or w[: min(longest, len(w))] in kept})
            else:
                seen.update({w[:size] for w in words if len(w) >= size and (size == 4 or w[: size - 1] in kept)})
        kept.update((c, n) for c, n in seen.items() if n >= least)
    return kept


def _stems(words: frozenset[str], longest: int = 8) -> set[str]:
    out = {w + " " for w in words}
    for w in words:
        out.update(w[:k] for k in range(4, min(longest, len(w)) + 1))
    return out


def learn(rows: list[tuple[str | None, int]], least: int = 6, precision: float = 0.75) -> Lexicon:
    """A lexicon from labelled texts. Without both labels it is empty and scores everything below one half."""
    both = {t for t, y in rows if y == 1} & {t for t, y in rows if y == 0}
    rows = [r for r in dict(rows).items() if r[0] not in both]  # each distinct text once
    toxic = [t for t, y in rows if y == 1]
    clean = [t for t, y in rows if y == 0]
    if not toxic or not clean:
        return Lexicon([], (-3.0, 0.0, 0.0))
    kept = frequent([_words(t) for t in toxic], least)
    against: Counter = Counter()
    for t in clean:
        against.update(kept.keys() & _stems(_words(t)))
    chosen: dict[str, float] = {}
    for c in sorted(kept, key=lambda x: (len(x.rstrip()), x)):
        n, m = kept[c], against[c]
        if n < precision * (n + m):
            continue
        if any(c[:k] in chosen for k in range(4, len(c.rstrip()) + 1)):
            continue  # a shorter stem has it
        chosen[c] = math.log((n + 0.5) / (len(toxic) + 1)) - math.log((m + 0.5) / (len(clean) + 1))
    # a stem all of whose uses are one whole word becomes that word
    entries = []
    for c, w in chosen.items():
        whole = [c] if c.endswith(" ") else [x for x in kept if x.endswith(" ") and x.startswith(c) and kept[x] >= 0.95 * kept[c]]
        entries.append((whole[0].rstrip(), w, True) if whole else (c.rstrip(), w, c.endswith(" ")))
    heaviest = sorted(set(entries), key=lambda e: (-e[1], e[0]))
    lexicon = Lexicon(heaviest)
    x = np.array([(1.0, *lexicon.features(t)) for t, _ in rows])
    y = np.array([float(v) for _, v in rows])
    beta = np.zeros(3)
    for _ in range(25):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-3, 1e-3])
        beta += np.linalg.solve(h, x.T @ (y - p) - np.array([1e-6, 1e-3, 1e-3]) * beta)
    return Lexicon(heaviest, tuple(float(b) for b in beta))


def entries_of(lexicon: Lexicon) -> list[tuple[str, float, bool]]:
    return [(k, v[1], v[2]) for k, v in lexicon.automaton.items() if v[2] is not None] if not lexicon.empty else []


def _dedup(batches):
    """One partition's rows become the lexicon's rows; it holds the bounded sample."""
    rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    lexicon = learn(sorted(rows, key=lambda r: (r[0] or "", r[1])))
    out = [*entries_of(lexicon), *((f"#{k}", v, None) for k, v in enumerate(lexicon.calibration))]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), pa.array([float(r[1]) for r in out]), pa.array([r[2] for r in out], pa.bool_())], ["pattern", "weight", "whole"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y): texts of at most ``limit`` labelled rows with ``keep`` true, chosen by the hash of their id.

    Ids with labels other than 0 and 1, or with both, are left out.
    """
    known = labels.where(keep & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("_z")).where("y = _z")
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(limit).select(F.col(id_col).alias("_id"), F.col("y").cast("int").alias("y"))
    picked = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    return picked.join(F.broadcast(chosen), "_id").select("text", "y")


def learn_from(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int = SAMPLE) -> Lexicon:
    """Learn a lexicon in one task over a bounded sample; the driver gets its entries alone."""
    sample = labelled_sample(docs, labels, label, keep, limit)
    # an exchange, not coalesce: the texts are read by all executors, only the sample meets in one task
    got = sample.repartition(1).mapInArrow(released(_dedup), "pattern string, weight double, whole boolean").collect()
    calibration = [r.weight for r in sorted((r for r in got if r.whole is None), key=lambda r: r.pattern)]
    return Lexicon([(r.pattern, r.weight, r.whole) for r in got if r.whole is not None], tuple(calibration) if calibration else (-3.0, 0.0, 0.0))


@functools.lru_cache(maxsize=4)
def _built(entries: tuple, calibration: tuple, exceptions: tuple) -> Lexicon:
    return Lexicon(list(entries), calibration, exceptions)


def score_texts(df: DataFrame, lexicon: Lexicon, text_col: str = "text", exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """All rows and columns of ``df`` with toxic_score, toxic_weight and toxic_hits added.

    Null and empty texts score the calibration's bias. Columns of ``df`` with the added
    names are replaced; repeated rows stay; an empty table gives an empty result.
    """
    recipe = (tuple(entries_of(lexicon)), lexicon.calibration, exceptions)
    kind = "struct<score:double,weight:double,hits:long>"

    @F.arrow_udf(kind)
    def scored(texts: pa.Array) -> pa.Array:
        built = _built(*recipe)
        matches = [built.match(t) for k in range(0, len(texts), 256) for t in texts.slice(k, 256).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([built.score_of(m) for m in matches], pa.float64()), pa.array([m[0] for m in matches], pa.float64()), pa.array([m[1] for m in matches], pa.int64())], ["score", "weight", "hits"])

    (m,) = unused(df, "_m")
    got = df.withColumn(m, scored(text_of(text_col)))
    return got.withColumns({"toxic_score": F.col(f"{m}.score"), "toxic_weight": F.col(f"{m}.weight"), "toxic_hits": F.col(f"{m}.hits")}).drop(m)
