"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text is its words of letters, lower-cased, each between two boundary marks; contexts don't cross words. The language of
the least cross-entropy per character wins. The score is a softmax of these entropies, scaled on held-back training rows;
an entropy above what such rows of the language show is a rejection.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import U64, WordTable, byte_slices, durable, mix, utf8

ORDER = 5
#: Bounds of the training sample: rows per language, rows in all, and characters of a row that is drawn.
TRAIN_ROWS, TRAIN_ALL, TRAIN_CHARS = 500, 8_000, 20_000
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letters(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of all characters of the marked words: word index, place in the word, and hashes of the 1 to ORDER characters that end there."""
    marked = [f"\x02{w}\x03" for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    word = np.repeat(np.arange(len(words)), size)
    pos = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    one = mix(code + U64(0x51ED27))
    out = [one]
    for n in range(2, ORDER + 1):
        h = np.zeros_like(one)
        h[n - 1 :] = mix(out[-1][n - 1 :] * U64(0x9E3779B97F4A7C15) + one[: len(one) - n + 1])
        out.append(h)
    return word, pos, out


@dataclass
class Model:
    """Per order (from 1): sorted n-gram hashes with log probabilities, sorted context hashes with log back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    backs: list[tuple[np.ndarray, np.ndarray]]
    unseen: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word with its end mark."""
        word, pos, h = _grams(words)
        total = np.zeros(len(word))
        open_ = pos > 0
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(open_ & (pos >= n - 1))
            keys, logp = self.grams[n - 1]
            i = np.minimum(np.searchsorted(keys, h[n - 1][at]), max(0, len(keys) - 1))
            hit = (keys[i] == h[n - 1][at]) if len(keys) else np.zeros(len(at), bool)
            total[at[hit]] += logp[i[hit]]
            open_[at[hit]] = False
            rest = at[~hit]
            if n == 1:
                total[rest] += self.unseen
                break
            keys, back = self.backs[n - 1]
            context = h[n - 2][rest - 1]
            i = np.minimum(np.searchsorted(keys, context), max(0, len(keys) - 1))
            if len(keys):
                total[rest] += np.where(keys[i] == context, back[i], 0)
        return np.bincount(word, total, len(words))


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, an index of each, and sums."""
    u, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return u, first, np.bincount(inverse, values, len(u))


def fit(counts: Counter, alphabet: int) -> Model:
    """Interpolated Kneser-Ney from word counts. Lower orders count distinct left neighbours; n-grams at a word's start, which have none, count themselves."""
    words = list(counts)
    weight = np.array([counts[w] for w in words], float)
    word, pos, h = _grams(words)
    tables: list = [None] * ORDER
    above: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(ORDER, 0, -1):
        at = np.flatnonzero((pos >= n - 1) & (pos > 0))
        if above is None:
            keys, value, place = h[n - 1][at], weight[word[at]], at
        else:
            start = at[pos[at] == n - 1]
            keys = np.concatenate([above[1], h[n - 1][start]])
            place = np.concatenate([above[0], start])
            value = np.concatenate([np.ones(len(above[0])), weight[word[start]]])
        u, first, a = _sum_by(keys, value)
        place = place[first]
        tables[n - 1] = (u, place, a)
        if n > 1:
            above = (place, h[n - 2][place])
    grams, backs, lower = [], [], np.log(1 / alphabet)
    below: tuple[np.ndarray, np.ndarray] | None = None
    unseen = lower
    for n in range(1, ORDER + 1):
        u, place, a = tables[n - 1]
        n1, n2 = float((a == 1).sum()), float((a == 2).sum())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context = h[n - 2][place - 1] if n > 1 else np.zeros(len(u), U64)
        c, _, sums = _sum_by(context, a)
        types = np.bincount(np.searchsorted(c, context), minlength=len(c))
        lam = d * types / sums
        i = np.searchsorted(c, context)
        rest = np.exp(below[1][np.searchsorted(below[0], h[n - 2][place])]) if below is not None else np.full(len(u), 1 / alphabet)
        p = np.maximum(a - d, 0) / sums[i] + lam[i] * rest
        below = (u, np.log(p))
        grams.append((u, np.log(p).astype(np.float32)))
        backs.append((c, np.log(lam).astype(np.float32)))
        if n == 1 and len(lam):
            unseen = float(np.log(lam[0] / alphabet))
    return Model(grams, backs, unseen)


class Identifier:
    """Models of several languages with a bounded memo of word scores."""

    #: Scores that the memo holds.
    LIMIT = 20_000_000

    def __init__(self, models: dict[str, Model], scale: float = 1.0, most: dict[str, float] | None = None):
        self.languages, self.models, self.scale = sorted(models), models, scale
        self.most = most or {}
        self._table = WordTable()
        self._table.limit = max(20_000, min(self._table.limit, self.LIMIT // (len(models) + 1)))
        self._forget()

    def __getstate__(self):
        return {"models": self.models, "scale": self.scale, "most": self.most}

    def __setstate__(self, s):
        self.__init__(**s)

    def _forget(self) -> None:
        self._rows, self._held = np.zeros((0, len(self.models) + 1), np.float32), 0

    def _learn(self, new: list[bytes]) -> None:
        """Keeps the log probabilities of each token's words by language, and characters counted."""
        found = [letters(t.decode("utf-8", "replace")) for t in new]
        distinct = list({w for ws in found for w in ws})
        rows = np.zeros((len(new), len(self.languages) + 1), np.float32)
        if distinct:
            number = {w: i for i, w in enumerate(distinct)}
            per = np.stack([self.models[x].word_scores(distinct) for x in self.languages] + [np.array([len(w) + 1 for w in distinct], float)], axis=1)
            owner = np.repeat(np.arange(len(new)), [len(ws) for ws in found])
            of = np.array([number[w] for ws in found for w in ws], np.int64)
            for j in range(per.shape[1]):
                rows[:, j] = np.bincount(owner, per[of, j], len(new))
        need = self._held + len(new)
        if need > len(self._rows):
            self._rows = np.concatenate([self._rows[: self._held], np.zeros((max(len(new), self._held), rows.shape[1]), np.float32)])
        self._rows[self._held : need] = rows
        self._held = need

    def entropies(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text and language (nan without letters), and characters counted."""
        at, ends = self._table.numbers(texts, self._learn, self._forget)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        sums = np.stack([np.bincount(owner, self._rows[at, j], len(texts)) for j in range(self._rows.shape[1])], axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return -sums[:, :-1] / sums[:, -1:], sums[:, -1]

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy and whether it is rejected."""
        h, n = self.entropies(texts)
        out = []
        for row, chars in zip(h, n):
            if not chars or not self.languages:
                out.append((UNKNOWN, 0.0, None, True))
                continue
            best = int(np.argmin(row))
            e = np.exp(-(row - row[best]) * self.scale)
            name = self.languages[best]
            out.append((name, float(e[best] / e.sum()), float(row[best]), bool(row[best] > self.most.get(name, np.inf))))
        return out


def fit_identifier(rows: list[tuple[str, str]], held: float = 0.2) -> Identifier:
    """From (language, text) rows: models of the first part of each language, scale and rejection from the rest."""
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    counts, rest = {}, []
    for lang, texts in by.items():
        n = max(1, round(len(texts) * (1 - held)))
        counts[lang] = Counter(w for t in texts[:n] for w in letters(t))
        rest += [(lang, t) for t in texts[n:]]
    counts = {x: c for x, c in counts.items() if c}
    alphabet = len({ch for c in counts.values() for w in c for ch in w}) + 2
    found = Identifier({x: fit(c, alphabet) for x, c in counts.items()})
    rest = [(x, t) for x, t in rest if x in counts]
    if not rest or not counts:
        return found
    h, n = found.entropies([t.encode() for _, t in rest])
    true = np.array([found.languages.index(x) for x, _ in rest])
    ok = n > 0
    h, true = h[ok], true[ok]
    best = (np.inf, 1.0)
    for scale in np.geomspace(0.5, 64, 29):
        z = -(h - h.min(axis=1, keepdims=True)) * scale
        loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), true])) if len(z) else 0.0
        best = min(best, (loss, float(scale)))
    found.scale = best[1]
    for i, x in enumerate(found.languages):
        own = h[true == i, i]
        if len(own):
            found.most[x] = float(own.max() + 3 * own.std() + 0.1)
    return found


def train(docs: DataFrame, learn: Column, key: Column, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, seed: int = 3, most: int = TRAIN_ALL) -> Identifier:
    """Fits on a bounded sample: per language of the rows that ``learn`` admits, those of the least seeded hashes of ``key``.

    Null languages, keys and texts are not drawn. Of a text longer than ``chars`` a slice from a seeded place is drawn, so
    that languages of long texts are learned too; of rows that repeat a key, one. Each language has ``rows`` at most, or its
    part of ``most`` where languages are many (more languages than that are an error). The sample is fitted on the driver;
    the drawing sorts hashes only and keeps ``rows`` per language before any shuffle. An empty table gives no language."""
    can = docs.select("lang", key.alias("_key"), "text").filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("_key").isNotNull())
    order = F.xxhash64(F.lit(seed), F.col("_key"))
    ids = can.select("lang", F.col("_key"), order.alias("_o")).select("*", F.dense_rank().over(Window.partitionBy("lang").orderBy("_o", "_key")).alias("_n")).filter(F.col("_n") <= rows)
    ids = durable(ids.select("lang", "_key", "_n").distinct())
    languages = ids.select("lang").distinct().count()
    if languages > most:
        raise ValueError(f"more than {most} languages")
    ids = ids.filter(F.col("_n") <= max(1, min(rows, most // max(1, languages))))
    over = F.length("text") - chars
    cut = F.when(over > 0, F.substring("text", F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), over + 1).cast("int") + 1, F.lit(chars))).otherwise(F.col("text"))
    # at most ``most`` rows
    drawn = can.join(F.broadcast(ids), ["lang", "_key"]).groupBy("lang", "_n").agg(F.min(cut).alias("text")).collect()
    return fit_identifier([(r["lang"], r["text"]) for r in sorted(drawn, key=lambda r: (r["lang"], r["_n"]))])


ADDED = ("lang_pred", "score", "entropy", "rejected")


def identify(docs: DataFrame, model: Identifier, keep: list[str]) -> DataFrame:
    """The kept columns with lang_pred, score, entropy and rejected for every row's text; kept columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0, as all are if nothing was learned. Ties go to the first
    language by code point. Texts of any length are read whole; equal texts get equal results, and repeated rows repeat. An
    empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    keep = [c for c in keep if c not in ADDED]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 0, 2 << 20):
            found = list(zip(*shared.value.predict(utf8(b.column(0))))) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(f, k) for f, k in zip(found, kinds)]], [*b.schema.names[1:], *ADDED])

    types = dict(docs.dtypes)
    rows = docs.select("text", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)])
    fields = "".join(f"_{i} {types[c]}, " for i, c in enumerate(keep))
    done = rows.mapInArrow(kernel, fields + "lang_pred string, score double, entropy double, rejected boolean")
    return done.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *ADDED)
