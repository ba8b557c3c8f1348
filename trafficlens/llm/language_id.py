"""Language ID with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the
sum over all ways to segment it into pieces of the product of their probabilities, found by the forward
algorithm; the probability of a text is the product over its words (runs of letters, lower-cased, with the
vocabulary's word mark in front). The best posterior under equal priors names the language.

Piece probabilities are learned by expectation-maximisation over all words of a sample of labelled rows, about
`FIT_ROWS` for each language, so no language's words depend on how much text the others have. The expectation runs in
tasks, each over its part of the words; the driver gets one row a piece, and divides. The model has at most pieces x
`MAX_LANGUAGES` numbers, however large the corpus.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.util import checkpoint, give_back, given_back, tables_of

MARK = "▁"
#: Labelled rows that the model is fitted on, for each language.
FIT_ROWS = 1000
MAX_LANGUAGES = 64
ROUNDS = 4
UND = "und"
#: A letter that no piece covers counts as one unknown piece of this probability.
UNSEEN = 1e-7
#: Added to each piece's expected count, so that a piece unseen in one language is rare there, not impossible.
PRIOR = 0.05
CACHE_WORDS = 80_000
#: What a lattice holds at once, and the letters of a run that count as one word when the model is fitted.
LETTERS_AT_ONCE = 50_000
STRETCH = 64
TEXTS_AT_ONCE = 1000
COUNTED_WORDS = 150_000
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces without control, byte and unknown pieces, lower-cased, each once, in order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return list(dict.fromkeys(sp.id_to_piece(i).lower() for i in plain))


class Lattice:
    """All places where pieces stand in some words. Forward and backward sums run over all words and languages at once.

    An edge is a piece that begins at one letter of a word and ends at another; a letter that is no piece is an edge by
    itself, of probability UNSEEN. Edges are sorted by the letter they end at, so step j adds up all edges that end at
    letter j of any word. Sums are scaled word by word, so no word is too long for a double."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.n = len(words)
        self.lengths = np.fromiter(map(len, words), np.int64, self.n) + 1
        letters = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(self.n), self.lengths)
        ends = np.cumsum(self.lengths)
        first = np.arange(len(letters))  # where an edge begins; state: the trie's node for what was read from there
        begin, left, state = first - (ends - self.lengths)[word], ends[word] - first, np.zeros(len(letters), np.int64)
        found, step = [], 1
        while len(first):
            state = vocabulary.step(state, letters[first + step - 1])
            piece = np.where(state >= 0, vocabulary.piece[state], -1)
            edge = (piece >= 0) | (step == 1)
            found.append((word[first[edge]], begin[edge], begin[edge] + step, piece[edge]))
            on = (state >= 0) & (left > step)
            first, begin, left, state = first[on], begin[on], left[on], state[on]
            step += 1
        at, start, stop, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
        order = np.argsort(stop * (self.n + 1) + at, kind="stable")
        self.at, self.start, self.stop, self.piece = at[order], start[order], stop[order], piece[order]
        self.steps = np.flatnonzero(np.r_[True, self.stop[1:] != self.stop[:-1]]) if len(order) else np.empty(0, np.int64)
        self.base = np.cumsum(self.lengths + 1) - self.lengths - 1  # a word's sums stand in rows base to base + length

    def _weights(self, probs: np.ndarray) -> np.ndarray:
        return np.where(self.piece[:, None] >= 0, probs[self.piece], UNSEEN)

    def forward(self, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all segmentations up to each letter, and the logarithm of the scale they are in (one a letter)."""
        p = self._weights(probs)
        alpha = np.zeros((int(self.lengths.sum()) + self.n, probs.shape[1]))
        scale = np.zeros(len(alpha))
        alpha[self.base] = 1
        for a, b in zip(self.steps, [*self.steps[1:], len(self.at)]):
            row, own = self.base[self.at[a:b]], np.flatnonzero(np.r_[True, self.at[a + 1 : b] != self.at[a : b - 1]])
            source, target = row + self.start[a:b], row[own] + self.stop[a]
            last = target - 1  # the scale of the letter before; earlier sums are brought to it
            shift = np.exp(scale[source] - np.repeat(scale[last], np.diff(np.r_[own, b - a])))
            total = np.add.reduceat(alpha[source] * shift[:, None] * p[a:b], own)
            top = total.max(axis=1)
            alpha[target], scale[target] = total / top[:, None], scale[last] + np.log(top)
        return alpha, scale

    def log_probs(self, probs: np.ndarray) -> np.ndarray:
        """log P(word) in each language, words x languages."""
        if not self.n:
            return np.zeros((0, probs.shape[1]))
        alpha, scale = self.forward(probs)
        ends = self.base + self.lengths
        return np.log(np.maximum(alpha[ends], 1e-300)) + scale[ends][:, None]

    def expect(self, probs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each counted `weights` (words x languages) times."""
        if not self.n:
            return np.zeros_like(probs)
        alpha, scale = self.forward(probs)
        p = self._weights(probs)
        beta = np.zeros_like(alpha)  # of row r, in the scale of 1 / exp(scale[r]) times that of the whole word
        ends = self.base + self.lengths
        beta[ends] = weights / np.maximum(alpha[ends], 1e-300)
        pieces, values = [], []
        for a, b in reversed(list(zip(self.steps, [*self.steps[1:], len(self.at)]))):
            row = self.base[self.at[a:b]]
            source, target = row + self.start[a:b], row + self.stop[a:b]
            back = beta[target] * p[a:b] * np.exp(scale[source] - scale[target])[:, None]
            beta[source] += back  # of one step's edges, no two of a word begin at one letter
            pieces.append(self.piece[a:b])
            values.append(alpha[source] * back)
        pieces, values = np.concatenate(pieces), np.concatenate(values)
        pieces, values = pieces[pieces >= 0], values[pieces >= 0]
        return np.stack([np.bincount(pieces, v, len(probs)) for v in values.T], axis=1)


class Vocabulary:
    """Pieces by number, and the trie of their letters as a sorted table of (node, letter) with the node that follows."""

    def __init__(self, pieces: list[str]):
        self.index = {p: k for k, p in enumerate(pieces)}
        nodes, follows = [-1], {}
        for p, k in self.index.items():
            at = 0
            for letter in p:
                key = at << 21 | ord(letter)
                if key not in follows:
                    follows[key] = len(nodes)
                    nodes.append(-1)
                at = follows[key]
            nodes[at] = k
        self.piece = np.array(nodes)
        self.keys = np.array(sorted(follows))
        self.next = np.array([follows[k] for k in self.keys.tolist()])

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node after one more letter; -1 where no piece goes on like that."""
        key = state << 21 | letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)


class _Known:
    """log P of the words a worker has met, in two generations: when the young one is full it becomes the old one, and
    words that are still in use come back from there. Lives on from task to task, until another operator comes."""

    def __init__(self, model: tuple[list[str], np.ndarray]):
        self.model, self.vocabulary, self.probs = model, Vocabulary(model[0]), model[1]
        self.at: dict[str, int] = {}
        self.table = np.zeros((2 * CACHE_WORDS, self.probs.shape[1]))
        self.old: dict[str, int] = {}
        self.old_table = self.table[:0]

    def learn(self, words: set[str]) -> None:
        """Make all these words known."""
        if len(self.at) > CACHE_WORDS:
            self.old, self.old_table = self.at, self.table[: len(self.at)].copy()
            self.at = {}
        new = words.difference(self.at)
        back = [w for w in new if w in self.old]
        fresh = list(new.difference(back))
        first = len(self.at)
        while len(self.table) < first + len(new):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for part in parts_of(fresh):
            self.table[first : first + len(part)] = Lattice(self.vocabulary, part).log_probs(self.probs)
            self.at.update(zip(part, range(first, first + len(part))))
            first += len(part)
        self.table[first : first + len(back)] = self.old_table[[self.old[w] for w in back]]
        self.at.update(zip(back, range(first, first + len(back))))


def _known(model: tuple[list[str], np.ndarray]) -> _Known:
    return tables_of("language_id", id(model), lambda: _Known(model))  # which holds the model, so no other has its id


def parts_of(words: list[str]) -> Iterator[list[str]]:
    """The words in lists of about LETTERS_AT_ONCE letters, short ones first, so that a lattice has little to skip."""
    part, size = [], 0
    for w in sorted(words, key=lambda w: (len(w), w)):
        part.append(w)
        size += len(w) + 1
        if size >= LETTERS_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_counts(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(word, n): for each word of the rows (text, lang), how often each language has it, in the order of `langs`.

    Words are counted in each task before the shuffle, in tables of bounded size. A run of more than STRETCH letters
    counts as words of that many."""
    at = {x: k for k, x in enumerate(langs)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, Counter] = defaultdict(Counter)

        def out() -> Iterator[pd.DataFrame]:
            for lang, own in counts.items():
                if own:
                    yield pd.DataFrame({"k": np.full(len(own), lang), "word": list(own), "n": list(own.values())})
            counts.clear()

        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"]):
                words = words_of(text)
                if any(len(w) > STRETCH for w in words):
                    words = [w[i : i + STRETCH] for w in words for i in range(0, len(w), STRETCH)]
                counts[at[lang]].update(words)
                if sum(map(len, counts.values())) > COUNTED_WORDS:
                    yield from out()
        yield from out()

    each = rows.mapInPandas(lambda frames: given_back(run(frames)), "k long, word string, n long").groupBy("word")
    return each.agg(F.array(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)) for k in range(len(langs))]).alias("n"))


def expectation(counts: DataFrame, vocabulary: list[str], probs: np.ndarray) -> np.ndarray:
    """Expected counts (pieces x languages) over all words of a table of counts. Each task adds up its own words' before
    the shuffle; what comes to the driver is one row a piece."""
    shared = counts.sparkSession.sparkContext.broadcast((vocabulary, probs))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, probs = shared.value
        known = Vocabulary(pieces)
        seen = np.zeros_like(probs)
        for frame in frames:
            own = dict(zip(frame["word"], frame["n"]))
            for part in parts_of(list(own)):
                seen += Lattice(known, part).expect(probs, np.array([own[w] for w in part], np.float64))
        k, x = np.nonzero(seen)
        yield pd.DataFrame({"k": k, "x": x, "v": seen[k, x]})

    # Sums of doubles depend on their order, by less than is kept here.
    total = F.sum(F.col("v").cast("decimal(30, 6)")).cast("double")
    rows = counts.mapInPandas(lambda frames: given_back(run(frames)), "k int, x int, v double").groupBy("k", "x").agg(total.alias("v")).toPandas()
    out = np.zeros_like(probs)
    out[rows["k"], rows["x"]] = rows["v"]
    return out


def sample(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], DataFrame]:
    """The languages, and (text, lang) of about FIT_ROWS distinct texts of each: those with the least hashes, or all if
    a language has no more. Of more than MAX_LANGUAGES labels, those with the most rows are learned (of equal ones, the
    first in order). The sample depends on the texts alone, not on how rows lie in partitions."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    labels = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    part = F.lit(None)
    for r in labels:
        part = F.when(F.col("lang") == r["lang"], min(1.0, FIT_ROWS / r["n"])).otherwise(part)
    least = F.xxhash64("text").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return sorted(r["lang"] for r in labels), rows.where(least <= part).distinct()


def fit(docs: DataFrame, pieces: list[str], text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces x languages) from all words of a sample of the rows with a language."""
    langs, rows = sample(docs, text_col, lang_col)
    probs = np.full((len(pieces), len(langs)), 1 / len(pieces))
    if not langs:
        return [], probs
    counts = checkpoint(word_counts(rows, langs))
    for _ in range(ROUNDS):
        seen = PRIOR + expectation(counts, pieces, probs)
        probs = seen / seen.sum(axis=0)
    return langs, probs


def predict(docs: DataFrame, pieces: list[str], langs: list[str], probs: np.ndarray, text_col: str = "text") -> DataFrame:
    """The columns of `docs`, and lang_pred and score: the posterior of the predicted language.

    A text that is null or has no letter gets "und" and score 0; so does every text if no language was learned.
    Columns of those names in the input are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((pieces, probs))  # pieces x at most MAX_LANGUAGES numbers
    names = list(langs)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _known(shared.value)
        for texts in batches:
            out = judged(texts, known)
            del texts  # else it is there beside the next
            yield out
        give_back()

    def judged(texts: pd.Series, known: _Known) -> pd.DataFrame:
        found, scores = [], []
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            some = [words_of(t) if names else [] for t in texts.iloc[start : start + TEXTS_AT_ONCE]]
            known.learn(set(chain.from_iterable(some)))
            for words in some:
                if not words:
                    found.append(UND)
                    scores.append(0.0)
                    continue
                total = known.table[np.fromiter(map(known.at.__getitem__, words), np.int64, len(words))].sum(axis=0)
                odds = np.exp(total - total.max())
                best = int(total.argmax())
                found.append(names[best])
                scores.append(float(odds[best] / odds.sum()))
        return pd.DataFrame({"lang_pred": found, "score": scores})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*kept, judge(F.col(text_col)).alias("__judged"))
    return out.select(*kept, "__judged.lang_pred", "__judged.score")


def held_out(id_col: str = "doc_id"):
    """The rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out and predict for all: the columns of `docs`, held_out, lang_pred, score.

    Columns of those three names in the input are replaced. A null, empty or letterless text gets "und" and score 0; of
    languages with equal posteriors the first in order is predicted. Repeated rows are judged each, and counted each when
    learned from. A row without a language teaches nothing; a row without an id is learned from. Whole texts are read,
    however long. An empty table gives an empty result.
    """
    pieces = load_pieces(vocabulary_path)
    langs, probs = fit(docs.where(F.coalesce(~held_out(id_col), F.lit(True))), pieces, text_col, lang_col)
    return predict(docs.withColumn("held_out", F.coalesce(held_out(id_col), F.lit(False))), pieces, langs, probs, text_col)
