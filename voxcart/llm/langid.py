"""Language identification by unigrams of pieces, summed over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary.  The
probability of a word is the sum over all ways to cut it into pieces, which a forward
pass computes; that of a text is the product over its words.  The answer is the
language with the highest probability, its score the share of that language.

Training counts words by language over all training texts, and then repeats
expectation (expected uses of each piece over all segmentations, by a forward and a
backward pass over each distinct word) and maximisation.  Both are Spark jobs over the
table of counted words; the model that goes out to all tasks has ``vocabulary size x
languages`` numbers, whatever the corpus.

A word is a run of letters, in lower case, with the vocabulary's mark of a word's
beginning before it.  Words of up to ``SHORT`` letters are scored many at once; a longer
run, of a script without blanks for instance, goes alone through a pass of the same sums in
logarithms, which looks at a window of the text at a time.

Defined results: a text that is NULL or has no letter is ``und`` with score 0; so is
every text if no training text has a language; equally likely languages go to the
first by name; repeated rows count each time; an empty table gives no rows; further
columns are not looked at.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcart.llm.common import written

UNKNOWN = "und"
MARK = "▁"
# Letters of words that are scored together, and of a window of a longer one.
SHORT = 32
WINDOW = 1 << 16
ROUNDS = 2
# Added to each expected count, and the weight of a letter outside the vocabulary.
SMOOTHING = 0.1
STRANGE = 1e-9
# Words whose scores a task remembers, and words that are scored at once.
KEPT = 500_000
AT_ONCE = 4_000

LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Pieces:
    """The vocabulary's pieces and where they lie in words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        self.size = len(names) + 1  # the last stands for any letter outside
        self.letters = {n for n in names if len(n) == 1}
        self.longest = max(map(len, names))
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()

    def matches(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """``word, start, end, piece`` of every piece in every word, by end and word."""
        word, start, end, piece = [], [], [], []
        for w, text in enumerate(words):
            text = MARK + text
            for last, (i, length) in self.automaton.iter(text):
                word.append(w)
                end.append(last + 1)
                start.append(last + 1 - length)
                piece.append(i)
            if not self.letters.issuperset(text):
                for at, letter in enumerate(text):
                    if letter not in self.letters:
                        word.append(w)
                        end.append(at + 1)
                        start.append(at)
                        piece.append(self.size - 1)
        columns = [np.array(c, dtype=np.int64) for c in (word, start, end, piece)]
        order = np.lexsort((columns[0], columns[2]))
        return tuple(c[order] for c in columns)


    def ends(self, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``end, starts, pieces`` of the pieces in a long text, for each end in order."""
        for low in range(0, len(text), WINDOW):
            yield from self._window(text, low)

    def ends_backwards(self, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The same from the last end to the first."""
        for low in reversed(range(0, len(text), WINDOW)):
            yield from reversed(self._window(text, low))

    def _window(self, text: str, low: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        first = max(0, low - self.longest)
        high = min(len(text), low + WINDOW)
        found: dict[int, tuple[list[int], list[int]]] = {}
        for last, (i, length) in self.automaton.iter(text[first:high]):
            starts, own = found.setdefault(first + last + 1, ([], []))
            starts.append(first + last + 1 - length)
            own.append(i)
        out = []
        for end in range(low + 1, high + 1):
            starts, own = found.get(end, ([], []))
            if text[end - 1] not in self.letters:
                starts, own = [*starts, end - 1], [*own, self.size - 1]
            out.append((end, np.array(starts, dtype=np.int64), np.array(own, dtype=np.int64)))
        return out


@functools.lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _spread(
    reached: np.ndarray, words: np.ndarray, come: np.ndarray, go: np.ndarray, weights: np.ndarray
) -> None:
    """Add to ``reached[word, go]`` what comes from ``reached[word, come]``.

    Rows are sorted by ``go`` in the direction of the pass, and by word within it.
    """
    if not len(go):
        return
    steps = np.flatnonzero(np.diff(go)) + 1
    for low, high in zip([0, *steps], [*steps, len(go)], strict=True):
        own = words[low:high]
        flow = reached[own, come[low:high]] * weights[low:high]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        reached[own[heads], go[low]] += np.add.reduceat(flow, heads, axis=0)


def _forward(count: int, longest: int, found, weights: np.ndarray) -> np.ndarray:
    word, start, end, _ = found
    reached = np.zeros((count, longest + 1, *weights.shape[1:]))
    reached[:, 0] = 1.0
    _spread(reached, word, start, end, weights)
    return reached


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=0)
    return top + np.log(np.exp(terms - top).sum(axis=0))


def long_word_scores(vocabulary: Pieces, word: str, log_model: np.ndarray) -> np.ndarray:
    """Log probability of one long word in each language; only the last places are held."""
    size = vocabulary.longest + 1
    reached = np.zeros((size, log_model.shape[1]))
    for end, starts, own in vocabulary.ends(MARK + word):
        reached[end % size] = _log_sum(reached[starts % size] + log_model[own])
    return reached[(len(word) + 1) % size]


def long_word_uses(vocabulary: Pieces, word: str, log_weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in one long word of one language."""
    text = MARK + word
    reached = np.zeros(len(text) + 1)
    for end, starts, own in vocabulary.ends(text):
        reached[end] = _log_sum(reached[starts] + log_weights[own])
    # What is right of a place follows from what is left of it: the chance that a
    # segmentation has a border there is shared out among the pieces that end there.
    border = np.zeros(len(text) + 1)
    border[-1] = 1.0
    uses = np.zeros(vocabulary.size)
    for end, starts, own in vocabulary.ends_backwards(text):
        shares = border[end] * np.exp(reached[starts] + log_weights[own] - reached[end])
        np.add.at(border, starts, shares)
        np.add.at(uses, own, shares)
    return uses


def word_scores(vocabulary: Pieces, words: list[str], model: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language; ``model`` is pieces x languages."""
    long = [i for i, w in enumerate(words) if len(w) > SHORT]
    if long:
        scores = np.empty((len(words), model.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        if short:
            scores[short] = word_scores(vocabulary, [words[i] for i in short], model)
        log_model = np.log(model)
        for i in long:
            scores[i] = long_word_scores(vocabulary, words[i], log_model)
        return scores
    sizes = np.array([len(w) + 1 for w in words])
    found = vocabulary.matches(words)
    reached = _forward(len(words), sizes.max(), found, model[found[3]])
    return np.log(np.maximum(reached[np.arange(len(words)), sizes], 1e-300))


def expected_uses(
    vocabulary: Pieces, words: list[str], counts: np.ndarray, weights_of: np.ndarray
) -> np.ndarray:
    """Expected uses of each piece in the counted words of one language."""
    long = np.array([len(w) > SHORT for w in words])
    if long.any():
        log_weights = np.log(weights_of)
        uses = sum(
            counts[i] * long_word_uses(vocabulary, words[i], log_weights)
            for i in np.flatnonzero(long)
        )
        short = [words[i] for i in np.flatnonzero(~long)]
        return uses + expected_uses(vocabulary, short, counts[~long], weights_of) if short else uses
    sizes = np.array([len(w) + 1 for w in words])
    found = vocabulary.matches(words)
    word, start, end, piece = found
    weights = weights_of[piece]
    reached = _forward(len(words), sizes.max(), found, weights)
    left = np.zeros_like(reached)
    left[np.arange(len(words)), sizes] = 1.0
    back = np.lexsort((word, -start))
    _spread(left, word[back], end[back], start[back], weights[back])
    total = reached[np.arange(len(words)), sizes]
    uses = reached[word, start] * weights * left[word, end] * (counts / total)[word]
    return np.bincount(piece, weights=uses, minlength=vocabulary.size)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over whole texts; counts of a batch are added up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                counts: dict[str, Counter] = {}
                for lang, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                    counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
                for lang, own in counts.items():
                    yield pa.RecordBatch.from_pydict(
                        {"lang": [lang] * len(own), "word": list(own), "n": list(own.values())}
                    )

    return (
        docs.where("text IS NOT NULL AND lang IS NOT NULL")
        .select("lang", "text")
        .mapInArrow(run, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )


def train(docs: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the probability of each piece in each of them."""
    spark = docs.sparkSession
    counted = written(count_words(docs), "words-by-language")
    names = sorted(r.lang for r in counted.select("lang").distinct().collect())
    size = pieces(path).size
    model = np.full((size, len(names)), 1.0 / size)
    model[-1] = STRANGE
    place = {name: i for i, name in enumerate(names)}
    for _ in range(rounds if names else 0):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared):
            vocabulary = pieces(path)
            uses: dict[str, np.ndarray] = {}
            for batch in batches:
                rows: dict[str, tuple[list[str], list[int]]] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = rows.setdefault(lang, ([], []))
                    own[0].append(word)
                    own[1].append(n)
                for lang, (words, counts) in rows.items():
                    weights = shared.value[:, place[lang]]
                    total = uses.setdefault(lang, np.zeros(size))
                    for at in range(0, len(words), AT_ONCE):
                        part = slice(at, at + AT_ONCE)
                        total += expected_uses(
                            vocabulary, words[part], np.array(counts[part], dtype=float), weights
                        )
            for lang, total in uses.items():
                (used,) = np.nonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(used)), pa.array(used), pa.array(total[used])],
                    ["lang", "piece", "uses"],
                )

        # At most (pieces x languages) rows come back.
        table = (
            counted.mapInArrow(expect, "lang string, piece long, uses double")
            .groupBy("lang", "piece")
            .agg(F.sum("uses").alias("uses"))
            .toArrow()
        )
        uses = np.zeros((size, len(names)))
        columns = [place[lang] for lang in table.column("lang").to_pylist()]
        uses[table.column("piece").to_numpy(), columns] = table.column("uses").to_numpy()
        model = (uses + SMOOTHING) / (uses.sum(axis=0) + SMOOTHING * size)
        model[-1] = STRANGE
        shared.unpersist()
    return names, model


class Scorer:
    """Sums the scores of words, most of which are known from earlier texts."""

    def __init__(self, path: str, names: list[str], model: np.ndarray):
        self.pieces = pieces(path)
        self.names, self.model = names, model
        self.places: dict[str, int] = {}
        self.scores = np.zeros((1024, len(names)))
        self.holds_long = False

    def learn(self, words: list[str]) -> None:
        count = len(self.places)
        if count + len(words) > len(self.scores):
            size = max(count + len(words), min(2 * len(self.scores), KEPT))
            grown = np.zeros((size, len(self.names)))
            grown[:count] = self.scores[:count]
            self.scores = grown
        for at in range(0, len(words), AT_ONCE):
            part = words[at : at + AT_ONCE]
            self.scores[count + at : count + at + len(part)] = word_scores(
                self.pieces, part, self.model
            )
        self.holds_long |= any(len(w) > 8 * SHORT for w in words)
        self.places.update(zip(words, range(count, count + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [words_of(t) if t else [] for t in texts]
        self.learn(sorted(set().union(*found).difference(self.places)))
        names, shares = [], []
        for words in found:
            if not words or not self.names:
                names.append(UNKNOWN)
                shares.append(0.0)
                continue
            total = self.scores[[self.places[w] for w in words]].sum(axis=0)
            best = int(total.argmax())
            names.append(self.names[best])
            shares.append(float(1.0 / np.exp(total - total[best]).sum()))
        if len(self.places) > KEPT or self.holds_long:
            self.places.clear()
            self.holds_long = False
        return names, shares


_SCORERS: dict[str, Scorer] = {}


def _scorer(model_id: str, path: str, shared: Broadcast) -> Scorer:
    """One scorer per worker process; a new model takes the place of the old one."""
    if model_id not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model_id] = Scorer(path, *shared.value)
    return _SCORERS[model_id]


def predict(docs: DataFrame, path: str, names: list[str], model: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score`` of every text."""
    (id_type,) = [f.dataType for f in docs.schema if f.name == "doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((names, model))
    model_id = str(uuid.uuid4())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model_id, path, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                found = scorer.predict(rows.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(found[0]), pa.array(found[1], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type.simpleString()}, lang_pred string, score double"
    )


def identify(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the rows that are not held out."""
    names, model = train(docs.where(~held_out(F.col("doc_id"))), path)
    return predict(docs, path, names, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
