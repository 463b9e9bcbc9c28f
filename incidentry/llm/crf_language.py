"""Language ID by a linear-chain conditional random field over words."""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentry.llm.common import slices, trim_memory, worker_memo
from incidentry.session import pickle_by_value

#: Slots of hashed features, words of a chain, and words whose scores a Python worker remembers.
SLOTS, CHAIN, MEMO_WORDS = 1 << 18, 64, 250_000
#: Documents scored at a time, by characters.
SLICE_CHARS = 1_000_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), in lower case; other numbers and marks separate them."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in ("".join(c if c.isalpha() else " " for c in f).split())]


def features(word: str, lexicon: set[str]) -> list[int]:
    """Slots of a word's features: itself if the lexicon has it, prefixes and suffixes of 1 to 3 letters, and character
    bi- and trigrams with the word's ends marked."""
    marked = f"<{word}>"
    names = [f"^{word[:n]}" for n in (1, 2, 3)] + [f"${word[-n:]}" for n in (1, 2, 3)]
    names += [marked[i:i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    if word in lexicon:
        names.append(f"={word}")
    return [zlib.crc32(x.encode()) % SLOTS for x in names]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages
    moves: np.ndarray  # log transition scores, from x to
    first: np.ndarray
    lexicon: set[str]
    name: str = ""

    def emissions(self, words: list[str]) -> np.ndarray:
        found = [features(w, self.lexicon) for w in words]
        starts = np.cumsum([0] + [len(f) for f in found[:-1]])
        flat = np.fromiter((x for f in found for x in f), np.int64)
        return np.add.reduceat(self.weights[flat], starts, axis=0)


def marginals(scores: np.ndarray, real: np.ndarray, moves: np.ndarray, first: np.ndarray):
    """Forward-backward over many chains at once: posterior of each label at each place (chains x places x labels) and
    of each step's pair of labels summed over chains, the first labels' sum, and the log partition sum. Places that
    are not ``real`` (only at a chain's end) leave the state as it is."""
    n, length, labels = scores.shape
    peak = scores.max(axis=2, keepdims=True)
    local = np.exp(scores - peak)
    step = np.exp(moves - moves.max())
    forward = np.empty_like(local)
    scale = np.ones((n, length))
    state = np.exp(first - first.max()) * local[:, 0]
    for t in range(length):
        if t:
            state = np.where(real[:, t, None], (forward[:, t - 1] @ step) * local[:, t], forward[:, t - 1])
        scale[:, t] = state.sum(axis=1)
        forward[:, t] = state / scale[:, t, None]
    backward = np.ones_like(local)
    pairs = np.zeros((labels, labels))
    for t in range(length - 2, -1, -1):
        ahead = local[:, t + 1] * backward[:, t + 1] / scale[:, t + 1, None]
        backward[:, t] = np.where(real[:, t + 1, None], ahead @ step.T, backward[:, t + 1])
        pairs += (forward[:, t] * real[:, t + 1, None]).T @ ahead * step
    posterior = forward * backward
    posterior /= posterior.sum(axis=2, keepdims=True)
    total = (np.log(scale) + peak[:, :, 0])[real].sum() + real[:, 1:].sum() * moves.max() + n * first.max()
    return posterior, pairs, posterior[:, 0].sum(axis=0), total


def fit(samples: list[tuple[str, str]], rounds: int = 30, rate: float = 0.3, decay: float = 1e-5,
        seed: int = 42) -> Model | None:
    """Train on (language, text) pairs by gradient ascent (Adam) on the chains' conditional likelihood.

    Texts are cut into runs of 8 to 48 words, shuffled and joined to chains, so that the transitions learn how code
    is switched as well as that it mostly is not.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in samples})
    runs, lexicon_counts = [], {}
    for lang, text in sorted(samples):
        words = words_of(text)
        for w in words:
            lexicon_counts[w] = lexicon_counts.get(w, 0) + 1
        at = 0
        while at < len(words):
            size = int(rng.integers(8, 49))
            runs.append((languages.index(lang), words[at:at + size]))
            at += size
    if not runs:
        return None
    runs = [runs[i] for i in rng.permutation(len(runs))]
    lexicon = {w for w, n in lexicon_counts.items() if n > 1}
    number = {w: i for i, w in enumerate(lexicon_counts)}
    labels = np.array([lang for lang, ws in runs for _ in ws])
    words = np.array([number[w] for _, ws in runs for w in ws])
    pad = -len(words) % CHAIN
    real = np.concatenate((np.ones(len(words), bool), np.zeros(pad, bool))).reshape(-1, CHAIN)
    words = np.concatenate((words, np.zeros(pad, np.int64))).reshape(-1, CHAIN)
    labels = np.concatenate((labels, np.zeros(pad, np.int64))).reshape(-1, CHAIN)

    found = [features(w, lexicon) for w in number]
    sizes = np.array([len(f) for f in found])
    flat = np.fromiter((x for f in found for x in f), np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    used, flat = np.unique(flat, return_inverse=True)
    count = len(languages)
    one_hot = np.eye(count)
    parameters = [np.zeros((len(used), count)), np.zeros((count, count)), np.zeros(count)]
    means = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    seen_pairs = np.zeros((count, count))
    both = real[:, 1:]
    np.add.at(seen_pairs, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    seen_first = one_hot[labels[:, 0]].sum(axis=0)
    total_words = real.sum()
    for turn in range(1, rounds + 1):
        by_word = np.add.reduceat(parameters[0][flat], starts, axis=0)
        posterior, pairs, first, _ = marginals(by_word[words], real, parameters[1], parameters[2])
        gap = (one_hot[labels] - posterior)[real]
        word_gap = np.stack([np.bincount(words[real], gap[:, c], len(sizes)) for c in range(count)], axis=1)
        spread = np.repeat(word_gap, sizes, axis=0)
        grads = [np.stack([np.bincount(flat, spread[:, c], len(used)) for c in range(count)], axis=1) / total_words,
                 (seen_pairs - pairs) / total_words, (seen_first - first) / len(words)]
        for p, g, (m, v) in zip(parameters, grads, means, strict=True):
            g -= decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8) * (0.5 if turn > rounds // 2 else 1)
    weights = np.zeros((SLOTS, count), np.float32)
    weights[used] = parameters[0]
    name = hashlib.sha256(weights.tobytes() + repr(languages).encode()).hexdigest()
    return Model(languages, weights, parameters[1], parameters[2], lexicon, name)


def held_out(ident: Column) -> Column:
    """Documents that are not learned from: crc32 of the id as text is 2 modulo 4; so are null ids."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_language: int = 150, longest: int = 20_000) -> Model | None:
    """Fit on a bounded sample: for each language the ``per_language`` documents of the smallest hash of their ids, of
    those not held out, with a text of 1 to ``longest`` characters."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = rows.where(~held_out(F.col("_id")) & F.col("_lang").isNotNull()
                      & F.char_length("_text").between(1, longest))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    picked = [r[0] for r in rows.select("_lang", "_id").withColumn("_n", F.row_number().over(order))
              .where(F.col("_n") <= per_language).select("_id").collect()]
    sample = rows.where(F.col("_id").isin(picked)).select("_lang", "_text").distinct().collect() if picked else []
    return fit([(r[0], r[1]) for r in sample])


class Scorer:
    """Language posteriors of texts, with a memo of word scores that outlasts a task."""

    def __init__(self, model: Model):
        self.model, self.rows, self.table = model, {}, np.zeros((MEMO_WORDS, len(model.languages)))

    @staticmethod
    def of(plain: tuple) -> Scorer:
        """The worker's scorer of the model whose fields are ``plain``."""
        memo = worker_memo("crf")
        if plain[-1] not in memo:
            memo.clear()
            memo[plain[-1]] = Scorer(Model(*plain))
        return memo[plain[-1]]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean posterior of each language over the words of each text, and the number of words."""
        words = [words_of(t) for t in texts]
        every = set().union(*words)
        new = list(every.difference(self.rows))
        if len(self.rows) + len(new) > len(self.table):
            self.rows, new = {}, list(every)
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), self.table.shape[1]))
        if new:
            begin, end = len(self.rows), len(self.rows) + len(new)
            self.table[begin:end] = self.model.emissions(new)
            self.rows.update(zip(new, range(begin, end), strict=True))
        sizes = np.array([len(w) for w in words], np.int64)
        chains = -(-sizes // CHAIN)
        begin = np.concatenate(([0], np.cumsum(chains)[:-1])) * CHAIN
        place = np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        real = np.zeros(int(chains.sum()) * CHAIN, bool)
        real[place] = True
        number = np.zeros(len(real), np.int64)
        row = self.rows.__getitem__
        number[place] = np.fromiter((row(w) for ws in words for w in ws), np.int64, int(sizes.sum()))
        mean = np.zeros((len(texts), len(self.model.languages)))
        if len(real):
            posterior = marginals(self.table[number].reshape(-1, CHAIN, mean.shape[1]), real.reshape(-1, CHAIN),
                                  self.model.moves, self.model.first)[0].reshape(len(real), -1)[place]
            owner = np.repeat(np.arange(len(texts)), sizes)
            for c in range(mean.shape[1]):
                mean[:, c] = np.bincount(owner, posterior[:, c], len(texts)) / np.maximum(sizes, 1)
        return mean, sizes


def label_words(model: Model, text: str) -> list[tuple[str, str]]:
    """(word, language) of each word of a text, by the largest posterior: where code is switched."""
    words = words_of(text)
    out = []
    for a, b in slices(len(words), CHAIN):
        post = marginals(model.emissions(words[a:b])[None], np.ones((1, b - a), bool), model.moves, model.first)[0][0]
        out += [(w, model.languages[i]) for w, i in zip(words[a:b], post.argmax(axis=1), strict=True)]
    return out


def _plain(model: Model) -> tuple:
    """The fields of a model: a broadcast of them can be read where this package is not installed."""
    return (model.languages, model.weights, model.moves, model.first, model.lexicon, model.name)


def _predict(batch_texts, plain: tuple):
    texts = batch_texts.to_pylist()
    languages = plain[0]
    lengths = [len(t or "") for t in texts]
    langs: list[str] = []
    scores: list[float] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + lengths[end] <= SLICE_CHARS):
            size += lengths[end]
            end += 1
        mean, sizes = Scorer.of(plain).scores(texts[at:end])
        best = mean.argmax(axis=1)
        langs += [languages[b] if n else UNDETERMINED for b, n in zip(best, sizes, strict=True)]
        scores += np.where(sizes > 0, np.minimum(mean[np.arange(len(best)), best], 1.0), 0.0).tolist()
        at = end
    return langs, scores


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, lang_pred, score of each row of ``docs``: the language whose posterior, averaged over all
    words of the whole text, is largest, and that average.

    Words are cut into chains of ``CHAIN`` words whose labels are inferred by forward-backward; word scores are kept
    per worker up to ``MEMO_WORDS``. Nothing is shuffled.

    Edge cases: a text that is null or has no letter, and any text when there was nothing to learn from, is ``und``
    with score 0; null ids count as held out; rows repeated with one id are each scored; an empty table gives no
    rows; other columns are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("_text"))
    if model is None:
        return rows.select(F.col("_id").alias(id_col), "held_out", F.lit(UNDETERMINED).alias("lang_pred"),
                           F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))
    kind = rows.schema["_id"].dataType.simpleString()

    def predict(batches):
        for b in batches:
            langs, scores = _predict(b.column(2), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())], ["_id", "held_out", "lang_pred", "score"])
        trim_memory()

    return rows.mapInArrow(predict, f"_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed(
        "_id", id_col)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose text has a language of score ``min_score`` or more, columns unchanged. The low default
    keeps code-switched texts; it rejects those without letters or of no language in particular."""
    if model is None:
        return docs.where(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))
    position = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            langs, scores = _predict(b.column(position), shared.value)
            yield b.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in zip(langs, scores, strict=True)],
                                    pa.bool_()))
        trim_memory()

    return docs.mapInArrow(keep, docs.schema)


def keep_lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has a letter, columns unchanged: what can be told without a model."""
    position = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array([any(map(str.isalpha, x.as_py() or "")) for x in b.column(position)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


pickle_by_value(__name__)
