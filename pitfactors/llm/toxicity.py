"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Words that labelled toxic texts use in many different contexts, and clean ones hardly ever,
form a lexicon.  A Levenshtein automaton intersected with the lexicon's trie reads each token
once and yields the term it may be a misspelling of.  Around each hit a window of tokens tells
quotation and report from address; a small logistic model turns the hits into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable
from pitfactors.llm.common import whole

#: Look-alike characters inside words, quotation marks, and words of report and address.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
QUOTES = "\"“”„«»‘’"
REPORT = frozenset("said says saying wrote writes quote quoted quotes called word words term meaning sagte schrieb zitat wort dit écrit cité mot dijo escribió cita palabra".split())
ADDRESS = frozenset("you your you're youre u ur du dein deine ihr euch tu te toi vous ton votre tú ti usted eres".split())
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$*") + QUOTES + "…–—¿¡*"


@dataclass(frozen=True)
class Fit:
    """Bounds and numbers of the fit.

    At most about ``rows`` labelled texts are used, drawn by a hash of the id; they are
    collected into a table of their own, and their ids (a few hundred kilobytes) are broadcast.
    """

    rows: int = 40_000
    share: float = 0.002  # of toxic texts in which a term occurs, in as many contexts
    odds: float = 2.5  # log odds from which a word is a term
    window: int = 6
    short: int = 5  # shorter terms must match exactly
    long: int = 9  # terms this long may have two errors
    ridge: float = 0.05


class LexiconAutomaton:
    """All words within the allowed number of errors of a term, as a lazily built deterministic automaton.

    A state is the set of (trie node, errors) that a prefix can reach; the next state for a
    character is computed once and remembered.
    """

    LIMIT = 100_000  # remembered states; beyond it the automaton starts afresh

    def __init__(self, terms: Iterable[str], short: int, long: int):
        self.terms = sorted(set(terms))
        self._children: list[dict[str, int]] = [{}]
        self._ends: list[int] = [-1]
        self._room: list[int] = [0]  # errors that the most tolerant term below a node allows
        self._allowed = [0 if len(t) < short else 1 if len(t) < long else 2 for t in self.terms]
        for i, term in enumerate(self.terms):
            node = 0
            for c in term:
                self._room[node] = max(self._room[node], self._allowed[i])
                if c not in self._children[node]:
                    self._children[node][c] = len(self._children)
                    self._children.append({})
                    self._ends.append(-1)
                    self._room.append(0)
                node = self._children[node][c]
            self._room[node] = max(self._room[node], self._allowed[i])
            self._ends[node] = i
        self._reset()

    def _reset(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._steps: list[dict[str, int]] = []
        self._answers: list[tuple[int, int] | None] = []
        self._root = self._state({0: 0})

    def _state(self, items: dict[int, int]) -> int:
        todo = list(items)
        while todo:  # errors that leave out a character of the term
            node = todo.pop()
            for child in self._children[node].values():
                e = items[node] + 1
                if e <= self._room[child] and e < items.get(child, 9):
                    items[child] = e
                    todo.append(child)
        key = tuple(sorted(items.items()))
        if not key:
            return -1
        if key not in self._ids:
            self._ids[key] = len(self._states)
            self._states.append(key)
            self._steps.append({})
            ends = [(e, self._ends[n]) for n, e in key if self._ends[n] >= 0 and e <= self._allowed[self._ends[n]]]
            self._answers.append(min(ends) if ends else None)
        return self._ids[key]

    def _next(self, state: int, c: str) -> int:
        items: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self._room[node] and e < items.get(node, 9):
                items[node] = e

        for node, e in self._states[state]:
            for char, child in self._children[node].items():
                put(child, e if char == c else e + 1)
            put(node, e + 1)
        found = self._steps[state][c] = self._state(items)
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, number of the term) of the closest term, or None."""
        if len(self._states) > self.LIMIT:
            self._reset()
        state, steps = self._root, self._steps
        for c in word:
            found = steps[state].get(c)
            state = self._next(state, c) if found is None else found
            if state < 0:
                return None
        return self._answers[state]


def tokens(text: str) -> list[str]:
    return text.lower().split()


def plain(token: str) -> str:
    """A token without punctuation at its ends, look-alikes inside a word replaced by letters."""
    word = token.strip(_EDGE)
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(LOOKALIKES)
    return word


def is_quoted(parts: list[str], i: int, span: int) -> bool:
    """Whether token ``i`` stands in quotation marks or near a word of report."""
    if parts[i][0] in QUOTES or not REPORT.isdisjoint(parts[max(0, i - span) : i + span + 1]):
        return True
    return sum(c in QUOTES for t in parts[max(0, i - span) : i] for c in t) % 2 == 1


def crc_rest(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


@dataclass
class Model:
    """Terms and words seen near a term, each with its toxic and clean texts; prior weight by errors; coefficients."""

    terms: dict[str, tuple[int, int]] = field(default_factory=dict)
    seen: dict[str, tuple[int, int]] = field(default_factory=dict)
    prior: tuple[float, ...] = (0.9, 0.5, 0.3)
    floor: float = 0.2  # weights of misspellings up to this are none
    coef: list[float] = field(default_factory=lambda: [-4.0] + [0.0] * 6)
    mean: list[float] = field(default_factory=lambda: [0.0] * 6)
    scale: list[float] = field(default_factory=lambda: [1.0] * 6)
    fit: Fit = Fit()


class Scorer:
    """Applies a model; remembers the weight of each token."""

    CACHE = 300_000

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.automaton = LexiconAutomaton(model.terms, model.fit.short, model.fit.long)
        self.order = self.automaton.terms

    def weight(self, token: str) -> float:
        """How toxic the token's word is, 0 to 1: the smoothed share of toxic texts among those that have it; 0 far from any term."""
        word = plain(token)
        hit = self.automaton.match(word) if word else None
        if not hit:
            return 0.0
        errors, term = hit
        if errors == 0:
            t, c = self.model.terms[self.order[term]]
            return (t + 0.3) / (t + c + 1.5)
        prior = self.model.prior[errors]
        t, c = self.model.seen.get(word, (0, 0))
        w = (t + 2 * prior) / (t + c + 2)
        return w if w > self.model.floor else 0.0

    def hits(self, text: str) -> tuple[list[str], dict[str, float]]:
        parts = tokens(text)
        known = self.known
        if len(known) > self.CACHE:
            known.clear()
        found = {}
        for token in set(parts):
            w = known.get(token)
            if w is None:
                w = known[token] = self.weight(token)
            if w:
                found[token] = w
        return parts, found

    def features(self, text: str) -> list[float]:
        """Largest and summed weight outside and inside quotation, summed weight of addressed hits, density."""
        parts, found = self.hits(text)
        if not found:
            return [0.0] * 6
        top = [0.0, 0.0]
        total = [0.0, 0.0]
        addressed = 0.0
        span = self.model.fit.window
        for i, token in enumerate(parts):
            w = found.get(token)
            if not w:
                continue
            near = parts[max(0, i - span) : i + span + 1]
            quoted = int(is_quoted(parts, i, span))
            top[quoted] = max(top[quoted], w)
            total[quoted] += w
            if not ADDRESS.isdisjoint(near):
                addressed += w
        sharp = [math.log((t + 0.02) / (1.02 - t)) + 4 for t in top]
        return [sharp[0], math.log1p(total[0]), sharp[1], math.log1p(total[1]), math.log1p(addressed), (total[0] + total[1]) / math.sqrt(len(parts))]

    def score(self, text: str) -> float:
        m = self.model
        z = m.coef[0] + sum(c * (x - a) / s for c, x, a, s in zip(m.coef[1:], self.features(text), m.mean, m.scale))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.diag([1e-6] + [ridge * len(x) ** 0.5] * x.shape[1])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _counted(emit, names: list[str], types: list[pa.DataType]):
    """A task that adds up what ``emit(rows)`` yields, keyed by all but the last two columns."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for key in emit(text):
                    total[key, toxic] += 1
        keys = list(total)
        columns = list(zip(*(k for k, _ in keys))) or [()] * (len(names) - 2)
        n = np.array(list(total.values()), np.int64)
        hot = np.array([bool(t) for _, t in keys], bool)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), pa.array(np.where(hot, n, 0)), pa.array(np.where(hot, 0, n))], names=names)

    return run


def learn(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: bool = True) -> Model:
    """Fit a model on labelled documents, without those whose crc32(id) mod 5 is 0 if ``held_out``.

    A null label or id is no label; several labels of an id count as the largest.  Without
    toxic texts the model has no terms and scores every text alike, close to 0.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out:
        marks = marks.where(crc_rest(F.col("doc_id")) != 0)
    n = marks.count()
    if n > fit.rows:
        marks = marks.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * fit.rows / n))
    # at most about fit.rows ids: under a megabyte
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).join(F.broadcast(marks), "doc_id").select("text", "toxic")
    hot = stable(texts.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("apart")))
    model = _lexicon(hot, fit)
    part = _lexicon(hot.where("not apart"), fit)  # terms chosen without the texts that fit the coefficients
    rows = hot.where("apart").mapInArrow(_features(part), "toxic int, x array<double>").collect() if part.terms else []
    y = np.array([r["toxic"] for r in rows], float)
    if model.terms and 0 < y.sum() < len(y):
        w, mean, scale = _logistic(np.array([r["x"] for r in rows]), y, fit.ridge)
        model.coef, model.mean, model.scale = w.tolist(), mean.tolist(), scale.tolist()
    return model


def _lexicon(hot: DataFrame, fit: Fit) -> Model:
    """Terms and the words near them, counted over all rows of the sample."""
    sizes = {r["toxic"] > 0: r["n"] for r in hot.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    model = Model(fit=fit)
    if not n_toxic:
        return model

    def contexts(text: str):
        words = [plain(t) for t in tokens(text)]
        return {(w, f"{a} {b}") for a, w, b in zip(["", *words], words, [*words[1:], ""]) if len(w) > 2}

    seen = hot.where("toxic = 1").mapInArrow(_counted(contexts, ["word", "around", "t", "c"], [pa.string(), pa.string()]), "word string, around string, t long, c long")
    least = max(2 if n_toxic < 50 else 3, math.ceil(fit.share * n_toxic))
    # each word kept fills a share of all contexts, so their number is bounded by text length / share
    wide = {r["word"]: r["n"] for r in seen.groupBy("word", "around").agg(F.lit(1).alias("one")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    def used(text: str):
        parts = tokens(text)  # a quoted word says nothing about its text
        kinds = set(parts)
        if REPORT.isdisjoint(kinds) and not any(c in text for c in QUOTES):
            return {(w,) for t in kinds if (w := plain(t)) in wide}
        return {(w,) for i, t in enumerate(parts) if (w := plain(t)) in wide and not is_quoted(parts, i, fit.window)}

    words = hot.mapInArrow(_counted(used, ["word", "t", "c"], [pa.string()]), "word string, t long, c long")
    for r in words.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect():
        odds = math.log((r["t"] + 0.5) / (n_toxic + 1)) - math.log((r["c"] + 0.5) / (n_clean + 1))
        if r["t"] >= least and odds >= fit.odds:
            model.terms[r["word"]] = (r["t"], r["c"])
    if not model.terms:
        return model

    def near(scorer: Scorer):
        auto = scorer.automaton
        return lambda text: {(w, h[0]) for t in set(tokens(text)) if (w := plain(t)) and (h := auto.match(w)) and h[0] > 0}

    found = hot.mapInArrow(_counted(near(Scorer(model)), ["word", "errors", "t", "c"], [pa.string(), pa.int32()]), "word string, errors int, t long, c long")
    odd = found.groupBy("word", "errors").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()  # words of the sample near a term
    rate = n_toxic / (n_toxic + n_clean)
    prior = [0.9]
    for errors in (1, 2):  # weight of a misspelling not seen in the sample: how words seen once are labelled
        rare = [r for r in odd if r["errors"] == errors and r["t"] + r["c"] <= 2]
        prior.append((sum(r["t"] for r in rare) + 4 * (0.6, 0.4)[errors - 1]) / (sum(r["t"] + r["c"] for r in rare) + 4))
    model.prior, model.floor = tuple(prior), 2 * rate
    model.seen = {r["word"]: (r["t"], r["c"]) for r in odd}
    return model


def _features(model: Model):
    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            score = [scorer.score(t.as_py()) for t in batch.column("_text")]
            kept = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(score, pa.float64())], names=[*(batch.schema.names[i] for i in kept), "_score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5).

    A null text is scored as an empty one.  Repeated rows and rows without id are scored one
    by one (a null id is not held out); an empty table gives an empty result; other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_text"))
    out = rows.mapInArrow(_scores(model), "doc_id long, _score double")
    held = F.coalesce(crc_rest(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not call toxic."""
    fields = [docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*fields, whole(docs[f"`{text_col}`"]).alias("_text"))
    schema = ", ".join(f"_c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes)) + ", _score double"
    out = rows.mapInArrow(_scores(model), schema).where("_score < 0.5")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
