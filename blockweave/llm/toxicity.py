"""Toxicity scores from a lexicon that is matched with misspellings.

The lexicon is learned: words that labelled toxic documents have far more often than
others.  It is held as a trie, and the Levenshtein automaton of a word runs through
the trie together with it; the product is made deterministic as it is used, so that a
word costs one step a letter and most leave the lexicon after a few.  Terms of
three letters are matched exactly, those of four to eight allow one edit, longer ones two;
words of several documents that aren't toxic aren't misspellings of a term of four.

Each match is weighed by what stands around it: quotation marks that enclose it and
words of reporting or mentioning within ``AROUND`` words lower the weight, address of
a person raises it.  A misspelling counts as far as misspellings of its term told
toxic documents from others in the sample.  Sums of these weights, with the share of toxic words, feed a
logistic regression that is fitted on the same sample.

The driver fits both on a bounded sample: at most about 1.2 * ``per_class`` + 32
labelled rows of each class that aren't held out, of ``max_chars`` characters at most.
Whole texts are scored, each text once; what is sent to the tasks is bounded by
``max_terms``.

Defined results: a null or empty text has no matches and gets the score of a text
without any.  With nothing to learn from, each score is 0.  Repeated rows each get a
result.  Several labels of one id count as toxic if one is; of several texts of one id
the smallest teaches.  ``score`` gives its own
columns only, so no column can clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import held_out, sample_by_hash

PER_CLASS, MAX_CHARS, MAX_TERMS, THRESHOLD = 1500, 20_000, 2000, 0.3
AROUND = 6
#: Longer words aren't remembered, so that what is remembered is bounded in bytes too.
LONGEST = 64
WORD = re.compile(r"[^\W_]+")
# Words that report or mention, words that address, and quotation marks.
REPORTING = frozenset("said says say called calls call quote quoted quotes wrote writes term word words phrase slur insult insults dit dite disait mot terme insulte sagte sagt nannte wort begriff zitat dijo dice llamó palabra término insulto".split())
ADDRESS = frozenset("you your you're youre ya u tu toi vous du dich dir ihr sie usted ustedes eres".split())
OPENING, CLOSING, EITHER = "«„“‹", "»”›", "\"'"


class LexiconAutomaton:
    """Distance of a word to the nearest lexicon term, with the edits that the term's length allows."""

    def __init__(self, terms: dict[str, float], memory: int = 200_000, trust: dict[str, float] | None = None, plain: frozenset[str] = frozenset()):
        self.weights, self.trust = dict(terms), trust or {}
        self.memory, self.plain = memory, plain
        self._fresh()
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]
        for t in sorted(terms):
            node, limit = 0, self.edits(t)
            self.most[0] = max(self.most[0], limit)
            for c in t:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], limit)
            self.term[node] = t

    def __getstate__(self):
        return self.weights, self.memory, self.trust, self.plain

    def __setstate__(self, state):
        self.__init__(*state)

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 4 else 1 if len(term) < 9 else 2

    def _fresh(self) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.states: list[dict[int, int] | None] = [None]
        self.number: dict[frozenset, int] = {}
        self.ends: list[list[tuple[int, str]]] = [[]]
        self.found: dict[str, tuple[str, int] | None] = {}

    def _state(self, places: dict[int, int]) -> int:
        """The number of a set of (trie node, edits so far), after letters of terms that the word leaves out."""
        todo = list(places.items())
        while todo:
            node, e = todo.pop()
            if places.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e < self.most[child] and places.get(child, 99) > e + 1:
                    places[child] = e + 1
                    todo.append((child, e + 1))
        if not places:
            return -1
        key = frozenset(places.items())
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(places)
            self.steps.append({})
            self.ends.append(sorted((e, self.term[n]) for n, e in places.items() if self.term[n] is not None and e <= self.edits(self.term[n])))
        return number

    def _step(self, state: int, c: str) -> int:
        places: dict[int, int] = {}
        for node, e in self.states[state].items():
            if e < self.most[node]:  # a letter too many
                places[node] = min(places.get(node, 99), e + 1)
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and places.get(child, 99) > cost:
                    places[child] = cost
        return self._state(places)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, the first of equals; None if no term is near enough."""
        if word in self.found:
            return self.found[word]
        if len(self.found) > self.memory or len(self.states) > self.memory:
            self._fresh()
        state = self.number.get("start")
        if state is None:
            state = self.number["start"] = self._state({0: 0})
        for c in word:
            steps = self.steps[state]
            state = steps.get(c) or steps.setdefault(c, self._step(state, c))
            if state < 0:
                break
        ends = self.ends[state] if state > 0 else []
        hit = next(((t, e) for e, t in ends if not (e and len(t) < 5 and word in self.plain)), None)
        if len(word) <= LONGEST:
            self.found[word] = hit
        return hit


def learn_lexicon(texts: list[str], toxic: list[int], max_terms: int = MAX_TERMS, least: int = 3) -> dict[str, float]:
    """Words of at least ``least`` toxic documents whose smoothed log odds are 2.5 or more, and those odds."""
    inside, outside = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        (inside if y else outside).update(set(WORD.findall(t.lower())))
    n, m = sum(toxic), len(toxic) - sum(toxic)
    odds = {w: log((k + 0.5) / (n + 1)) - log((outside[w] + 0.5) / (m + 1)) for w, k in inside.items() if k >= least and len(w) > 2}
    strong = sorted(((o, inside[w], w) for w, o in odds.items() if o >= 2.5 and inside[w] > 4 * outside[w] * n / max(1, m)), reverse=True)
    return {w: o for o, _, w in strong[:max_terms]}


def with_trust(lexicon: LexiconAutomaton, texts: list[str], toxic: list[int]) -> LexiconAutomaton:
    """The lexicon with a weight from 0 to 1 for misspellings of each term: the odds of its near matches against its own."""
    known = Counter(w for t, y in zip(texts, toxic, strict=True) if not y for w in set(WORD.findall(t.lower())) if 3 <= len(w) <= 5)
    plain = frozenset(w for w, k in known.items() if k >= 3)
    lexicon = LexiconAutomaton(lexicon.weights, lexicon.memory, plain=plain)
    inside, outside = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        hits = (lexicon.match(w) for w in set(WORD.findall(t.lower())))
        (inside if y else outside).update({m[0] for m in hits if m and m[1]})
    n, m = sum(toxic), len(toxic) - sum(toxic)
    near = {t: log((inside[t] + 0.5) / (n + 1)) - log((outside[t] + 0.5) / (m + 1)) for t in inside | outside}
    return LexiconAutomaton(lexicon.weights, lexicon.memory, {t: max(0.0, min(1.0, o / lexicon.weights[t])) for t, o in near.items()}, plain)


def context_weight(text: str, words: list[str], spans: list[tuple[int, int]], k: int) -> float:
    """1 for plain use, less for a quoted or reported term, more next to an address."""
    a, b = spans[k]
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    quoted = bool(before and after) and (before in OPENING and after in CLOSING + "“" or before in EITHER and after in EITHER)
    if not quoted:
        left, right = text[max(0, a - 200) : a], text[b : b + 200]
        opened = max(left.rfind(c) for c in OPENING)
        quoted = opened >= 0 and not any(c in left[opened + 1 :] for c in CLOSING) and any(c in right for c in CLOSING)
        quoted = quoted or (left.rsplit("\n", 1)[-1].count('"') % 2 == 1 and '"' in right.split("\n", 1)[0])
    near = words[max(0, k - AROUND) : k] + words[k + 1 : k + 1 + AROUND]
    reported = any(w in REPORTING for w in near)
    weight = 0.15 if quoted and reported else 0.35 if quoted else 0.8 if reported else 1.0
    return weight * (1.25 if any(w in ADDRESS for w in near) else 1.0)


def features(text: str | None, lexicon: LexiconAutomaton) -> list[float]:
    """Weighted exact matches, weighted near matches, best odds, matches a hundred words, share in quotation."""
    text = (text or "").lower()
    words = WORD.findall(text)
    hits = [(k, m) for k, w in enumerate(words) if (m := lexicon.match(w))]
    if not hits:
        return [0.0] * 5
    spans = [m.span() for m in WORD.finditer(text)]
    exact = near = best = weight_sum = 0.0
    for k, (term, distance) in hits:
        w = context_weight(text, words, spans, k)
        weight_sum += min(1.0, w)
        odds = lexicon.weights[term] * w
        if distance:
            w *= lexicon.trust.get(term, 0.7)
            odds = lexicon.weights[term] * w
            near += w
        else:
            exact += w
        best = max(best, odds)
    return [log(1 + exact), log(1 + near), best, min(5.0, 100 * weight_sum / len(words)), 1 - weight_sum / len(hits)]


class ToxicityModel:
    def __init__(self, texts: list[str], toxic: list[int], max_terms: int = MAX_TERMS):
        # Odds from one half, weights of the regression from the other and back: a word isn't judged by the documents that gave it.
        half = [k % 2 for k in range(len(texts))]
        pick = lambda h: ([t for t, x in zip(texts, half, strict=True) if x == h], [y for y, x in zip(toxic, half, strict=True) if x == h])
        x, y = [], []
        for h in (0, 1):
            lexicon = with_trust(LexiconAutomaton(learn_lexicon(*pick(h), max_terms)), *pick(h))
            rest, labels = pick(1 - h)
            x += [features(t, lexicon) for t in rest]
            y += labels
        self.lexicon = with_trust(LexiconAutomaton(learn_lexicon(texts, toxic, max_terms)), texts, toxic)
        self.weights = fit_logistic(np.array(x), np.array(y, float))

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], features(text, self.lexicon), strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and weights by Newton's method; matches never lower a score."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    free = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + penalty @ w
            hess = (x * (p * (1 - p))[:, None]).T @ x + penalty
            step = np.zeros_like(w)
            step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        bad = free & (w < 0)
        bad[[0, len(w) - 1]] = False  # quotation may lower it
        if not bad.any():
            return w
        free &= ~bad


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, max_terms: int = MAX_TERMS) -> ToxicityModel | None:
    """Fit on labelled rows that aren't held out; None without rows of both classes.

    The classes are drawn alike; the intercept is shifted to their shares in the whole, so that the score is a probability.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    # A few thousand ids at most, by the bound of the sample.
    drawn = F.broadcast(sample_by_hash(known, per_class, "y", id_col="id"))
    rows = texts.where((F.length("text") <= max_chars) & F.col("text").isNotNull()).join(drawn, "id").groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["text"]))
    y = [r["y"] for r in rows]
    if len(set(y)) < 2:
        return None
    model = ToxicityModel([r["text"] for r in rows], y, max_terms)
    share, whole = sum(y) / len(y), counts[1] / (counts[0] + counts[1])
    model.weights[0] += log(whole / (1 - whole)) - log(share / (1 - share))
    return model


def _scorer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t) if model else 0.0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: ToxicityModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_scorer(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
