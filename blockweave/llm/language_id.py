"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the byte n-grams of 1 to 3
bytes, of the lower-cased text, that both have; it is divided by the root of each
text's own count.  The feature space is the n-grams of the landmark texts.  A
Nystroem map takes kernel values against the landmarks to features, and kernel ridge
regression, one language against the rest, is fitted on them.  Scoring a batch is two
matrix products: presence by landmarks, then map by weights.

The model is fitted by the driver on a bounded sample: at most about 1.2 *
``per_language`` + 32 labelled texts of each language and ``max_languages`` languages,
``max_chars`` characters a text at most (longer ones aren't drawn), picked by a hash
of their id.  Whole texts are scored, in one pass without a shuffle; what is sent to
the tasks has a size set by the parameters.

Defined results: a null text or one without a letter is ``und`` with score 0, as are
all texts if there is nothing to learn from.  Equal scores give the language that
sorts first.  Repeated rows each get a result.  An empty table gives an empty result.
``predict`` gives its own columns only, so no column can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import held_out, sample_by_hash

PER_LANGUAGE, MAX_LANGUAGES, MAX_CHARS, LANDMARKS, RIDGE = 150, 200, 20_000, 128, 1e-2
UNDETERMINED = "und"
#: Numbers of n-grams: bytes, then pairs, then triples.
NUMBERS = 256 + (1 << 16) + (1 << 24)


def grams(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the n-grams that begin at each byte, for n from 1 to 3."""
    b = raw.astype(np.uint32)
    yield b
    if len(b) > 1:
        yield (b[:-1] << 8 | b[1:]) + 256
    if len(b) > 2:
        yield (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) + 256 + 65536


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class KernelModel:
    """Landmark presences, the Nystroem map joined with the ridge weights, and the languages."""

    def __init__(self, texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted(set(languages))
        rank: dict[str, int] = {}
        order = []
        for k, lang in enumerate(languages):
            rank[lang] = rank.get(lang, -1) + 1
            order.append((rank[lang], lang, k))
        chosen = [k for *_, k in sorted(order)[:landmarks]]
        numbers = np.unique(np.concatenate([np.concatenate([np.unique(g) for g in grams(self.raw(texts[k]))]) for k in chosen]))
        self.number(numbers)
        self.landmarks = np.zeros((self.size, 0), np.float32)
        marks = self.presence([texts[k] for k in chosen])
        self.landmarks = (marks / np.sqrt(np.maximum(1, marks.sum(axis=1, keepdims=True)))).T.copy()
        values, vectors = np.linalg.eigh(self.kernel([texts[k] for k in chosen]).astype(np.float64))
        good = values > 1e-6 * values.max()
        nystroem = vectors[:, good] / np.sqrt(values[good])
        known = np.concatenate([self.kernel(texts[k : k + 64]) for k in range(0, len(texts), 64)]).astype(np.float64) @ nystroem
        known = np.column_stack([known, np.ones(len(known))])
        target = np.where(np.array(languages)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        # Each language weighs the same, however many of its texts were drawn.
        weight = np.array([1.0 / languages.count(x) for x in languages])[:, None]
        solved = np.linalg.solve(known.T @ (known * weight) + ridge * np.eye(known.shape[1]) / len(self.languages), known.T @ (target * weight))
        self.weights = (nystroem @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    def number(self, grams: np.ndarray) -> None:
        """Feature numbers from 1 on by n-gram; 0 is an n-gram that no landmark has."""
        self.grams, self.size = grams, len(grams)
        self.feature = np.zeros(NUMBERS, np.int32)
        self.feature[grams] = np.arange(1, self.size + 1)

    def __getstate__(self):
        # The table by n-gram is made again where the model is used.
        return {k: v for k, v in self.__dict__.items() if k != "feature"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.number(self.grams)

    @staticmethod
    def raw(text: str) -> np.ndarray:
        return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)

    def presence(self, texts: list[str]) -> np.ndarray:
        """Texts by features: 1 where the text has the n-gram."""
        out = np.zeros((len(texts), self.size + 1), np.float32)
        for row, text in zip(out, texts, strict=True):
            for g in grams(self.raw(text)):
                row[self.feature[g]] = 1
        return out[:, 1:]

    def kernel(self, texts: list[str]) -> np.ndarray:
        x = self.presence(texts)
        return (x @ self.landmarks) / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """One value for each text and language, about 1 for the language's own texts and -1 for others."""
        return self.kernel(texts) @ self.weights + self.bias


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, max_chars: int = MAX_CHARS) -> KernelModel | None:
    """Fit on the rows that aren't held out; None if no labelled text has a letter."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id") & (F.length("text") <= max_chars) & (F.length("text") > 0))
    common = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    if not common:
        return None
    drawn = sample_by_hash(rows.where(F.col("lang").isin(common)), per_language, "lang", id_col="id", text_col="text").collect()
    drawn = sorted((r for r in drawn if has_letter(r["text"])), key=lambda r: (r["lang"], str(r["id"]), r["text"]))
    return KernelModel([r["text"] for r in drawn], [r["lang"] for r in drawn]) if drawn else None


def _predictor(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts = batch.column("text").to_pylist()
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                good = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
                if good:
                    s = model.scores([texts[k] for k in good])
                    for k, best, row in zip(good, s.argmax(axis=1), s, strict=True):
                        lang[k], score[k] = model.languages[best], float(min(1.0, max(0.0, (row[best] + 1) / 2)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: KernelModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_predictor(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
