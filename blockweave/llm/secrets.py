"""Secret scans: fixed patterns, and a linear-chain conditional random field for the rest.

Three kinds of secret have a pattern.  What those patterns find in a bounded sample of
texts teaches a conditional random field to tag tokens as the beginning of a secret,
its inside, or outside, from the token's shape, the words beside it and features of
the whole text.  A line is a sequence; it is decoded by Viterbi.  Spans that the field
finds and no pattern touches are added with kind ``crf``.  Made-up secrets teach it
secrets in general, and made-up addresses, paths, versions, names and short digests what
isn't one.

A token's share in the score of a place doesn't depend on its neighbours, so it is
computed once a token and looked up after that; scores of all places of a batch are
sums of five looked-up rows.  A part of a line is decoded only if some token there could
raise a path with a secret above one without: the bound adds the best transitions to
each token's gain, so what is skipped is outside in the best path.

The driver fits the field on at most about 1.2 * ``sample`` + 32 texts of at most
``max_chars`` characters.  Whole texts are scanned in one pass without a shuffle; what
is sent to the tasks is bounded by the sample.

Defined results: a null text is scanned as empty.  Positions are code points, ends are
exclusive.  Spans of equal start are in the order assign, access, hex, crf.  Repeated
rows each get a result.  An empty table gives an empty result; with nothing to learn
from, only the patterns count.  ``redact`` passes on all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import sample_by_hash

SAMPLE, MAX_CHARS, MAX_WORDS, MAX_LINES, PLANTED = 2500, 20_000, 400, 2500, 600
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[\w+/.\-]+|[^\s\w+/.\-]")
OFFSETS = (-2, -1, 0, 1, 2)
OUT, BEGIN, INSIDE = 0, 1, 2
MASK = "[SECRET]"
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def pattern_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of every pattern match, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        # The run after the letters is as long as it can be, so a shorter one can't hold a longer match.
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy(s: str) -> float:
    return -sum(k / len(s) * log2(k / len(s)) for k in Counter(s).values())


def letters(token: str) -> tuple[str, int, bool]:
    """Case, length class and whether all are hex digits, of a token of letters."""
    n, plain = len(token), token.isascii()
    case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token[1:].islower() else "aA"
    return case if plain else case + "u", min(n, 40) // 5, plain and n >= 8 and not token.strip("abcdef")


def traits(token: str) -> tuple[str, ...]:
    """Shape features of a token."""
    n = len(token)
    if token.isalpha():
        kind, size, only_hex = letters(token)
        return (f"k:{kind}", f"n:{kind}{size}", "hex" if only_hex else "nohex")
    lower, upper, digit = any(map(str.islower, token)), any(map(str.isupper, token)), sum(map(str.isdigit, token))
    kind = "a" * lower + "A" * upper + "9" * bool(digit) + "x" * any(not c.isalnum() for c in token) + "u" * (not token.isascii())
    if n < 8:
        return (f"k:{kind}", f"n:{kind}{n}", token if n == 1 else "short")
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    runs = [len(x) for x in _APART.split(token) if x]
    names = [x for x in _LETTERS.findall(token) if len(x) >= 3]
    spoken = sum(len(x) for x in names if 5 <= 20 * sum(c in "aeiouAEIOU" for c in x) // len(x) <= 13)
    return (
        f"r:{min(max(runs), 40) // 4}", f"q:{min(len(runs), 6)}", f"o:{10 * spoken // n}", f"m:{min(max(map(len, names), default=0), 15) // 3}", f"y:{'/' in token}{'.' in token}{'-' in token}{'+' in token}{'_' in token}", f"z:{_FORM.sub(_form, token)[:12]}",
        *_shape(token, n, kind, turns, lower, upper, digit),
    )


_APART, _LETTERS, _FORM = re.compile(r"[^A-Za-z0-9]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"[a-f]+|[a-z]+|[A-Z]+|[0-9]+")


def _form(m: re.Match) -> str:
    """One sign for a run of letters or digits, another one for a long run."""
    sign = "9" if m[0].isdigit() else "A" if m[0].isupper() else "a"
    return sign if len(m[0]) < 4 else sign * 2


def _shape(token: str, n: int, kind: str, turns: int, lower: bool, upper: bool, digit: int) -> tuple[str, ...]:
    return (f"k:{kind}", f"n:{kind}{min(n, 60) // 5}", "hex" if not token.strip("0123456789abcdef") else "nohex", f"d:{10 * digit // n}", f"e:{int(2 * entropy(token))}", f"t:{min(9, 10 * turns // n)}", f"p:{token[:4]}" if upper and not lower else "p")


def file_traits(text: str) -> tuple[str, ...]:
    """Features of a whole text: marks of code, digits and keywords."""
    n = max(1, len(text))
    low = text.lower()
    return (
        f"f=:{min(5, int(400 * (text.count('=') + text.count('{') + text.count(';')) / n))}",
        f"fk:{any(k in low for k in _KEYWORDS)}",
        f"fl:{min(6, int(log2(n)) // 2)}",
    )


class Field:
    """Weights of features by offset and label, and of transitions."""

    def __init__(self, words: frozenset[str], numbers: dict[tuple, int], weights: np.ndarray, transitions: np.ndarray):
        self.words, self.numbers, self.weights, self.transitions = words, numbers, weights, transitions
        # Differences to staying outside, and the most that one token can gain by transitions.
        t = transitions - transitions[OUT, OUT]
        self.gain_begin = t[:, BEGIN].max() + max(0.0, t[BEGIN, OUT])
        self.gain_inside = max(t[BEGIN, INSIDE], t[INSIDE, INSIDE]) + max(0.0, t[INSIDE, OUT])
        self.slack = float(np.abs(t[t > -1e6]).max()) * 2
        self._fresh()

    def __getstate__(self):
        return self.words, self.numbers, self.weights, self.transitions

    def __setstate__(self, state):
        self.__init__(*state)

    def _fresh(self) -> None:
        self.seen: dict[str, int] = {"": 0}
        self.rows = np.zeros((1024, len(OFFSETS), 3), np.float32)
        self.shared: dict[tuple, int] = {}

    def features(self, token: str) -> tuple[str, ...]:
        word = token.lower()
        return (*traits(token), f"w:{word}" if word in self.words else "w")

    def _row(self, token: str) -> int:
        """The row of a token that wasn't seen lately; tokens of the same features share one."""
        word = token.lower()
        word = word if word in self.words else ""
        key = (*letters(token), word) if token.isalpha() else (traits(token), word)
        k = self.shared.get(key)
        if k is None:
            k = self.shared[key] = len(self.shared) + 1
            if k == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for f in self.features(token):
                for j, off in enumerate(OFFSETS):
                    i = self.numbers.get((off, f))
                    if i is not None:
                        self.rows[k, j] += self.weights[i]
        self.seen[token] = k
        return k

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.seen) > 300_000 or len(self.shared) > 100_000:
            self._fresh()
        get, row = self.seen.get, self._row
        return np.fromiter((k if (k := get(t)) is not None else row(t) for t in tokens), np.int64, len(tokens))

    def file_bias(self, text: str) -> np.ndarray:
        out = np.zeros(3, np.float32)
        for f in file_traits(text):
            i = self.numbers.get((None, f))
            if i is not None:
                out += self.weights[i]
        return out

    def emissions(self, ids: np.ndarray, line: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Scores of each place and label; a neighbour outside the line adds nothing."""
        n = len(ids)
        out = np.repeat(bias[None, :], n, axis=0)
        for j, off in enumerate(OFFSETS):
            a, b = max(0, -off), n - max(0, off)
            if b > a:
                same = line[a:b] == line[a + off : b + off]
                out[a:b] += self.rows[np.where(same, ids[a + off : b + off], 0), j]
        return out

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Labels of the best path between outside tokens on both sides; of equal paths the one that is outside earlier."""
        t = self.transitions
        best, back = t[OUT] + scores[0], np.zeros(scores.shape, np.int64)
        for k in range(1, len(scores)):
            both = best[:, None] + t
            back[k] = both.argmax(axis=0)
            best = both.max(axis=0) + scores[k]
        path = np.zeros(len(scores), np.int64)
        path[-1] = (best + t[:, OUT]).argmax()
        for k in range(len(scores) - 1, 0, -1):
            path[k - 1] = back[k, path[k]]
        return path

    def windows(self, gains: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of a line outside of which the best path is outside: cold tokens are passed as long as all gains of the line could pay for them."""
        hot = np.flatnonzero(gains > 0)
        if not len(hot):
            return
        limit = gains[hot].sum() + self.slack
        loss = np.append(0.0, np.cumsum(np.where(gains > 0, 0.0, -gains)))
        left = right = None
        for h in hot.tolist():
            a = int(np.searchsorted(loss, loss[h] - limit, side="left"))
            b = int(min(len(gains), np.searchsorted(loss, loss[h] + limit, side="right") + 1))
            if right is not None and a > right:
                yield left, right
                left = None
            left = a if left is None else left
            right = b
        yield left, right

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Secrets of a text by the best paths of its lines."""
        lines = text.split("\n")
        tokens = [TOKEN.findall(x) for x in lines]
        flat = [t for x in tokens for t in x]
        if not flat:
            return []
        line = np.repeat(np.arange(len(lines)), [len(x) for x in tokens])
        scores = self.emissions(self.ids(flat), line, self.file_bias(text))
        gains = np.maximum(scores[:, BEGIN] + self.gain_begin, scores[:, INSIDE] + self.gain_inside) - scores[:, OUT]
        out = []
        hot = gains > 0
        if not hot.any():
            return out
        ends = np.cumsum([len(x) for x in tokens])
        starts_of_line = list(accumulate((len(x) + 1 for x in lines), initial=0))
        for n in np.unique(line[hot]).tolist():
            first = int(ends[n] - len(tokens[n]))
            places = None
            for a, b in self.windows(gains[first : ends[n]]):
                path = self.viterbi(scores[first + a : first + b])
                if not path.any():
                    continue
                places = places or [(m.start() + starts_of_line[n], m.end() + starts_of_line[n]) for m in TOKEN.finditer(lines[n])]
                for k, y in enumerate(path.tolist()):
                    if y == BEGIN or (y == INSIDE and (not k or path[k - 1] == OUT)):
                        out.append(list(places[a + k]))
                    elif y == INSIDE:
                        out[-1][1] = places[a + k][1]
        return [tuple(x) for x in out]


#: Alphabets of made-up secrets.
ALPHABETS = tuple(re.sub("a", string.ascii_lowercase, re.sub("A", string.ascii_uppercase, re.sub("9", string.digits, x))) for x in ("aA9", "aA9_-", "aA9+/", "A9", "9ABCDEF", "a9"))


def made_up(turn: random.Random) -> str:
    """A random string of the shapes that secrets have: an alphabet, a length, with or without a prefix, in one or several parts."""
    body = lambda n: "".join(turn.choices(turn.choice(ALPHABETS), k=n))
    prefix = turn.choice(("", "", "a_", "a-", "A", "aa_", "Aa"))
    prefix = "".join(turn.choice(string.ascii_lowercase if c == "a" else string.ascii_uppercase) * 1 if c in "aA" else c for c in prefix.replace("a", "aaa").replace("A", "AAA"))
    if turn.random() < 0.15:
        return prefix + ".".join(body(turn.randrange(12, 50)) for _ in range(3))
    return prefix + body(turn.randrange(16, 60)) + turn.choice(("", "", "", "=", "=="))


def harmless(turn: random.Random) -> str:
    """What looks like a secret and isn't: an address, a path, a version, a name with digits, a short digest, a number of many parts."""
    word = lambda: turn.choice(("", "", "un", "re", "pre")) + "".join(turn.choice("bcdfglmnprstvz") + turn.choice("aeiou") for _ in range(turn.randrange(1, 4))) + turn.choice(("", "n", "r", "s", "t", "ing", "er"))
    some = lambda alphabet, a, b: "".join(turn.choices(alphabet, k=turn.randrange(a, b)))
    hexes, number = "0123456789abcdef", lambda: str(turn.randrange(10 ** turn.randrange(1, 6)))
    words = lambda a, b, by: by.join(word() + (number() if turn.random() < 0.15 else "") for _ in range(turn.randrange(a, b)))
    name = words(1, 4, turn.choice("_-.")) + turn.choice(("", ".py", ".html", ".tar.gz", ".JPG", ".min.js", ".c"))
    case = lambda x: turn.choice((x, x, x.upper()))
    return turn.choice((
        lambda: f"http{turn.choice(('', 's'))}://{words(2, 4, '.')}.{turn.choice(('com', 'org', 'net', 'io'))}/{words(1, 6, '/')}{turn.choice(('', '/' + name, '?' + word() + '=' + number()))}",
        lambda: turn.choice(("/", "./", "~/", "C:/", "")) + words(2, 7, "/") + "/" + name,
        lambda: case("-".join("".join(turn.choices(hexes, k=k)) for k in (8, 4, 4, 4, 12))),
        lambda: turn.choice(("", "v", word() + "-")) + ".".join(number() for _ in range(turn.randrange(2, 5))) + turn.choice(("", "-" + word() + "." + number(), "+" + word() + "." + number(), "rc1", "-SNAPSHOT")),
        lambda: word() + "".join(word().title() for _ in range(turn.randrange(1, 5))) + turn.choice(("", number())),
        lambda: words(2, 6, "_").upper() if turn.random() < 0.4 else words(2, 6, turn.choice("_-.")),
        lambda: case(some(hexes, 7, 17)),
        lambda: turn.choice(("", "sha1-", "etag ")) + some(hexes, 8, 20) + "..." + some(hexes, 4, 8),
        lambda: f"{turn.randrange(1970, 2040)}-{turn.randrange(1, 13):02}-{turn.randrange(1, 29):02}T{turn.randrange(24):02}:{turn.randrange(60):02}:{turn.randrange(60):02}Z",
        lambda: turn.choice(("+", "")) + "-".join(some("0123456789", 2, 6) for _ in range(turn.randrange(2, 6))),
        lambda: word() + number() + "@" + words(1, 3, ".") + ".com",
        lambda: f"data:image/{turn.choice(('png', 'gif', 'jpeg'))};base64," + some(ALPHABETS[2], 40, 200),
    ))()


def varied(line: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The line with made-up secrets in the place of its own, half of them without the keyword before it; spans are (start of the match, start of the secret, end)."""
    turn = random.Random(hashlib.md5(line.encode("utf-8", "surrogatepass")).digest())
    out, found, at = "", [], 0
    for whole, start, end in spans:
        if whole < at:
            continue
        out += line[at : whole if turn.random() < 0.5 else start]
        secret = made_up(turn)
        found.append((len(out), len(out) + len(secret)))
        out, at = out + secret, end
    return out + line[at:], found


def _examples(texts: list[str]) -> list[tuple[list[str], list[int], tuple[str, ...]]]:
    """Lines with a secret, the same with made-up secrets in their place, and others, as tokens, labels and file features; long lines as parts of 120 tokens.

    Made-up secrets, also between the words of lines without any, teach the shape of
    secrets in general in place of the patterns' few.
    """
    good, plain = [], []
    for text in texts:
        spans = sorted((s, e, whole) for whole, _, e, s in pattern_spans(text))
        whole, at = file_traits(text), 0
        for x in text.split("\n"):
            here = [(w - at, s - at, e - at) for s, e, w in spans if at <= w and e <= at + len(x)]
            lines = [(x, [(s, e) for _, s, e in here], whole)]
            if here:
                new, secrets = varied(x, here)
                lines.append((new, secrets, file_traits(text[:at] + new + text[at + len(x) :])))
            at += len(x) + 1
            for line, secrets, about in lines:
                starts = [s for s, _ in secrets]
                found = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(line)]
                for k in range(0, len(found), 120):
                    part, labels = found[k : k + 120], []
                    for _, a, b in part:
                        i = bisect_right(starts, b - 1) - 1
                        inside = i >= 0 and secrets[i][1] > a
                        labels.append(OUT if not inside else BEGIN if a <= secrets[i][0] or not labels or labels[-1] == OUT else INSIDE)
                    (good if any(labels) else plain).append(([t for t, _, _ in part], labels, about))
    order = sorted(plain, key=lambda x: hashlib.md5(" ".join(x[0]).encode("utf-8", "surrogatepass")).digest())
    # Lines with addresses, numbers and the like tell most about what isn't a secret.
    hard = [x for x in order if any(len(t) >= 8 and not t.isalpha() for t in x[0])][:PLANTED]
    order, good = order[: max(PLANTED, min(MAX_LINES, 3 * len(good)))], good[: 2 * MAX_LINES]
    return good + [planted(x) for x in order[: max(PLANTED, len(good))]] + [planted(x, harmless, OUT) for x in order[: max(2 * PLANTED, len(good))]] + order + hard


def planted(example: tuple, made: Callable[[random.Random], str] = made_up, label: int = BEGIN) -> tuple:
    """A line with something made up between two of its tokens, or alone: a secret, or with label ``OUT`` what isn't one."""
    tokens, labels, about = example
    turn = random.Random(hashlib.md5(" ".join(tokens).encode("utf-8", "surrogatepass")).digest())
    thing, k = TOKEN.findall(made(turn)), turn.randrange(len(tokens) + 1)
    new = [label] + [INSIDE if label else OUT] * (len(thing) - 1)
    if turn.random() < 0.2:
        return thing, new, about
    return tokens[:k] + thing + tokens[k:], labels[:k] + new + labels[k:], about


def fit(texts: list[str], epochs: int = 8, rate: float = 0.5, ridge: float = 1e-3) -> Field | None:
    """Maximum likelihood by batches, with steps scaled by past gradients; None if no text has a secret."""
    examples = _examples(texts)
    if not any(any(y) for _, y, _ in examples):
        return None
    around = Counter(tokens[j].lower() for tokens, labels, _ in examples for k, y in enumerate(labels) if y for j in range(max(0, k - 2), min(len(tokens), k + 3)) if not labels[j] and len(tokens[j]) <= 24)
    words = frozenset(w for w, n in around.most_common(MAX_WORDS) if n >= 3)
    blank = Field(words, {}, np.zeros((0, 3), np.float32), np.zeros((3, 3)))
    numbers: dict[tuple, int] = {}
    coded = []
    for tokens, labels, about in examples:
        names = [blank.features(t) for t in tokens]
        rows = [[numbers.setdefault((off, f), len(numbers)) for off in OFFSETS if 0 <= k + off < len(tokens) for f in names[k + off]] + [numbers.setdefault((None, f), len(numbers)) for f in about] for k in range(len(tokens))]
        coded.append((rows, labels))
    coded.sort(key=lambda x: len(x[1]))
    weights, seen = np.zeros((len(numbers), 3)), np.full((len(numbers), 3), 1e-3)
    transitions, seen_t = np.zeros((3, 3)), np.full((3, 3), 1e-3)
    forbidden = np.zeros((3, 3))
    forbidden[OUT, INSIDE] = -1e9
    batches = [coded[k : k + 64] for k in range(0, len(coded), 64)]
    turn = np.random.default_rng(11)
    for _ in range(epochs):
        for b in turn.permutation(len(batches)):
            grad, grad_t = _gradient(batches[b], weights, transitions + forbidden)
            grad -= ridge * weights
            seen += grad**2
            weights += rate * grad / np.sqrt(seen)
            seen_t += grad_t**2
            transitions += rate * grad_t / np.sqrt(seen_t)
    return Field(words, numbers, weights.astype(np.float32), transitions + forbidden)


def _gradient(batch: list, weights: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the batch's log likelihood: features and transitions seen, less what the field expects (forward and backward sums)."""
    longest, n = max(len(y) for _, y in batch), len(batch)
    # In front of and behind a line stands a token outside; behind the end of shorter lines, too.
    scores = np.zeros((n, longest + 1, 3))
    scores[:, :, 1:] = -1e9
    index, place = [], []
    gold = np.zeros((n, longest + 1), np.int64)
    for i, (rows, labels) in enumerate(batch):
        gold[i, : len(labels)] = labels
        for k, r in enumerate(rows):
            scores[i, k] = weights[r].sum(axis=0)
            index += r
            place += [i * (longest + 1) + k] * len(r)
    total = lambda x, axis: np.log(np.exp(x - (m := x.max(axis=axis, keepdims=True))).sum(axis=axis)) + m.squeeze(axis)
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = transitions[OUT] + scores[:, 0]
    for k in range(1, longest + 1):
        ahead[:, k] = total(ahead[:, k - 1, :, None] + transitions, 1) + scores[:, k]
    for k in range(longest - 1, -1, -1):
        behind[:, k] = total(transitions + (behind[:, k + 1] + scores[:, k + 1])[:, None, :], 2)
    whole = total(ahead[:, longest], 1)
    expected = np.exp(ahead + behind - whole[:, None, None])
    seen = np.zeros_like(expected)
    np.put_along_axis(seen, gold[:, :, None], 1, axis=2)
    grad = np.zeros_like(weights)
    np.add.at(grad, index, (seen - expected).reshape(-1, 3)[place])
    lengths = np.array([len(y) for _, y in batch])
    grad_t = np.zeros((3, 3))
    first = lengths > 0
    np.add.at(grad_t, (np.zeros(first.sum(), int), gold[first, 0]), 1)
    grad_t[OUT] -= expected[first, 0].sum(axis=0)
    for k in range(1, longest + 1):
        real = lengths >= k  # the step into the token behind the line counts
        pair = np.exp(ahead[real, k - 1, :, None] + transitions + (scores[real, k] + behind[real, k])[:, None, :] - whole[real, None, None])
        grad_t -= pair.sum(axis=0)
        np.add.at(grad_t, (gold[real, k - 1], gold[real, k]), 1)
    return grad, grad_t


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> Field | None:
    """Fit on a sample picked by a hash of id and text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where((F.length("text") <= max_chars) & F.col("id").isNotNull())
    drawn = sample_by_hash(rows, sample, id_col="id", text_col="text").collect()
    return fit([r["text"] for r in sorted(drawn, key=lambda r: (str(r["id"]), r["text"]))])


def all_spans(text: str | None, field: Field | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the patterns' spans, and of those together with the field's."""
    text = text or ""
    base = [(s, kind, e) for s, kind, e, _ in pattern_spans(text)]
    more = []
    if field:
        for s, e in field.spans(text):
            if not any(a < e and s < b for a, _, b in base):
                more.append((s, 3, e))
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scanner(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            made = [all_spans(t, field) for t in batch.column("text").to_pylist()]
            count = lambda k: pa.array([sum(x[1] == k for x in base) for base, _ in made], pa.int64())  # noqa: B023, E731
            cols = [batch.column("doc_id"), count(0), count(1), count(2), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in made]), pa.array([joined(x) for _, x in made]), pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for _, x in made], spans_type)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return run


def scan(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and digest of the patterns' spans, all spans as text and as an array, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_scanner(shared), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>")


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each group of touching spans as one mark."""
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None, *, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, with the secrets in the text masked, and its length in length_col where one is named."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [masked(t, all_spans(t, model)[1]) for t in batch.column(text_col).to_pylist()]
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols[text_col] = pa.array(texts, batch.schema.field(text_col).type)
            if length_col:
                lengths = [n if t is None else len(t) for t, n in zip(texts, batch.column(length_col).to_pylist(), strict=True)]
                cols[length_col] = pa.array(lengths, batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)
