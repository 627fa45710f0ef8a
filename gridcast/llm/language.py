"""Language of the words of a text by a linear-chain conditional random field.

Words are scored by affixes, character n-grams and a lexicon, neighbours by learned transitions, and forward-backward
gives every word its marginals. Training sequences splice pieces of texts in different languages, so the transitions
know code-switched text. A chain is cut into blocks whose transfer products are formed side by side and then chained,
which is exact and keeps a very long text as cheap per word as a short one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import held_out, map_keyed, whole

#: Most labelled rows a fit takes, drawn by hash of the id
SAMPLE = 2_000
BUCKETS = 1 << 15
#: Words of a training piece and of a training sequence
PIECE, SEQUENCE = 100, 500
BLOCK = 64
#: Words scored at once, and distinct words a worker remembers
AT_ONCE, REMEMBERED = 200_000, 300_000
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters with their marks; digits, fractions and numerals in circles are no letters."""
    return WORD.findall(text.lower())


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words in a row, and where each word's begin.

    All character 2- and 3-grams with word ends marked, the first and last three letters, and the place in the lexicon.
    """
    marked = np.array([len(w) + 2 for w in words], np.int64)
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), marked)
    stop = np.cumsum(marked)[owner]
    start = stop - marked[owner]
    place = np.arange(len(codes))
    owners, buckets = [], []
    for size in (2, 3, 4):
        ok = place + size <= stop
        if size == 4:  # affixes only
            ok &= (place == start) | (place + size == stop)
        at = place[ok]
        h = np.full(len(at), size, np.uint64)
        for j in range(size):
            h = (h ^ codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        owners.append(owner[at])
        buckets.append((h % np.uint64(BUCKETS)).astype(np.int64))
    known = np.array([lexicon.get(w, -1) for w in words], np.int64)
    owners.append(np.flatnonzero(known >= 0))
    buckets.append(known[known >= 0] + BUCKETS)
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.searchsorted(owners[order], np.arange(len(words)))


@dataclass
class Field:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # (BUCKETS + lexicon) x labels
    moves: np.ndarray  # labels x labels, log scale
    begin: np.ndarray
    seen: dict[str, int] = field(default_factory=dict)
    unary: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "unary": None}

    def scores(self, words: list[str]) -> np.ndarray:
        buckets, at = features(words, self.lexicon)
        return np.add.reduceat(self.weights[buckets], at, axis=0) if len(words) else np.zeros((0, len(self.labels)))

    def rows(self, words: list[str]) -> np.ndarray:
        """exp of the scores of every word, up to a factor per word; distinct words are remembered."""
        at = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        new = list({words[i] for i in missing})
        if new or self.unary is None:
            if len(self.seen) + len(new) > REMEMBERED:
                self.seen, self.unary, new, missing = {}, None, list(set(words)), np.arange(len(words))
            raw = self.scores(new)
            rows = np.exp(raw - raw.max(axis=1, keepdims=True)) if len(new) else raw
            self.unary = rows if self.unary is None else np.concatenate([self.unary, rows])
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
            at[missing] = [self.seen[words[i]] for i in missing]
        return self.unary[at]


def marginals(psi: np.ndarray, lengths: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Word marginals of several chains laid end to end. ``psi`` holds word potentials; ``lengths`` are above zero."""
    alpha, beta = messages(psi, lengths, moves, begin)
    out = alpha * beta
    return out / out.sum(axis=1, keepdims=True)


def pair_marginals(psi: np.ndarray, alpha: np.ndarray, beta: np.ndarray, moves: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Marginals of (label before, label at) for the words ``here``, none of which begins a chain."""
    pair = alpha[here - 1][:, :, None] * np.exp(moves - moves.max())[None] * (psi[here] * beta[here])[:, None, :]
    return pair / pair.sum(axis=(1, 2), keepdims=True)


def messages(psi: np.ndarray, lengths: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of every word, each up to a factor per word."""
    n_labels = psi.shape[1]
    m = np.exp(moves - moves.max())
    counts = -(-lengths // BLOCK)
    first = np.cumsum(counts) - counts  # first block of every chain
    nb = int(counts.sum())
    chain = np.repeat(np.arange(len(lengths)), counts)
    rank = np.arange(nb) - first[chain]
    base = (np.cumsum(lengths) - lengths)[chain] + rank * BLOCK
    size = np.minimum(BLOCK, lengths[chain] - rank * BLOCK)
    deep = int(size.max())
    at = base[:, None] + np.minimum(np.arange(deep)[None, :], size[:, None] - 1)
    live = np.arange(deep)[None, :] < size[:, None]
    p = psi[at]  # blocks x deep x labels
    opens = rank == 0
    start = np.exp(begin - begin.max())

    def into(x: np.ndarray, t: int) -> np.ndarray:
        """Carry row vectors over the edge before word t of their block."""
        y = x @ m
        if t == 0:
            y[opens] = x[opens]  # a chain's first word has no edge before it
        return y

    product = np.broadcast_to(np.eye(n_labels), (nb, n_labels, n_labels)).copy()
    for t in range(deep):
        on = live[:, t, None, None]
        product = np.where(on, into(product, t) * p[:, t, None, :], product)
        product /= product.max(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((nb, n_labels)), np.ones((nb, n_labels))
    enter[first] = start
    for k in range(1, int(counts.max())):
        c = first[counts > k] + k
        v = np.einsum("bi,bij->bj", enter[c - 1], product[c - 1])
        enter[c] = v / v.max(axis=1, keepdims=True)
    for k in range(int(counts.max()) - 1, 0, -1):
        c = first[counts > k] + k
        v = np.einsum("bij,bj->bi", product[c], leave[c])
        leave[c - 1] = v / v.max(axis=1, keepdims=True)
    alpha, now = np.empty_like(p), enter
    for t in range(deep):
        now = np.where(live[:, t, None], into(now, t) * p[:, t], now)
        now = now / now.max(axis=1, keepdims=True)
        alpha[:, t] = now
    now, beta = leave, np.empty_like(p)
    for t in range(deep - 1, -1, -1):
        beta[:, t] = now
        if t:
            back = (now * p[:, t]) @ m.T
            now = np.where(live[:, t, None], back / back.max(axis=1, keepdims=True), now)
    return alpha[live], beta[live]


def train(texts: list[str], labels: list[str], epochs: int = 3, rate: float = 0.3, seed: int = 11) -> Field:
    """Fit by stochastic gradient (one step per 8 spliced sequences) on words that carry their text's label."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    pieces, counts = [], Counter()
    for text, label in zip(texts, labels):
        words = words_of(text)
        counts.update(set(words))
        pieces += [(words[i : i + PIECE], names.index(label)) for i in range(0, len(words), PIECE)]
    lexicon = {w: i for i, w in enumerate(sorted(w for w, c in counts.items() if c >= 5))}
    k = max(1, len(names))
    model = Field(names, lexicon, np.zeros((BUCKETS + len(lexicon), k)), np.zeros((k, k)), np.zeros(k))
    squares = [np.full_like(x, 1e-2) for x in (model.weights, model.moves, model.begin)]
    for _ in range(epochs if len(names) > 1 else 0):
        order, sequences, held = rng.permutation(len(pieces)), [], []
        for i in order:
            held.append(pieces[i])
            if sum(len(w) for w, _ in held) >= SEQUENCE:
                sequences.append(held)
                held = []
        sequences += [held] if held else []
        for at in range(0, len(sequences), 8):
            group = [s for s in sequences[at : at + 8] if any(w for w, _ in s)]
            words = [w for s in group for piece, _ in s for w in piece]
            y = np.array([l for s in group for piece, l in s for _ in piece], np.int64)
            lengths = np.array([sum(len(p) for p, _ in s) for s in group], np.int64)
            if not len(words):
                continue
            distinct = list(dict.fromkeys(words))
            place = {w: i for i, w in enumerate(distinct)}
            ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            buckets, starts = features(distinct, lexicon)
            raw = np.add.reduceat(model.weights[buckets], starts, axis=0)
            psi = np.exp(raw - raw.max(axis=1, keepdims=True))[ids]
            alpha, beta = messages(psi, lengths, model.moves, model.begin)
            error = alpha * beta
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(y)), y] -= 1
            per_word = np.stack([np.bincount(ids, error[:, j], len(distinct)) for j in range(k)], axis=1)
            spread = np.repeat(per_word, np.diff(np.append(starts, len(buckets))), axis=0)
            g_weights = np.stack([np.bincount(buckets, spread[:, j], len(model.weights)) for j in range(k)], axis=1)
            inner = np.ones(len(y), bool)
            inner[np.cumsum(lengths) - lengths] = False
            here = np.flatnonzero(inner)
            g_moves = pair_marginals(psi, alpha, beta, model.moves, here).sum(axis=0) - np.bincount(y[here - 1] * k + y[here], minlength=k * k).reshape(k, k)
            g_begin = error[~inner].sum(axis=0)
            for value, grad, square in zip((model.weights, model.moves, model.begin), (g_weights, g_moves, g_begin), squares):
                grad = grad / len(group)
                square += grad * grad
                value -= rate * grad / np.sqrt(square)
    return model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Field:
    """Train on at most ``sample`` rows with a label, outside the held-out fold; only these come to the driver.

    The sample is the least hashes of the ids, so it does not depend on row order; rows that repeat a drawn id are drawn
    with it as long as the sample has room.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    ids = rows.select(F.col(key).alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # The sample is bounded by its parameter, so it may be sent to every task that reads documents.
    drawn = rows.select(F.col(key).alias("id"), F.col(text).alias("t"), F.col(label).alias("l")).join(F.broadcast(ids.distinct()), "id")
    found = drawn.orderBy(F.xxhash64("id"), "id", "l", "t").limit(sample).collect()
    found = sorted((r["id"], r["l"], r["t"]) for r in found if r["id"] is not None)
    return train([t for _, _, t in found], [l for _, l, _ in found])


def label_words(model: Field, texts: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of every text with their marginals (words x labels), a bounded number of words at once."""
    held: list[list[str]] = []
    waiting = 0

    def flush() -> Iterator[tuple[list[str], np.ndarray]]:
        flat = [w for words in held for w in words]
        lengths = np.array([len(words) for words in held], np.int64)
        real = lengths > 0
        if flat:
            found = marginals(model.rows(flat), lengths[real], model.moves, model.begin)
        else:
            found = np.zeros((0, len(model.labels)))
        for words, part in zip(held, np.split(found, np.cumsum(lengths)[:-1])):
            yield words, part

    for text in texts:
        held.append(words_of(text))
        waiting += len(held[-1])
        if waiting >= AT_ONCE:
            yield from flush()
            held, waiting = [], 0
    if held:
        yield from flush()


def predict(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of every row: the label of the largest mean marginal over all words, and that mean.

    ``und`` with score 0 if the text is missing or has no letters, or if nothing was learned. Only the text is looked at;
    repeated rows agree, ties go to the label that sorts first, and an empty table gives an empty result.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        langs, scores = [], []
        for words, part in label_words(model, batch["t"]):
            if not words or not model.labels:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            mean = part.mean(axis=0)
            best = int(mean.argmax())
            langs.append(model.labels[best])
            scores.append(min(1.0, float(mean[best])))
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": np.array(scores, np.float64)})

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("t"))
    return map_keyed(rows, run, "lang_pred string, score double").select(F.col("id").alias(key), "lang_pred", "score")
