"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on every document: repetition, vocabulary, symbols,
upper case, exclamations, separators, word length, missing sentence ends, a lexicon of words and word
beginnings learned from the labelled sample, and the human labels where there are any.
Expectation-maximisation over the vote patterns of ALL documents estimates how often each labeller
votes what on good and on bad documents; none is taken as the truth. The posterior of a document's
votes is its label, and on a bounded sample these labels train a logistic scorer over hashed words,
word beginnings and the bins of the heuristics' figures. The scorer judges every whole document.

What is bounded: the sample for the lexicon and the scorer (``SAMPLE`` documents with ``FEATURES``
features together, by hash of the id, labelled ones first), the lexicon (``LEXICON`` entries) and the
scorer (``BUCKETS`` weights). Votes, pattern counts and scores cover all documents and whole texts.

Defined cases: null, empty and blank texts have no words and are rejected with score 0; rows with a
null id are scored like others; repeated labels of one id count once, the worst of them; labels with
a null part are ignored; without labels the heuristics alone decide; a score at the threshold is
kept; an empty table gives an empty result; other columns come through ``keep_good`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Spans, code_points, mix, released, slices, written

SAMPLE, FEATURES = 12_000, 6_000_000
LEXICON = 2_000
BUCKETS = 1 << 20
ROUNDS = 120
KEEP = 0.5
#: A bucket seen in fewer sample documents has no weight; shrinkage of the weights per step.
LEAST_SEEN, SHRINK = 5, 2e-3
#: A lexicon entry occurs in so many toxic sample documents and so many times as often as in clean ones;
#: the lexicon votes bad on documents with so many entries (a word counts with its beginnings).
LEXICON_SEEN, LEXICON_RATIO, LEXICON_HITS = 5, 40.0, 2
#: Labellers by figure: bad at the first bound or above, good at the second or below, else no vote.
HEURISTICS = {
    "repeats": (0.2, 0.05),  # share of words equal to the word before
    "sameness": (0.5, 0.2),  # how much fewer distinct words than a text of that length has
    "symbols": (0.15, 0.06),  # share of characters (no spaces) that are no letter or digit
    "capitals": (0.5, 0.2),  # share of letters that are upper case
    "shouts": (0.2, 0.02),  # exclamation marks per word
    "bars": (0.2, 0.01),  # share of words that are a single symbol
    "word_size": (14.0, 9.0),  # mean characters per word
    "endless": (0.98, 0.5),  # how much fewer sentence ends than one in 12 words
}
LABELLERS = [*HEURISTICS, "lexicon", "person_form", "person_content"]
_BOUNDS = np.array(list(HEURISTICS.values())).T
#: Upper ends of the bins in which a figure becomes a feature.
_BINS = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95, 5, 7, 9, 12, 16])


def _kinds() -> np.ndarray:
    """For every code point: 1 white space, 2 letter or digit, 4 upper case, 8 sentence end, 16 exclamation mark."""
    out = np.zeros(0x110000, np.uint8)
    for bit, test in ((1, str.isspace), (2, str.isalnum), (4, str.isupper)):
        out |= np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000).view(np.uint8) * np.uint8(bit)
    out[[ord(c) for c in ".?!"]] |= 8
    out[ord("!")] |= 16
    return out


_KINDS: list[np.ndarray] = []


def looked_at(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The figures of a text and its features (hash buckets, distinct); None without words."""
    if not text:
        return None
    if not _KINDS:
        _KINDS.append(_kinds())
    codes = code_points(text)
    kinds = _KINDS[0][codes]
    words = Spans(codes, kinds & 1 == 0)
    n = len(words.starts)
    if not n:
        return None
    hashes = words.hashes()
    sizes = words.ends - words.starts
    dense, letters = sizes.sum(), np.count_nonzero(kinds & 2)
    usual = min(1.0, 2.0 / n**0.25)  # longer texts have fewer distinct words each
    found = np.array([
        np.count_nonzero(hashes[1:] == hashes[:-1]) / n,
        max(0.0, 1 - len(np.unique(hashes)) / n / usual),
        (dense - letters) / dense,
        np.count_nonzero(kinds & 4) / max(1, letters),
        np.count_nonzero(kinds & 16) / n,
        np.count_nonzero((sizes == 1) & (kinds[words.starts] & 2 == 0)) / n,
        dense / n,
        max(0.0, 1 - 12 * np.count_nonzero(kinds & 8) / n),
    ])
    low = code_points(text.lower())
    plain = Spans(low, _KINDS[0][low] & 2 > 0)
    bins = np.searchsorted(_BINS, found).astype(np.uint64) + np.arange(len(found), dtype=np.uint64) * np.uint64(64)
    features = np.concatenate([plain.hashes(), plain.hashes(4), plain.hashes(5), mix(bins)])
    return found, np.unique(features >> np.uint64(44)).astype(np.int32)


def votes(found: np.ndarray) -> np.ndarray:
    """1 for bad, -1 for good, 0 for nothing, by the heuristics' bounds; ``found`` has a row per document."""
    return (found >= _BOUNDS[0]).astype(np.int8) - (found <= _BOUNDS[1]).astype(np.int8)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of good for each vote pattern (rows of -1, 0, 1), given how many documents have it,
    and each labeller's estimated chance of voting bad on good and on bad documents.

    A document is good, bad in content, or bad in form in one of several ways; given that, labellers are
    independent and each has its chances of voting good, bad and nothing. For people, who look at some
    documents only, no vote says nothing. Starts from the plain reading of the votes: bad in form by
    the first heuristic that votes so, else bad in content by the lexicon or a person, else good.
    """
    n, k = patterns.shape
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    people = [LABELLERS.index("person_form"), LABELLERS.index("person_content")]
    one_hot[:, people, 1] = 0.0
    bad = patterns > 0
    form = np.concatenate([bad[:, : len(HEURISTICS)], bad[:, people[:1]]], axis=1)
    content = ~form.any(axis=1) & (bad[:, LABELLERS.index("lexicon")] | bad[:, people[1]])
    start = np.where(form.any(axis=1), 2 + form.argmax(axis=1), np.where(content, 1, 0))
    kinds = 2 + form.shape[1]
    share = np.eye(kinds)[start] * 0.98 + 0.02 / kinds
    for _ in range(rounds):
        weight = share * counts[:, None]
        chance = np.einsum("nc,nkv->ckv", weight, one_hot) + 0.1
        chance /= chance.sum(axis=2, keepdims=True)
        logs = np.einsum("nkv,ckv->nc", one_hot, np.log(chance)) + np.log((weight.sum(axis=0) + 0.1) / (counts.sum() + 0.1 * kinds))
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-7:
            break
    good = share[:, 0]
    rates = [(bad * (counts * w)[:, None]).sum(axis=0) / max((counts * w).sum(), 1e-9) for w in (good, 1 - good)]
    return good, np.array(rates)


def train(indptr: np.ndarray, features: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights per bucket and bias of a logistic scorer with L1 shrinkage; labels are chances of good."""
    n = len(labels)
    seen = np.bincount(features, minlength=BUCKETS)
    used = np.flatnonzero(seen >= LEAST_SEEN)
    place = np.full(BUCKETS, len(used))
    place[used] = np.arange(len(used))
    columns, rows = place[features], np.repeat(np.arange(n), np.diff(indptr))
    # either class counts as much as the other
    share = labels.mean().clip(0.01, 0.99)
    weight = labels / share + (1 - labels) / (1 - share)
    w, b = np.zeros(len(used) + 1), 0.0
    gw, gb = np.full(len(used) + 1, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(rows, w[columns], n) + b
        error = weight * (1 / (1 + np.exp(-z.clip(-40, 40))) - labels) / n
        grad = np.bincount(columns, error[rows], len(used) + 1)
        gw += grad * grad
        gb += error.sum() ** 2
        rate = 0.3 / np.sqrt(gw)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SHRINK, 0.0)
        w[-1] = 0.0
        b -= 0.3 * error.sum() / np.sqrt(gb)
    out = np.zeros(BUCKETS)
    out[used] = w[:-1]
    return out, float(b)


@dataclass
class Model:
    """What was fitted: the lexicon (sorted buckets), the scorer, and the labellers' estimated rates."""

    lexicon: np.ndarray
    weights: np.ndarray
    bias: float
    rates: np.ndarray

    def score(self, text: str | None) -> float:
        """The chance that the whole text is good."""
        found = looked_at(text)
        if found is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.weights[found[1]].sum() + self.bias, -60, 60))))


def learned_lexicon(features: list[np.ndarray], toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Buckets that toxic documents of the sample have far more often than clean ones."""
    seen = [np.bincount(np.concatenate([np.empty(0, np.int32), *(features[n] for n in np.flatnonzero(own))]), minlength=BUCKETS) for own in (toxic, clean)]
    ratio = (seen[0] / max(1, toxic.sum())) / ((seen[1] + 1) / max(1, clean.sum() + 1))
    good = np.flatnonzero((seen[0] >= LEXICON_SEEN) & (ratio >= LEXICON_RATIO))
    return np.sort(good[np.lexsort((good, -ratio[good]))][:LEXICON]).astype(np.int32)


def _lexicon_vote(lexicon: np.ndarray, features: np.ndarray) -> int:
    return int(len(lexicon) > 0 and np.isin(features, lexicon, assume_unique=True).sum() >= LEXICON_HITS)


def _people(labels: DataFrame, id_col: str) -> DataFrame:
    """Per id the votes of people: 1 bad, -1 good, in form and in content."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").alias("quality"), F.col("toxic").alias("toxic")).dropna()
    vote = lambda bad: F.max(F.when(bad, 1).otherwise(-1)).cast("int")
    return rows.groupBy("id").agg(vote(F.col("quality") == 0).alias("person_form"), vote(F.col("toxic") == 1).alias("person_content"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model for a collection and the labels of some of its documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    people = written(_people(labels, id_col), "people")

    ids = rows.select("id").where("id IS NOT NULL").distinct().join(people, "id", "left")
    ids = written(ids.orderBy(F.col("person_form").isNull(), F.xxhash64("id")).limit(SAMPLE), "quality-sample")

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [looked_at(t) for t in part.column("text").to_pylist()]
                keep = pa.array([f is not None for f in found], pa.bool_())
                found = [f for f in found if f is not None]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).filter(keep) for c in ("id", "person_form", "person_content")), pa.array([f.tolist() for f, _ in found], pa.list_(pa.float64())), pa.array([h for _, h in found], pa.list_(pa.int32()))],
                    ["id", "person_form", "person_content", "figures", "features"],
                )

    # at most SAMPLE ids: a broadcast of bounded size
    sample = rows.join(F.broadcast(ids), "id").mapInArrow(looked, "id long, person_form int, person_content int, figures array<double>, features array<int>")
    sample = written(sample.dropDuplicates(["id"]), "quality-features")
    sizes = sample.select("id", F.size("features").alias("n")).orderBy(F.col("person_form").isNull(), F.xxhash64("id")).toArrow()
    within = np.cumsum(sizes.column("n").to_numpy()) <= FEATURES
    last = int(within.sum())
    taken = set(sizes.column("id").to_numpy()[:last].tolist())
    got = sample.orderBy("id").toArrow() if last == len(sizes) else sample.where(F.col("id").isin(taken)).orderBy("id").toArrow()

    figures_ = np.array(got.column("figures").to_pylist()).reshape(-1, len(HEURISTICS))
    features = [np.array(x.values) for x in got.column("features")]
    form, content = (np.array([x or 0 for x in got.column(c).to_pylist()], np.int8) for c in ("person_form", "person_content"))
    lexicon = learned_lexicon(features, content > 0, (content < 0) & (form < 0))

    sent = spark.sparkContext.broadcast(lexicon)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    found = looked_at(text)
                    out.append(None if found is None else [*votes(found[0]).tolist(), _lexicon_vote(sent.value, found[1])])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.list_(pa.int32()))], ["id", "votes"])

    every = rows.mapInArrow(voted, "id long, votes array<int>").where("votes IS NOT NULL").join(people, "id", "left")
    pattern = F.concat("votes", F.array(*[F.coalesce(c, F.lit(0)) for c in ("person_form", "person_content")]))
    counts = every.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    if not counts.num_rows or not len(features):
        return Model(lexicon, np.zeros(BUCKETS), 0.0, np.zeros((2, len(LABELLERS))))
    patterns = np.array(counts.column("pattern").to_pylist(), np.int8)
    good, rates = expectation_maximisation(patterns, counts.column("n").to_numpy().astype(float))

    posterior = dict(zip(map(bytes, patterns), good.tolist()))
    own = np.column_stack([votes(figures_), [_lexicon_vote(lexicon, f) for f in features], form, content]).astype(np.int8)
    chances = np.array([posterior.get(bytes(v), 0.5) for v in own])
    weights, bias = train(np.concatenate(([0], np.cumsum([len(f) for f in features]))), np.concatenate(features), chances)
    return Model(lexicon, weights, bias, rates)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (chance of good) and ``keep`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for part in slices(batch, "text"):
                scores = pa.array([sent.value.score(t) for t in part.column("text").to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("id"), scores], ["id", "score"])

    out = rows.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= KEEP).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps; nothing but the fit is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for part in slices(batch, text_col):
                keep = [sent.value.score(t) >= KEEP for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
