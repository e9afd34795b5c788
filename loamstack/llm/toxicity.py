"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

Voters. Lexicon voters fire on a whole word, pattern voters on words with a given beginning or end; in runs of over ``LONG`` letters
(scripts without spaces, joined words) they also fire on what lies anywhere inside. A short built-in lexicon is joined by terms mined
from the labelled sample: terms that occur in enough toxic texts and far more often there than in clean ones. A last voter fires
where no other does.

Label model. A latent class per text, whether a human has labelled it or not; each voter has rates of firing per class, and hangs
on at most one other voter: the rates are kept for either state of that voter, and the tree of greatest conditional mutual
information says which one it is. A voter that only repeats another one then adds nothing. The human label is one more voter, with
an error rate of its own, that is silent on most texts. Fitted by EM on labelled and unlabelled texts; its posteriors are the
training labels of both.

Classifier. Ridge logistic regression on what fires, how many distinct words fire and their share of all distinct words.

The sample is bounded and documented: at most ``positives`` toxic and ``negatives`` clean labels and ``unlabelled`` texts, in hash
order. Labels weigh by the share of their class that was drawn, so the classes keep their natural ratio at every size. Scoring reads
every text whole; a text's id, language, source and labels are no inputs.

Defined results. Null or empty text is scored as a text where nothing fires. Without labels, or with one class only, the score is
the (smoothed) share of toxic labels. Labels other than 0 and 1, and null ones, are left out; repeated labels of an id count once,
contradicting ones each. Of texts that share a labelled id the one of least hash stands for it. An empty table gives an empty
result. Extra columns pass through ``score``, which refuses a table that has a column of its result's name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fold_bucket, free_name, in_batches, key_sample, low_hash, require, written

_WORD = re.compile(r"[^\W\d_]+")
#: Runs of more letters are also read by what lies inside.
LONG = 32
#: Mild words that open the lexicon, so that a small sample is no cold start.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")
_SPANS, _INSIDE = (4, 5, 6), (2, 3, 4)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def terms_of(word: str) -> Iterator[str]:
    """The terms a word can fire: itself, and its beginnings and ends; of a long run its beginnings, ends and insides."""
    if len(word) <= LONG:
        yield f"={word}"
    for n in _SPANS:
        if len(word) >= n:
            yield f"^{word[:n]}"
            yield f"${word[-n:]}"
    if len(word) > LONG:
        for n in _INSIDE:
            for i in range(len(word) - n + 1):
                yield f"~{word[i : i + n]}"


@dataclass
class Voters:
    """Terms by number; remembers, for as many words as fit, which voters a word fires."""

    terms: list[str]
    memory: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.number = {t: i for i, t in enumerate(self.terms)}

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "number": self.number, "memory": {}}

    def of(self, word: str) -> tuple[int, ...]:
        if len(word) > LONG:
            return tuple({self.number[t] for t in terms_of(word) if t in self.number})
        got = self.memory.get(word)
        if got is None:
            if len(self.memory) >= 300_000:
                self.memory.clear()
            got = self.memory[word] = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        return got

    def votes(self, text: str | None) -> tuple[set[int], int, int]:
        """(voters that fire, distinct words that fire any, distinct words)."""
        words, fired, hits = words_of(text), set(), 0
        for got in map(self.of, words):
            if got:
                hits += 1
                fired.update(got)
        return fired, hits, len(words)


def wider(term: str) -> list[str]:
    """The terms that fire wherever this one does: shorter beginnings, ends and insides."""
    kind, text = term[0], term[1:]
    if kind == "~":
        return [f"~{text[i : i + n]}" for n in _INSIDE if n < len(text) for i in range(len(text) - n + 1)]
    out = [f"^{text[:n]}" for n in _SPANS if kind in "=^" and (len(text) > n or kind == "=" and len(text) == n)]
    return out + [f"${text[-n:]}" for n in _SPANS if kind in "=$" and (len(text) > n or kind == "=" and len(text) == n)]


def mined(counts: list[tuple[str, int, int]], positives: int, negatives: int, *, most: int, least: int, lift: float) -> list[str]:
    """The voters worth having: strong terms, too strong for chance among so many tried; of terms that say the same the narrowest (a
    word before its beginning, lest other words fire), and no narrow term whose wider one is a voter (a stem before its words)."""
    good, share, bar = {}, positives / (positives + negatives), np.log(max(1, len(counts)))
    for term, p, n in counts:
        rate1, rate0 = (p + 0.5) / (positives + 1), (n + 0.5) / (negatives + 1)
        # were the term blind to the class, so many of its texts would be toxic with a chance of exp(-evidence) at most
        evidence = p * np.log(p / (p + n) / share) + (n * np.log(n / (p + n) / (1 - share)) if n else 0) if p else 0
        if p >= least and rate1 >= lift * rate0 and evidence >= bar:
            good[term] = (p * np.log(rate1 / rate0), p)
    narrower: Counter[str] = Counter()
    for term, (_, p) in good.items():
        for w in wider(term):
            narrower[w] = max(narrower[w], p)
    stems = {t for t, (_, p) in good.items() if narrower[t] < 0.95 * p}
    kept = [t for t in stems if not any(w in stems for w in wider(t))]
    return sorted(kept, key=lambda t: (-good[t][0], t))[:most]


def covering(fired: list[list[int]], count: int, *, most: int, least: int, times: int = 2) -> list[int]:
    """Of ``count`` voters, the strongest first, those that fire on ``least`` or more toxic texts (``fired``: the voters of each) on which
    fewer than ``times`` chosen ones do. So a group of copies of one toxic text, all of whose words look toxic, gives a few voters."""
    of = [[] for _ in range(count)]
    for text, voters in enumerate(fired):
        for v in voters:
            of[v].append(text)
    covered, out = np.zeros(len(fired), int), []
    for v, texts in enumerate(of):
        if len(out) < most and (covered[texts] < times).sum() >= least:
            out.append(v)
            covered[texts] += 1
    return out


def _information(joint: np.ndarray) -> np.ndarray:
    """Mutual information (nats) of each pair of binary voters, from their rates of firing together (rates of their own: diagonal)."""
    rate = np.diag(joint)
    a, b = np.broadcast_to(rate[:, None], joint.shape), np.broadcast_to(rate[None, :], joint.shape)
    out = np.zeros(joint.shape)
    for p, pa_, pb in ((joint, a, b), (a - joint, a, 1 - b), (b - joint, 1 - a, b), (1 - a - b + joint, 1 - a, 1 - b)):
        p = np.clip(p, 0, 1)
        out += np.where(p > 1e-12, p * np.log(np.maximum(p, 1e-12) / np.maximum(pa_ * pb, 1e-12)), 0)
    return out


def _forest(gain: np.ndarray, least: float) -> np.ndarray:
    """Parent of each voter (-1: none) in the forest of greatest gain, of edges that gain ``least`` or more."""
    n = len(gain)
    parent, best, from_, left = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        at = int(np.argmax(np.where(left, best, -np.inf))) if (left & (best >= least)).any() else int(np.flatnonzero(left)[0])
        if best[at] >= least:
            parent[at] = from_[at]
        left[at] = False
        better = left & (gain[at] > best)
        best[better], from_[better] = gain[at][better], at
    return parent


@dataclass
class LabelModel:
    """Prior of the toxic class, each voter's parent and rates of firing, and the error rates of the human labels."""

    prior: float
    parent: np.ndarray  # of each voter, or -1
    rates: np.ndarray  # class x state of the parent (0 where there is none) x voter
    label_rates: np.ndarray  # P(label is 1 | class)

    @classmethod
    def fit(cls, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, steps: int = 25) -> tuple[LabelModel, np.ndarray]:
        """``labels`` are 1, 0 or nan (none). Without any label the texts where most voters fire start as toxic."""
        w = np.ones(len(votes)) if weights is None else weights
        votes, told = votes.astype(np.float64), ~np.isnan(labels)
        start = np.clip(votes.sum(axis=1) / max(1, votes.shape[1]), 0.1, 0.9)
        q = np.where(told, np.where(labels == 1, 0.95, 0.05), start)
        part, parent, model = w * told if told.any() else w, np.full(votes.shape[1], -1), None
        for step in range(steps):
            mass = np.stack([part * (1 - q), part * q])
            sums = mass.sum(axis=1)
            if step in (2, 8):  # which voter hangs on which, given the class
                joint = [votes.T @ (m[:, None] * votes) / max(s, 1e-9) for m, s in zip(mass, sums, strict=True)]
                gain = sum(s / sums.sum() * _information(j) for j, s in zip(joint, sums, strict=True))
                np.fill_diagonal(gain, -np.inf)
                parent = _forest(gain, 10 / sums.sum())  # a likelihood ratio of 20, twice the information
            above = np.where(parent >= 0, votes[:, parent], 0.0)
            rates = np.empty((2, 2, votes.shape[1]))
            for y in (0, 1):
                fires = mass[y] @ votes
                own = (fires + 0.1) / (sums[y] + 1)
                both, parents = mass[y] @ (votes * above), mass[y] @ above
                rates[y, 1] = (both + 2 * own) / (parents + 2)
                rates[y, 0] = (fires - both + 2 * own) / (sums[y] - parents + 2)
            seen = mass[:, told]
            # a human may err, but seldom: else a voter that fires too widely could make itself the class and call the labels wrong
            errors = np.clip((seen @ np.nan_to_num(labels[told]) + [1, 19]) / (seen.sum(axis=1) + 20), [0.003, 0.9], [0.05, 0.997])
            model = cls(float(np.clip(q @ part / part.sum(), 1e-4, 1 - 1e-4)), parent, np.clip(rates, 1e-5, 1 - 1e-5), errors)
            new = model.posterior(votes, labels)
            done = part is w and np.abs(new - q).max() < 1e-4
            q, part = new, w  # the first step learns from what is labelled, all others from all texts
            if done and step > 8:
                break
        return model, q

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        fire, still = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))  # state of the parent x voter
        above = np.where(self.parent >= 0, votes[:, self.parent], 0.0)
        odds = np.log(self.prior / (1 - self.prior)) + still[0].sum() + votes @ (fire[0] - still[0]) + above @ (still[1] - still[0]) + (votes * above) @ (fire[1] - still[1] - fire[0] + still[0])
        r = self.label_rates
        odds += np.where(np.isnan(labels), 0.0, np.where(labels == 1, np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0]))))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def logistic(x: np.ndarray, q: np.ndarray, weights: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression on weighted rows with soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (weights * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty), x.T @ (weights * (q - p)) - penalty * w)
        w += move * min(1.0, 5 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-5:
            break
    return w


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    base: float | None  # the score of all texts, where nothing could be learnt

    def score(self, text: str | None) -> float:
        if self.base is not None:
            return self.base
        fired, hits, size = self.voters.votes(text)
        w, m = self.weights, len(self.voters.terms)
        x = w[-1] + sum(w[i] for i in fired) + (w[m] if not hits else w[m + 1] * np.log1p(hits) + w[m + 2] * min(1.0, 20 * hits / size))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, x)))))


def _features(voters: Voters, texts) -> tuple[np.ndarray, np.ndarray]:
    """(votes with the voter for silence, features of the classifier)."""
    m = len(voters.terms)
    votes, more = np.zeros((len(texts), m + 1), np.float32), np.zeros((len(texts), 3))
    for i, (fired, hits, size) in enumerate(texts):
        votes[i, list(fired)] = 1
        votes[i, m] = not hits
        more[i] = (1, 0, 0) if not hits else (0, np.log1p(hits), min(1.0, 20 * hits / size))
    return votes, np.hstack([votes[:, :m], more])


def _drawn(docs: DataFrame, known: DataFrame, *, positives: int, negatives: int, unlabelled: int) -> DataFrame:
    """(text, label): a text for each drawn label, and texts without one (label null). ``docs`` is (_tx_id, _tx_text)."""
    key = F.xxhash64(F.lit(23), "_tx_id").alias("_tx_key")
    labelled = known.select("_tx_label", key)
    chosen = [key_sample(labelled.filter(F.col("_tx_label") == v), key="_tx_key", by="_tx_label", most=most) for v, most in ((1, positives), (0, negatives))]
    drawn = written(chosen[0].unionByName(chosen[1]), "drawn-labels")  # at most positives + negatives rows
    told = docs.select(key, "_tx_text").join(F.broadcast(drawn), "_tx_key").groupBy("_tx_key", "_tx_label").agg(F.min_by("_tx_text", F.xxhash64("_tx_text")).alias("_tx_text")).select("_tx_text", "_tx_label")
    own = F.xxhash64(F.lit(31), "_tx_id", "_tx_text").alias("_tx_own")
    total = docs.count()
    some = lambda rows: rows.select(own, "_tx_id", "_tx_text").dropDuplicates(["_tx_own"]).orderBy("_tx_own").limit(unlabelled)
    quiet = written(some(docs.filter(low_hash(own, unlabelled, max(1, total)))), "quiet")
    if quiet.count() < min(unlabelled, total) and total > 2 * unlabelled + 1000:  # nearly all rows are alike
        quiet = written(some(docs), "quiet")
    named = known.join(F.broadcast(quiet.select("_tx_id").distinct()), "_tx_id", "left_semi").select("_tx_id").distinct()
    quiet = quiet.join(F.broadcast(named), "_tx_id", "left_anti")  # at most ``unlabelled`` ids
    return written(told.unionByName(quiet.select("_tx_text", F.lit(None).cast("int").alias("_tx_label"))), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", label: str = "toxic", positives: int = 3000, negatives: int = 6000, unlabelled: int = 6000, voters: int = 300, least: int = 3, lift: float = 6.0, candidates: int = 40_000, ridge: float = 0.5, unlabelled_mass: float = 0.05) -> Model:
    """Fits on labelled rows, at most ``positives`` and ``negatives`` of them, and on at most ``unlabelled`` other ones, which together
    weigh ``unlabelled_mass`` of the labelled ones: with more, what they have in common drowns what the labels say."""
    require(docs, **{text: T.StringType})
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("_tx_id"), F.col(label).cast("int").alias("_tx_label")).filter("_tx_label IN (0, 1) AND _tx_id IS NOT NULL")
    known = written(known.distinct(), "labels")
    total = {r["_tx_label"]: r["n"] for r in known.groupBy("_tx_label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(total) < 2:
        return Model(Voters([]), np.zeros(4), (total.get(1, 0) + 1) / (sum(total.values()) + 2) if total else 0.0)
    sample = _drawn(docs.select(F.col(id_col).alias("_tx_id"), F.col(text).alias("_tx_text")), known, positives=positives, negatives=negatives, unlabelled=unlabelled)
    n1, n0 = min(total[1], positives), min(total[0], negatives)

    def mine(batches):
        for table in in_batches(batches, 8 << 20):
            seen: Counter[str] = Counter()
            for t in table.column(0).to_pylist():
                seen.update({x for w in words_of(t) for x in terms_of(w)})
            yield pa.record_batch({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    often = sample.filter("_tx_label = 1").mapInArrow(mine, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(least, n1 // 500))
    tried = [r.term for r in often.orderBy(F.desc("n"), "term").limit(candidates).collect()]
    trial = spark.sparkContext.broadcast(Voters(sorted({*tried, *(f"={w}" for w in SEED)})))

    def count(batches):
        known = trial.value
        for table in in_batches(batches, 8 << 20):
            seen = (Counter(), Counter())
            for t, y in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
                seen[y].update(known.votes(t)[0])
            terms = sorted({*seen[0], *seen[1]})
            yield pa.record_batch({"term": pa.array(terms, pa.int32()), "p": pa.array([seen[1][t] for t in terms], pa.int64()), "n": pa.array([seen[0][t] for t in terms], pa.int64())})

    counted = sample.filter("_tx_label IS NOT NULL").mapInArrow(count, "term int, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()  # a row per candidate
    strong = mined([(trial.value.terms[r.term], r.p, r.n) for r in counted], n1, n0, most=7 * voters, least=max(least, n1 // 500), lift=lift)
    terms = list(dict.fromkeys([*strong, *(f"={w}" for w in SEED)]))
    shared = spark.sparkContext.broadcast(Voters(terms))

    def vote(voters, batches):
        own = voters.value
        for b in batches:
            got = [own.votes(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch({"fired": pa.array([sorted(f) for f, _, _ in got], pa.list_(pa.int32())), "hits": pa.array([h for _, h, _ in got], pa.int64()), "size": pa.array([s for _, _, s in got], pa.int64()), "label": b.column(1)})

    rows = sample.filter("_tx_label = 1").mapInArrow(partial(vote, shared), "fired array<int>, hits long, size long, label int").collect()  # a short row per sampled text
    chosen = covering([r.fired for r in rows], len(terms), most=voters, least=max(least, n1 // 500))
    terms = sorted({*(terms[v] for v in chosen), *(f"={w}" for w in SEED)})
    again = spark.sparkContext.broadcast(Voters(terms))
    rows = sample.mapInArrow(partial(vote, again), "fired array<int>, hits long, size long, label int").collect()
    votes, x = _features(Voters(terms), [(r.fired, r.hits, r.size) for r in rows])
    y = np.array([np.nan if r.label is None else r.label for r in rows], float)
    if not (y == 1).any() or not (y == 0).any():
        return Model(Voters([]), np.zeros(4), (total[1] + 1) / (sum(total.values()) + 2))
    # labels of either class stand for all of their class
    share = {c: total[c] / (y == c).sum() * np.isfinite(y).sum() / sum(total.values()) for c in (0, 1)}
    weights = np.where(y == 1, share[1], np.where(y == 0, share[0], unlabelled_mass * np.isfinite(y).sum() / max(1, np.isnan(y).sum())))
    _, q = LabelModel.fit(votes, y, weights)
    return Model(Voters(terms), logistic(x, q, weights, ridge), None)


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "_tx_score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text."""
    require(docs, **{text: T.StringType})
    free_name(docs, name)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        m = shared.value
        for table in in_batches(batches, 16 << 20):
            yield from table.append_column(name, pa.array([m.score(t) for t in table.column(at).to_pylist()], pa.float64())).combine_chunks().to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; learnt from labels outside the held-out fold (crc32 of the id as text, modulo 5, is 0)."""
    model = fit(docs.select("doc_id", "text").filter(fold_bucket("doc_id", 5) != 0), labels.filter(fold_bucket("doc_id", 5) != 0))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_bucket("doc_id", 5) == 0).alias("held_out"), F.col("_tx_score").alias("score"), (F.col("_tx_score") >= 0.5).cast("int").alias("predicted"))
