"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Words and word beginnings of 3 to 8 characters that toxic documents hold far more often than
others are evidence; they are counted over all labelled documents that are not held out. The
field is fitted to a bounded sample of these (about `sample` rows at most, three tenths of them
toxic), chosen by hash; rows of a thinned class weigh as much as the class does among all. Evidence labels the tokens: in a toxic document a token with evidence is
toxic, every other token is not. The field has two states, a weight per grade of evidence, a bias and
transitions, and is fitted to the labelled sequences by maximum likelihood.

Tokens without evidence all look alike, so the forward and backward recursions step from one
token with evidence to the next and cross the gap by a matrix power: exact marginals at the cost
of the evidence alone. A document's score is a logistic function, fitted to the labels, of the
expected number of toxic tokens and of the probability that there is any.

Tokens are runs of digits, letters and whatever lies beyond ASCII, A-Z lower-cased. Null and
empty texts have no token. Without labelled documents of both classes every score is 0. Texts of
any length are scored whole; repeated rows each get a row and, if labelled, each count. A null doc_id
has no label. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm import text as tx
from tradeloom.llm.tasks import (
    add_columns,
    boxed,
    bucket_count,
    by_bucket,
    map_batches,
    packed,
    packed_schema,
    unboxed,
    written,
)
from tradeloom.llm.text import U64, mix

PREFIXES = range(3, 9)  # characters of word beginnings that are evidence
SAMPLE = 20_000  # labelled documents to learn from, at most
LEXICON = 1 << 20  # pieces of evidence, at most
_MIN_DOCS = 5  # toxic documents that must hold a piece of evidence
_BUCKET_BYTES = 8 << 20  # input bytes per bucket of features
_HELD = 2_000_000  # distinct features a task holds
_RATIOS = (8.0, 20.0, 60.0, 180.0)  # grades: how much more often toxic documents hold it


class Tokens:
    """Words of a block and hashes of the words and of their beginnings."""

    def __init__(self, block: tx.Block):
        self.words = tx.Words(block, tx.NOT_ALNUM, lower=True)
        self.n = len(self.words.starts)

    def features(self):
        """(token, hash) pairs, one kind of feature at a time."""
        words = self.words
        every = np.arange(self.n)
        yield every, words.hashes()
        heads = np.flatnonzero((words.bytes & 0xC0) != 0x80)
        first = np.searchsorted(heads, words.starts)
        heads = np.r_[heads, np.full(PREFIXES[-1] + 1, len(words.bytes))]
        for chars in PREFIXES:
            end = heads[np.minimum(first + chars, len(heads) - 1)]
            long = np.flatnonzero(end < words.ends)  # the whole word is a feature of its own
            hashes = tx.byte_range_hash(words.bytes, words.starts[long], end[long])
            yield long, mix(hashes + U64(chars))


def known_labels(labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """(id, toxic) of the labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.where("toxic IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    return known.where(F.crc32(F.col("id").cast("string").cast("binary")) % modulus != held_out)


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of the rows with a label."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return found.join(known, F.col("doc_id") == F.col("id")).select("doc_id", "toxic", "text")


def labelled_sample(docs: DataFrame, known: DataFrame, sizes: dict[int, int], sample: int) -> DataFrame:
    """About `sample` labelled rows at most, written.

    Each class has a quota; a class that exceeds it is thinned by a hash of the doc_id.
    """
    grain = 1 << 62
    quota = {1: sample * 3 // 10, 0: sample * 7 // 10}
    share = {t: min(grain, quota[t] * grain // max(n, 1)) for t, n in sizes.items()}
    limit = F.when(F.col("toxic") == 1, share.get(1, 0)).otherwise(share.get(0, 0))
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("id"), F.lit(grain)) < limit))
    return written(labelled(docs, chosen), "sample")


class _Held:
    """Toxic and clean documents per feature, kept sorted and distinct."""

    def __init__(self):
        self._parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *part: np.ndarray) -> None:
        self._parts.append(part)
        self.size += len(part[0])

    def merge(self) -> tuple[np.ndarray, ...]:
        if not self.size:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        features, toxic, clean = (np.concatenate(c) for c in zip(*self._parts, strict=True))
        order = np.argsort(features, kind="stable")
        features = features[order]
        head = np.flatnonzero(np.r_[True, features[1:] != features[:-1]])
        part = features[head], *(np.add.reduceat(c[order], head) for c in (toxic, clean))
        self._parts, self.size = [part], len(head)
        return part


def evidence(rows: DataFrame, sizes: dict[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature hashes and their grades (1, 2, ...), from all `rows`.

    Beyond LEXICON features those stay that tell most, by the logarithm of the ratio times the
    toxic documents, an equal part of LEXICON from each bucket of hashes.
    """

    def run(batches):
        held, limit = _Held(), _HELD
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for block in tx.blocks(batch.column(1)):
                tokens = Tokens(block)
                doc = tokens.words.docs()
                for token, hashes in tokens.features():
                    d = doc[token]
                    order = np.lexsort((d, hashes))
                    f, d = hashes[order], d[order]
                    new = np.r_[True, (f[1:] != f[:-1]) | (d[1:] != d[:-1])] if len(f) else np.zeros(0, bool)
                    f, bad = f[new], toxic[block.first + d[new]].astype(np.int64)
                    if len(f):
                        at = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
                        bad, many = np.add.reduceat(bad, at), np.diff(np.r_[at, len(f)])
                        held.add(f[at], bad, many - bad)
                if held.size > limit:
                    features, *counts = held.merge()
                    limit = 2 * held.size
                    if held.size > _HELD:
                        yield packed(_bucket(features, buckets), [features, *counts])
                        held, limit = _Held(), _HELD
        features, *counts = held.merge()
        made = packed(_bucket(features, buckets), [features, *counts])
        if made is not None:
            yield made

    most = -(-LEXICON // buckets)

    def total(features, toxic, clean) -> pa.Table:
        held = _Held()
        held.add(features, toxic, clean)
        features, toxic, clean = held.merge()
        ratio = ((toxic + 0.5) / (sizes[1] + 1)) / ((clean + 0.5) / (sizes[0] + 1))
        kept = np.flatnonzero((toxic >= _MIN_DOCS) & (ratio >= _RATIOS[0]))
        weight = toxic[kept] * np.log(ratio[kept])
        kept = kept[np.lexsort((features[kept], -weight))[:most]]
        grades = np.searchsorted(_RATIOS, ratio[kept], "right").astype(np.int8)
        return pa.table({"features": [features[kept].tobytes()], "grades": [grades.tobytes()]})

    sent = map_batches(rows, ["toxic", "text"], run, packed_schema(3))
    parts = by_bucket(sent, [U64, np.int64, np.int64], total, "features binary, grades binary").collect()
    hashes = np.frombuffer(b"".join(bytes(p["features"]) for p in parts), U64)
    grades = np.frombuffer(b"".join(bytes(p["grades"]) for p in parts), np.int8)
    order = np.argsort(hashes)
    return hashes[order], grades[order]


def _bucket(features: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(features) >> U64(40)).astype(np.int64) * buckets >> 24


class Lexicon:
    """Looks up the grade of evidence of each token; 0 is none."""

    def __init__(self, hashes: np.ndarray, grades: np.ndarray):
        self.hashes, self.grades = hashes, grades
        self._seen = np.zeros(1 << 22, bool)
        self._seen[hashes >> U64(42)] = True

    def tag(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros(tokens.n, np.int8)
        if not len(self.hashes):
            return out
        for token, hashes in tokens.features():
            maybe = np.flatnonzero(self._seen[hashes >> U64(42)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[maybe]
            np.maximum.at(out, token[maybe[same]], self.grades[at[same]])
        return out


@dataclass
class Sequences:
    """Token sequences by their tokens with evidence.

    n       tokens of each sequence
    bounds  evidence of sequence i is at bounds[i]:bounds[i + 1]
    at      its position in the sequence
    grade   its grade
    """

    n: np.ndarray
    bounds: np.ndarray
    at: np.ndarray
    grade: np.ndarray


def sequences(tokens: Tokens, grades: np.ndarray) -> Sequences:
    at = np.flatnonzero(grades)
    bounds = np.searchsorted(at, tokens.words.bounds)
    start = np.repeat(tokens.words.bounds[:-1], np.diff(bounds))
    return Sequences(tokens.words.counts, bounds, at - start, grades[at])


@dataclass
class Field:
    """Weights: bias of the toxic state, one per grade, and transitions (0 to 0 counts 0)."""

    bias: float
    grades: np.ndarray
    enter: float
    leave: float
    stay: float

    @staticmethod
    def of(w: np.ndarray) -> Field:
        return Field(w[0], np.r_[0.0, w[4:]], w[1], w[2], w[3])

    def _gap(self):
        """What crosses one token without evidence, by eigenvalues, and its powers."""
        a, b = 1.0, math.exp(min(self.enter + self.bias, 30))
        c, d = math.exp(min(self.leave, 30)), math.exp(min(self.stay + self.bias, 30))
        root = math.sqrt((a - d) ** 2 + 4 * b * c)
        big, small = (a + d + root) / 2, (a + d - root) / 2
        m = np.array([[a, b], [c, d]])
        p = (m - small * np.eye(2)) / (big - small)
        return math.log(big), small / big, p, np.eye(2) - p

    def run(self, seq: Sequences, marginals: bool = True):
        """(log Z, marginals of the evidence): forward, and backward if asked."""
        grow, ratio, p, q = self._gap()
        k = np.diff(seq.bounds)
        order = np.argsort(-k, kind="stable")
        k, begin = k[order], seq.bounds[:-1][order]
        n = seq.n[order]
        score = self.bias + self.grades[seq.grade]
        step = np.exp(np.minimum(score, 30.0))
        jump = np.array([[1.0, math.exp(min(self.enter, 30))], [math.exp(min(self.leave, 30)), math.exp(min(self.stay, 30))]])

        def cross(v: np.ndarray, gap: np.ndarray, back: bool) -> np.ndarray:
            m0, m1 = (p.T, q.T) if back else (p, q)
            return v @ m0 + (ratio**gap)[:, None] * (v @ m1)

        steps = int(k[0]) if len(k) else 0
        alive = np.searchsorted(-k, -np.arange(1, steps + 1), "right")
        alpha, logz = np.zeros((len(n), 2)), np.zeros(len(n))
        alpha[:, 0] = 1.0
        before = np.full(len(n), -1)
        kept = np.empty((len(seq.at), 2)) if marginals else None
        for j in range(steps):
            m = alive[j]
            e = begin[:m] + j
            gap = seq.at[e] - before[:m] - 1
            v = cross(alpha[:m], gap, False)
            logz[:m] += gap * grow
            v = v @ jump
            v[:, 1] *= step[e]
            total = v.sum(1)
            alpha[:m] = v / total[:, None]
            logz[:m] += np.log(total)
            before[:m] = seq.at[e]
            if marginals:
                kept[e] = alpha[:m]
        gap = n - before - 1
        logz += gap * grow + np.log(np.maximum(cross(alpha, gap, False).sum(1), 1e-300))
        out = np.empty(len(n))
        out[order] = logz
        if not marginals:
            return out, None
        beta = cross(np.ones((len(n), 2)), gap, True)
        probability = np.empty(len(seq.at))
        for j in range(steps - 1, -1, -1):
            m = alive[j]
            e = begin[:m] + j
            v = kept[e] * beta[:m]
            probability[e] = v[:, 1] / v.sum(1)
            v = beta[:m] / beta[:m].sum(1)[:, None]
            v[:, 1] *= step[e]
            v = v @ jump.T
            last = np.zeros(m, np.int64) - 1
            if j:
                last = seq.at[e - 1]
            beta[:m] = cross(v, seq.at[e] - last - 1, True)
        return out, probability


def _gold(seq: Sequences, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted feature totals of the labelled paths: bias, enter, leave, stay and the grades."""
    totals = np.zeros(4 + len(_RATIOS))
    for i in np.flatnonzero(toxic):
        at, grade = seq.at[seq.bounds[i] : seq.bounds[i + 1]], seq.grade[seq.bounds[i] : seq.bounds[i + 1]]
        if not len(at):
            continue
        stay = int((np.diff(at) == 1).sum())
        runs = len(at) - stay
        totals[:4] += weight[i] * np.array([len(at), runs, runs - int(at[-1] == seq.n[i] - 1), stay])
        totals[4:] += weight[i] * np.bincount(grade, minlength=len(_RATIOS) + 1)[1:]
    return totals


def fit(seq: Sequences, toxic: np.ndarray, weight: np.ndarray, rounds: int = 60) -> Field:
    """Maximum likelihood with a small quadratic penalty, by BFGS on central differences."""
    gold, size = _gold(seq, toxic, weight), max(weight.sum(), 1)

    def loss(w: np.ndarray) -> float:
        logz, _ = Field.of(w).run(seq, marginals=False)
        return (weight @ logz - gold @ w) / size + 1e-3 * float(w @ w)

    def slope(w: np.ndarray) -> np.ndarray:
        eye = np.eye(len(w)) * 1e-4
        return np.array([(loss(w + e) - loss(w - e)) / 2e-4 for e in eye])

    w = np.r_[-4.0, -1.0, 0.0, 0.0, np.linspace(1, 4, len(_RATIOS))]
    inverse, value, g = np.eye(len(w)), loss(w), slope(w)
    for _ in range(rounds):
        direction = -inverse @ g
        rate = 1.0
        while rate > 1e-6 and not loss(w + rate * direction) < value + 1e-4 * rate * float(g @ direction):
            rate /= 2
        s = rate * direction
        if rate <= 1e-6 or np.abs(s).max() < 1e-5:
            break
        w = w + s
        new = slope(w)
        y = new - g
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            left = np.eye(len(w)) - r * np.outer(s, y)
            inverse = left @ inverse @ left.T + r * np.outer(s, s)
        value, g = loss(w), new
    return Field.of(w)


def summaries(field: Field, seq: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """Per sequence: its features for the document score; and all marginals."""
    logz, marginals = field.run(seq)
    owner = np.repeat(np.arange(len(seq.n)), np.diff(seq.bounds))
    expected = np.bincount(owner, marginals, len(seq.n))
    # The path without a toxic token has weight 1.
    some = 1 - np.exp(np.minimum(-logz, 0.0))
    return np.stack([np.log1p(expected), some], 1), marginals


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights and bias of a lightly penalised logistic regression, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    hashes: np.ndarray
    grades: np.ndarray
    field: Field
    document: np.ndarray

    def tag(self, texts: pa.Array):
        """(score, expected toxic tokens, spans) of each text; spans are byte ranges in UTF-8."""
        lexicon = Lexicon(self.hashes, self.grades)
        scores, spans = [], []
        for block in tx.blocks(texts):
            tokens = Tokens(block)
            seq = sequences(tokens, lexicon.tag(tokens))
            x, marginals = summaries(self.field, seq)
            z = np.c_[x, np.ones(len(x))] @ self.document
            scores.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            for d in range(block.n):
                own = slice(seq.bounds[d], seq.bounds[d + 1])
                token = tokens.words.bounds[d] + seq.at[own][marginals[own] >= 0.5]
                if not len(token):
                    spans.append([])
                    continue
                head = np.r_[True, np.diff(token) > 1]
                first, last = token[head], token[np.r_[head[1:], True]]
                start = block.offsets[d]
                spans.append([
                    {"start": int(tokens.words.starts[a] - start), "end": int(tokens.words.ends[b] - start)}
                    for a, b in zip(first, last, strict=True)
                ])
        return np.concatenate(scores) if scores else np.zeros(0), spans


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model | None:
    """A model of the labelled rows that are not held out; None without both classes."""
    known = known_labels(labels, modulus, held_out)
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    rows = labelled_sample(docs, known, sizes, sample)
    if rows.select("toxic").distinct().count() < 2:
        return None
    # Merged at every size: a plan that turned from broadcasting labels to moving texts as they grow
    # would make the work grow faster than the input.
    every = labelled(docs, known.hint("merge"))
    found = {r["toxic"]: r["count"] for r in every.groupBy("toxic").count().collect()}
    hashes, grades = evidence(every, found, bucket_count(docs, _BUCKET_BYTES))
    shares = {t: n / sum(found.values()) for t, n in found.items()}

    def run(batches):
        lexicon = Lexicon(hashes, grades)
        for batch in batches:
            for block in tx.blocks(batch.column(2)):
                tokens = Tokens(block)
                seq = sequences(tokens, lexicon.tag(tokens))
                offsets = pa.array(seq.bounds.astype(np.int32))
                yield pa.record_batch(
                    [
                        *[batch.column(c).slice(block.first, block.n) for c in (0, 1)], pa.array(seq.n, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(seq.at.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(seq.grade.astype(np.int32))),
                    ],
                    names=["doc_id", "toxic", "n", "at", "grade"],
                )

    schema = "doc_id long, toxic int, n long, at array<int>, grade array<int>"
    tagged = map_batches(rows, ["doc_id", "toxic", "text"], run, schema)
    found = tagged.toArrow().sort_by("doc_id")  # about `sample` rows of evidence at most
    at, grade = found["at"].combine_chunks(), found["grade"].combine_chunks()
    bounds = np.r_[0, np.cumsum(at.value_lengths().to_numpy())].astype(np.int64)
    seq = Sequences(found["n"].to_numpy(), bounds, at.flatten().to_numpy().astype(np.int64), grade.flatten().to_numpy())
    toxic = found["toxic"].to_numpy()
    # A thinned class weighs as much as it does among all rows, so scores don't depend on `sample`.
    drawn = np.bincount(toxic, minlength=2) / len(toxic)
    weight = np.where(toxic == 1, shares[1] / drawn[1], shares[0] / drawn[0])
    field = fit(seq, toxic, weight)
    x, _ = summaries(field, seq)
    return Model(hashes, grades, field, logistic(x, toxic, weight))


_SCORED = "_score double, _spans array<struct<start:int,end:int>>"


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with _score and the toxic _spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def look(batch: pa.RecordBatch) -> list[pa.Array]:
        if sent.value is None:
            return [pa.array(np.zeros(batch.num_rows)), pa.array([[]] * batch.num_rows, kind)]
        scores, spans = sent.value.tag(batch.column(0))
        return [pa.array(scores, pa.float64()), pa.array(spans, kind)]

    return add_columns(docs, look, _SCORED)


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that are not predicted toxic."""
    return unboxed(scored(boxed(docs), train(docs, labels)).where("_score < 0.5"), docs.columns)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return scored(docs, model).select(
        "doc_id",
        (crc % 5 == 0).alias("held_out"),
        F.col("_score").alias("score"),
        F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("_spans").cast("long").alias("n_spans"),
    )


ORACLE = None
