"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams, letters lower-cased, with everything that is not a
letter as a blank, weighted by term frequency times inverse document frequency; document
frequencies come from all training rows. The weights are learnt from a bounded sample of the
training rows (`sample`, chosen by hash, with about 200 rows of each language at least) by follow-the-regularised-leader with elastic-net
penalties, which leaves most of them zero. A temperature is then fitted on a part of the sample
that the weights have not seen, so that the score is a calibrated probability.

A text that is null or has no letter is `und` with score 0. Without training rows every text is.
Ties go to the language that sorts first. Repeated rows each get a row. Texts of any length are
taken whole. An empty table gives no rows.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm import text as tx
from tradeloom.llm.tasks import add_columns, map_batches, written

BUCKETS = 1 << 15
SAMPLE = 4_000  # labelled rows to learn the weights from, about
_LEAST = 200  # of them per language, about
_GRAIN = 1 << 62
_BLANK = 0x20
_SCALE = 100.0  # of term frequencies, which are shares of a text's grams


def _letters() -> np.ndarray:
    """The lower case of each code point that is a letter, and a blank for the others."""

    def one(c: int) -> int:
        letter = chr(c)
        if not letter.isalpha():
            return 0
        low = letter.lower()
        return ord(low) if len(low) == 1 else c

    return np.array([one(c) for c in range(sys.maxunicode + 1)], np.uint32)


class Grams:
    """Hashed 1- to 3-grams of a block's texts."""

    _lower: np.ndarray | None = None

    def __init__(self, block: tx.Block):
        if Grams._lower is None:
            Grams._lower = _letters()
        data = block.bytes
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][block.offsets]
        points = Grams._lower[points]
        letter = points > 0
        self.n = block.n
        self.bounds = starts
        self.sizes = np.diff(starts)
        self.letters = np.diff(np.r_[0, np.cumsum(letter)][starts])
        points = np.where(letter, points, np.uint32(_BLANK))
        self._doc_last = np.zeros(len(points) + 2, bool)
        self._doc_last[starts[1:][self.sizes > 0] - 1] = True
        a = points * np.uint32(0x9E3779B1)
        b = np.r_[points[1:], np.uint32(0)].astype(np.uint32) * np.uint32(0x85EBCA77)
        c = np.r_[points[2:], np.zeros(2, np.uint32)][: len(points)].astype(np.uint32) * np.uint32(0xC2B2AE3D)
        end1 = self._doc_last[: len(points)]
        end2 = end1 | self._doc_last[1 : len(points) + 1]
        one = a ^ (a >> np.uint32(15))
        two = (a ^ b ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
        three = (a + b ^ c) * np.uint32(0x2545F491)
        shift = np.uint32(32 - 15)
        #: Bucket of the 1-, 2- and 3-gram at each place; a gram that would leave its text is its 1-gram.
        self.codes = [
            (one * np.uint32(0x9E3779B1)) >> shift,
            np.where(end1, one * np.uint32(0x9E3779B1), two ^ (two >> np.uint32(13))) >> shift,
            np.where(end2, one * np.uint32(0x9E3779B1), three ^ (three >> np.uint32(13))) >> shift,
        ]

    def of(self, d: int) -> np.ndarray:
        a, b = self.bounds[d], self.bounds[d + 1]
        return np.concatenate([c[a:b] for c in self.codes])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages), with the inverse document frequency in them
    bias: np.ndarray
    temperature: float

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        langs: list[str] = []
        scores = []
        table = np.ascontiguousarray(self.weights.T.astype(np.float64))
        for block in tx.blocks(texts):
            grams = Grams(block)
            z = np.zeros((block.n, len(self.languages)))
            for k, column in enumerate(table):
                total = sum(column[c] for c in grams.codes)
                sums = np.r_[0.0, np.cumsum(total)]
                z[:, k] = (sums[grams.bounds[1:]] - sums[grams.bounds[:-1]]) / np.maximum(3 * grams.sizes, 1)
            p = _softmax((z + self.bias) / self.temperature)
            best = p.argmax(1)
            known = grams.letters > 0
            langs += [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, p.max(1), 0.0))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how many of them hold each bucket."""

    def run(batches):
        total, rows_ = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for block in tx.blocks(batch.column(0)):
                grams = Grams(block)
                for d in range(block.n):
                    held = np.zeros(BUCKETS, bool)
                    held[grams.of(d)] = True
                    total += held
                rows_ += block.n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.r_[-1, at]), pa.array(np.r_[rows_, total[at]])], names=["at", "n"])

    counted = map_batches(rows, ["text"], run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = {r["at"]: r["n"] for r in counted.collect()}  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS, np.int64)
    for at, n in found.items():
        if at >= 0:
            out[at] = n
    return found.get(-1, 0), out


def examples(sample: DataFrame) -> pa.Table:
    """(lang, at, share): sparse term frequencies of each sampled text, in a fixed order."""

    def run(batches):
        for batch in batches:
            for block in tx.blocks(batch.column(2)):
                grams = Grams(block)
                ats, shares = [], []
                for d in range(block.n):
                    at, n = np.unique(grams.of(d), return_counts=True)
                    ats.append(at.astype(np.int32))
                    shares.append((n / max(1, n.sum())).astype(np.float32))
                offsets = pa.array(np.r_[0, np.cumsum([len(a) for a in ats])].astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(block.first, block.n), batch.column(1).slice(block.first, block.n),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ats))),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(shares))),
                    ],
                    names=["rank", "lang", "at", "share"],
                )

    made = map_batches(sample, ["rank", "lang", "text"], run, "rank long, lang string, at array<int>, share array<float>")
    return made.orderBy("rank", "lang").toArrow()


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, passes: int = 3,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05,
) -> np.ndarray:
    """Weights (BUCKETS + 1, classes) learnt from (buckets, values, class); the last one is the bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at) -> np.ndarray:
        own, seen = z[at], n[at]
        return -np.sign(own) * np.maximum(np.abs(own) - l1, 0.0) / ((beta + np.sqrt(seen)) / alpha + l2)

    for _ in range(passes):
        for at, x, y in rows:
            at, x = np.r_[at, BUCKETS], np.r_[x, 1.0]
            w = weights(at)
            p = _softmax((x @ w)[None])[0]
            p[y] -= 1.0
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(slice(None))


def calibrate(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    if not len(classes):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(classes)), classes], 1e-300)).mean()

    low, high, golden = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def shares_of(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """Of _GRAIN, the share of each language's rows that is learnt from.

    One rate for all, but `_LEAST` rows of a language with fewer at that rate, or all it has.
    """
    total = sum(sizes.values())
    return {lang: min(_GRAIN, max(sample * _GRAIN // total, _LEAST * _GRAIN // n)) for lang, n in sizes.items()}


def train(rows: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of (doc_id, text, lang) rows; None if there are none."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    total, held = document_frequencies(rows)
    if not total:
        return None
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    rank = F.xxhash64("doc_id", "text")
    limit = F.lit(0).cast("long")
    for lang, share in shares_of(sizes, sample).items():
        limit = F.when(F.col("lang") == lang, F.lit(share)).otherwise(limit)
    picked = rows.select(rank.alias("rank"), "lang", "text").where(F.pmod("rank", F.lit(_GRAIN)) < limit)
    found = examples(written(picked, "lang_sample"))  # about `sample` rows
    if not found.num_rows:
        return None
    idf = np.log((1 + total) / (1 + held)) + 1.0
    languages = sorted(set(found["lang"].to_pylist()))
    at, shares = found["at"].combine_chunks(), found["share"].combine_chunks()
    data = []
    for i, lang in enumerate(found["lang"].to_pylist()):
        own = at[i].values.to_numpy()
        data.append((own, shares[i].values.to_numpy().astype(np.float64) * idf[own] * _SCALE, languages.index(lang)))
    learn = [row for i, row in enumerate(data) if i % 5] or data
    seen = ftrl(learn, len(languages))
    check = [row for i, row in enumerate(data) if i % 5 == 0]
    logits = np.array([x @ seen[own] + seen[-1] for own, x, _ in check]).reshape(-1, len(languages))
    temperature = calibrate(logits, np.array([y for _, _, y in check], np.int64))
    return Model(languages, seen[:-1] * idf[:, None] * _SCALE, seen[-1], temperature)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with _lang and _score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def look(batch: pa.RecordBatch) -> list[pa.Array]:
        if sent.value is None:
            return [pa.array(["und"] * batch.num_rows, pa.string()), pa.array(np.zeros(batch.num_rows))]
        langs, scores = sent.value.predict(batch.column(0))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return add_columns(docs, look, "_lang string, _score double")


def query(spark, folder: str, modulus: int = 3, held_out: int = 1) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    model = train(docs.where(crc % modulus != held_out))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc % modulus == held_out).alias("held_out"),
        F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
    )


ORACLE = None
