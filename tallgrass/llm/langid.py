"""Language identification by a string kernel.

The kernel is the blended spectrum of letter n-grams (1 to 3, lower case; everything but letters, Unicode's category L,
is a gap): the number
of n-grams that two texts have in common, over the root of the product of how many each has. Landmark documents give
a Nyström feature map K(x, L) K(L, L)^(-1/2); one-versus-rest kernel ridge regression is fitted in that space. Scoring
is two matrix products per block of documents: presence rows times the landmarks' sparse presence columns, and kernel
rows times weights.

Fitting reads a bounded sample (PER_LANGUAGE documents of each language, chosen by hash of doc_id, of which LANDMARKS
are landmarks, MOST_LANDMARKS in all); the sample's tasks return sums of m x m products, m = landmarks. The model is
broadcast: its size is that of the landmarks' n-grams and of m x languages weights. Prediction is one narrow pass over whole texts, without a shuffle.

Defined cases: `und` with score 0 for a null text, a text without letters, or where no labelled text exists; rows with
null doc_id, text or lang are not learned from; a text without any learned n-gram gets equal scores and the first
language; equal texts get equal predictions; repeated rows each get a row; an empty table gives an empty result; extra
columns pass through, output names that clash get a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

PER_LANGUAGE, LANDMARKS, MOST_LANDMARKS = 1500, 40, 4000
RIDGE, SHARPNESS, BLOCK, DENSE = 1e-3, 4.0, 256, 8
LETTER = regex.compile(r"\p{L}")
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: itself if it is a letter, else 0."""
    if not _letters:
        found = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if LETTER.match(chr(c)):
                found[c] = c
        _letters.append(found)
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Distinct n-grams (1 to 3 code points of 21 bits; a bit on top of them tells n)."""
    one = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    two = (one[:-1] << 21) | one[1:]
    three = (two[:-1] << 21) | one[2:]
    return np.concatenate([np.unique(one), np.unique(two) | (1 << 42), np.unique(three) | (-1 << 63)])


@dataclass
class Spectrum:
    """The landmarks' n-grams, sorted, each with its landmarks: a sparse presence matrix by columns. Nothing is merged.

    Columns that one in DENSE landmarks or more have are kept as dense ones too, which takes at most DENSE times the
    numbers of the sparse ones; texts meet them in one matrix product per block.
    """

    known: np.ndarray
    starts: np.ndarray  # of the n-grams' landmarks in owners
    owners: np.ndarray
    landmarks: int
    column: np.ndarray  # of an n-gram in the dense part, or -1
    dense: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Spectrum:
        sets = [grams(t) for t in texts]
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(g) for g in sets])
        order = np.argsort(every, kind="stable")
        known, starts = np.unique(every[order], return_index=True)
        starts, owners = np.append(starts, len(every)), owner[order]
        often = np.diff(starts) * DENSE >= len(texts)
        column = np.where(often, np.cumsum(often) - 1, -1)
        dense = np.zeros((int(often.sum()), len(texts)), np.float32)
        wide = np.repeat(column, np.diff(starts))
        dense[wide[wide >= 0], owners[wide >= 0]] = 1
        return cls(known, starts, owners, len(texts), column, dense)

    def common(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many n-grams each text shares with each landmark (presence rows times presence columns), and how many it has."""
        rows, sizes = np.zeros((len(texts), self.landmarks)), np.zeros(len(texts))
        for first in range(0, len(texts), BLOCK):
            presence = np.zeros((len(texts[first : first + BLOCK]), len(self.dense)), np.float32)
            for k, t in enumerate(texts[first : first + BLOCK]):
                g = grams(t)
                sizes[first + k] = len(g)
                at = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
                at = at[self.known[at] == g]
                column = self.column[at]
                presence[k, column[column >= 0]] = 1
                at = at[column < 0]
                n = self.starts[at + 1] - self.starts[at]
                done = np.cumsum(n)
                if len(done):
                    take = np.repeat(self.starts[at] - (done - n), n) + np.arange(done[-1])
                    rows[first + k] = np.bincount(self.owners[take], minlength=self.landmarks)
            rows[first : first + BLOCK] += presence @ self.dense
        return rows, sizes


@dataclass
class Model:
    languages: list[str]
    spectrum: Spectrum
    sizes: np.ndarray
    weights: np.ndarray  # landmarks x languages; or the Nystroem map while fitting

    def features(self, texts: list[str]) -> np.ndarray:
        """Kernel rows times weights, a block of texts at a time."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        for at in range(0, len(texts), BLOCK):
            rows, sizes = self.spectrum.common(texts[at : at + BLOCK])
            out[at : at + BLOCK] = rows / np.sqrt(np.maximum(sizes[:, None] * self.sizes[None], 1)) @ self.weights
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[DataFrame, list[str]]:
    """About per_language documents of every language, evenly by hash, of those that may be learned from."""
    may = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in may.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return may.select("doc_id", "text", "lang"), []
    share = F.create_map(*(F.lit(x) for k, v in counts.items() for x in (k, min(1.0, per_language / v))))
    drawn = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)) < F.try_element_at(share, F.col("lang"))
    return may.where(drawn).select("doc_id", "text", "lang"), sorted(counts)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, most: int = MOST_LANDMARKS) -> Model | None:
    """Learns from text and lang of the documents that are not held out; None if there are none.

    The sample has per_language documents of each language; of these, landmarks are landmarks, or fewer (at least one)
    where all languages together would have more than `most`.
    """
    drawn, languages = sample(docs, per_language)
    if not languages:
        return None
    drawn = drawn.where(F.col("text").rlike(r"\p{L}")).repartition(16, "doc_id").persist()
    landmarks = min(landmarks, max(1, most // len(languages)))
    rank = F.row_number().over(_by_hash("lang"))
    chosen = drawn.withColumn("k", rank).where(F.col("k") <= landmarks).orderBy("lang", "k").collect()  # bounded
    if not chosen:
        drawn.unpersist()
        return None
    texts = [r.text for r in chosen]
    spectrum = Spectrum.of(texts)
    rows, sizes = spectrum.common(texts)
    kernel = rows / np.sqrt(sizes[:, None] * sizes[None])
    values, vectors = np.linalg.eigh(kernel.astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    model = Model(languages, spectrum, sizes, root)
    sent, m, c = docs.sparkSession.sparkContext.broadcast(model), len(texts), len(languages)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + c + 1, m))
        for b in batches:
            x = sent.value.features(b.column(0).to_pylist())
            y = np.full((len(x), c), -1.0)
            y[np.arange(len(x)), [languages.index(v) for v in b.column(1).to_pylist()]] = 1
            total[:m] += x.T @ x
            total[m : m + c] += y.T @ x
            total[-1, 0] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = drawn.select("text", "lang").mapInArrow(sums, "sums binary").collect()  # 16 sums, m x m
    drawn.unpersist()
    total = sum(np.frombuffer(p.sums).reshape(m + c + 1, m) for p in parts)
    gram = total[:m] + RIDGE * total[-1, 0] * np.eye(m)
    model.weights = root @ np.linalg.solve(gram, total[m : m + c].T)
    return model


def _by_hash(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id", "text")


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (softmax over the languages, 0 to 1) to docs."""
    pred, score = fresh(docs, "lang_pred", "score")
    if model is None:
        return docs.withColumns({pred: F.lit("und"), score: F.lit(0.0)})
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for k in range(0, b.num_rows, BLOCK):
                texts = b.column(at).slice(k, BLOCK).to_pylist()
                real = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                s = SHARPNESS * sent.value.features([texts[i] for i in real])
                p = np.exp(s - s.max(1, keepdims=True)) if real else s
                p = p / p.sum(1, keepdims=True) if real else p
                said = {i: (sent.value.languages[j], float(q[j])) for i, q, j in zip(real, p, p.argmax(1), strict=True)} if real else {}
                langs += [said.get(i, ("und", 0.0))[0] for i in range(len(texts))]
                scores += [said.get(i, ("und", 0.0))[1] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, pred, score]
            )

    fields = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
