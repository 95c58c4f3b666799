"""Language identification, family first.

A text becomes counts of hashed letter 1- to 3-grams. Linear support vector machines, one against the rest, choose a
language family; within the family one-versus-one machines separate the languages, each pair casting a vote, equal votes
going to the larger sum of margins. The machines are trained on a bounded sample of labelled rows: about `per_language`
rows of each language, and `sample_rows` in all, drawn by a hash of the doc_id at a rate that counts over all rows set.
Of very many values of lang, as a noisy column may have, the `CLASSES` with most rows are learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, fresh, table
from .grams import code_points, gram_buckets, letters

#: Labelled rows to train on: of a language, and in all. Bits of a bucket. Passes and cost of the machines.
PER_LANGUAGE, SAMPLE_ROWS, BITS, EPOCHS, COST = 400, 4000, 12, 12, 4.0
#: Values of a label that are learned at most, those with most rows first.
CLASSES = 200
UNKNOWN = "und"
#: Families of languages by ISO 639-1 code; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms tl",
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.split("-")[0].lower() in langs.split()), lang)


def features(text: str, bits: int = BITS) -> np.ndarray | None:
    """Square roots of gram counts, at unit length, with a constant; None for a text without letters."""
    points = code_points(text)
    if not letters()[points].any():
        return None
    parts = [np.bincount(gram_buckets(points, size, bits), minlength=1 << bits) for size in (1, 2, 3)]
    counts = np.sqrt(np.concatenate(parts).astype(np.float32))
    return np.append(counts / np.linalg.norm(counts), np.float32(0.3))


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """A linear machine of squared hinge loss by dual coordinate descent; y is +1 or -1, classes weigh alike."""
    rng, n = np.random.default_rng(0), len(x)
    own = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * cost
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(n)
    square, damp = (x * x).sum(axis=1), 1 / (2 * own)
    for _ in range(epochs):
        for i in rng.permutation(n):
            step = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + damp[i] * alpha[i]) / (square[i] + damp[i]), 0.0)
            if step != alpha[i]:
                w += np.float32((step - alpha[i]) * y[i]) * x[i]
                alpha[i] = step
    return w


@dataclass
class LanguageModel:
    """langs by family; a weight row for each family, and for each pair of langs of a family (positive: the first)."""

    families: list[str]
    langs: dict[str, list[str]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]
    bits: int = BITS

    @classmethod
    def train(cls, x: np.ndarray, langs: list[str], bits: int = BITS) -> LanguageModel:
        names = np.array(langs)
        own = {f: sorted(x for x in set(langs) if family_of(x) == f) for f in sorted({family_of(x) for x in set(langs)})}
        of = np.array([family_of(x) for x in langs])
        families = list(own)
        rest = np.stack([train_svm(x, np.where(of == f, 1, -1)) for f in families]) if len(families) > 1 else np.zeros((len(families), x.shape[1]), np.float32)
        pairs = {}
        for f in families:
            for a, b in combinations(own[f], 2):
                rows = (names == a) | (names == b)
                pairs[a, b] = train_svm(x[rows], np.where(names[rows] == a, 1, -1))
        return cls(families, own, rest, pairs, bits)

    @property
    def guess(self) -> float:
        """The score of a mere guess among the languages learned."""
        return 1 / max(1, sum(map(len, self.langs.values())))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1, the chance that the deciding machines give it."""
        row = features(text, self.bits) if text and self.families else None
        if row is None:
            return UNKNOWN, 0.0
        margins = self.family_weights @ row
        best = int(margins.argmax())
        score = 1.0
        if len(self.families) > 1:
            score = _chance(float(margins[best] - np.delete(margins, best).max()))
        langs = self.langs[self.families[best]]
        votes = {a: [0, 0.0] for a in langs}
        pair = {}
        for a, b in combinations(langs, 2):
            pair[a, b] = m = float(self.pair_weights[a, b] @ row)
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        lang = max(langs, key=lambda a: (*votes[a], a))
        own = [m if a == lang else -m for (a, b), m in pair.items() if lang in (a, b)]
        return lang, score * (_chance(2 * min(own)) if own else 1.0)


def _chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * margin, -30, 30))))


def sampled(rows: DataFrame, by: str, per_class: int, in_all: int, key: str = "doc_id", classes: int = CLASSES) -> DataFrame:
    """About `per_class` rows of each value of `by` and about `in_all` in all, by a hash of `key`.

    Of the values the `classes` with most rows count, equal ones in order of value; the driver gets a count of each.
    """
    counts = rows.groupBy(by).count().orderBy(F.desc("count"), by).limit(classes).collect()
    if not counts:
        return rows
    each = min(per_class, max(1, in_all // len(counts)))
    rates = F.create_map(*[F.lit(x) for value, n in counts for x in (value, min(1.0, each / n))])
    rate = F.coalesce(rates[F.col(by)], F.lit(-1.0))
    return rows.where((F.xxhash64(F.lit("sample"), F.col(key)) / float(1 << 64) + 0.5) <= rate)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> LanguageModel:
    """A model from `labelled` (doc_id, text, lang). The driver gets the sample's features: 24 kB a row at 12 bits."""
    rows = sampled(labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang"), "lang", per_language, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, lang, row.astype("<f2").tobytes()) for d, text, lang in zip(*[c.to_pylist() for c in batch.columns], strict=True) if (row := features(text, bits)) is not None]
            columns = list(zip(*found)) or [(), (), ()]
            kinds = (pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "lang", "row"])

    got = rows.mapInArrow(count, "doc_id long, lang string, row binary").toArrow()
    found = sorted(zip(got["lang"].to_pylist(), got["row"].to_pylist()))  # in an order that doesn't depend on partitions
    x = np.stack([np.frombuffer(r, "<f2").astype(np.float32) for _, r in found]) if found else np.zeros((0, 1), np.float32)
    return LanguageModel.train(x, [lang for lang, _ in found], bits)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score. A text that is null or has no letter is `und` with score 0; so is any without languages learned.

    Whole texts are read; rows keep their number and their other columns. Clashing names get a leading underscore.
    """
    lang_name, score_name = fresh(docs, "lang_pred", "score")
    schema, at = extended(docs, (lang_name, "string"), (score_name, "double")), docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(x) for x in batch.column(at).to_pylist()]
            langs, scores = pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, langs, scores], names=schema.names)

    return docs.mapInArrow(predict, schema)


def fold(docs: DataFrame, n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))) % n


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `documents`, learned from the rows that aren't held out.

    identify() states the odd cases; a null doc_id counts as an empty text for the fold. An empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(docs, 4) == 2
    model = train(docs.where(~held_out))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
