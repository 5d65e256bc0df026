"""Language identification by the nearest of several clustered centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import map_rows, map_whole, quoted, text_of, with_columns

WIDTH = 4096
FIT_ROWS = 2000
PARTS = 64
LETTER = regex.compile(r"\p{L}")
#: Letters below which a text is never rejected for its distance.
SURE_LETTERS = 20
#: Letters at which the classes of text length start, each with its own floor.
LENGTHS = np.array([SURE_LETTERS, 80, 320, 1280, 5120])
#: Rows of a class below which it takes the floor of the class before it.
ENOUGH_ROWS = 10
LETTERS_ONLY = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
UNDETERMINED = "und"


def gram_counts(text: str, width: int = WIDTH) -> np.ndarray:
    """Counts of grams of 1 to 3 bytes, hashed to ``width`` slots.

    The text is lower-cased; runs of ASCII characters that aren't letters are one space.
    """
    words = text.lower().encode().translate(LETTERS_ONLY).split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    out = np.bincount(b, minlength=width)
    for size in (2, 3):
        if len(b) >= size:
            code = b[: len(b) - size + 1].copy()
            for i in range(1, size):
                code *= np.uint32(257)
                code += b[i : len(b) - size + 1 + i]
            code = (code * np.uint32(2654435761)) >> np.uint32(32 - (width.bit_length() - 1))
            out = out + np.bincount(code, minlength=width)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vector of log-damped counts times the inverse document frequency."""
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


def clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of at most ``k`` clusters by cosine.

    The rows, in the order of their cosine with the mean, are cut into ``k``
    equal parts; the means of the parts are the seeds.
    """
    order = np.argsort(vectors @ vectors.mean(axis=0), kind="stable")
    seeds = np.stack([vectors[part].sum(axis=0) for part in np.array_split(order, min(k, len(vectors)))])
    centroids = seeds / np.linalg.norm(seeds, axis=1, keepdims=True)
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids.astype(np.float32)


def length_class(letters):
    return np.searchsorted(LENGTHS, letters, side="right") - 1


def floors(scores: np.ndarray, letters: np.ndarray, slack: float) -> np.ndarray:
    """The least cosine that is not rejected, for each class of text length; it never falls with length."""
    sure = scores[letters >= SURE_LETTERS]
    out, least = [], slack * float(sure.min()) if len(sure) else 0.0
    for n in range(len(LENGTHS)):
        own = scores[length_class(letters) == n]
        if n and len(own) >= ENOUGH_ROWS:
            least = max(least, slack * float(np.quantile(own, 0.1)))
        out.append(least)
    return np.array(out)


@dataclass
class Centroids:
    """A fitted model: its size is fixed by the width, the languages of the sample and k."""

    languages: list[str]
    owner: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def rejects(self, text: str, best: int, score: float) -> bool:
        if score >= self.floor[best, -1]:  # the highest; letters need not be counted
            return False
        letters = sum(map(str.isalpha, text))
        return letters >= SURE_LETTERS and bool(score < self.floor[best, length_class(letters)])

    def verdict(self, text: str) -> tuple[str, float, bool]:
        """Language, cosine and whether the text is rejected."""
        if not self.languages or not LETTER.search(text):
            return UNDETERMINED, 0.0, True
        best, score = self.nearest(text)
        return self.languages[self.owner[best]], score, self.rejects(text, best, score)

    def nearest(self, text: str) -> tuple[int, float]:
        scores = self.vectors @ weighted(gram_counts(text, len(self.idf)), self.idf)
        best = int(np.argmax(scores))
        return best, float(min(1.0, max(0.0, scores[best])))


def is_held_out(doc_id: Column) -> Column:
    """Rows that the fit never sees; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit_rows: int) -> DataFrame:
    """At most ``fit_rows`` labelled rows, dealt evenly over the languages in the order of a hash of their ids."""
    i, lang, text = (F.col(quoted(c)) for c in (id_col, lang_col, text_col))
    known = docs.filter(lang.isNotNull() & text.isNotNull() & ~is_held_out(i)).select(i.alias("id"), lang.alias("lang"), text.alias("text"))
    # Parts of a language are ranked apart and dealt in turn, so that a common one is not ranked in one task.
    parts = known.select("id", "lang", F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part"))
    own = F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.xxhash64("id", F.lit("fit")), "id"))
    chosen = parts.withColumn("turn", own).filter(F.col("turn") <= fit_rows).orderBy("turn", "part", "lang", "id").limit(fit_rows)
    return known.join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"]).select("lang", "text")


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, k: int = 4, slack: float = 0.4) -> Centroids:
    """Learn centroids from at most ``fit_rows`` rows (2000 by default), whatever the size of the table.

    A row of at least ``SURE_LETTERS`` letters is rejected later if its cosine
    with the nearest centroid is below the floor of its length: ``slack`` times
    the least that any such row of the sample had with its own, or for longer
    texts ``slack`` times the lowest tenth's bound of the sampled rows of that
    length, so that a short scrap does not set the floor of long texts.
    """

    def start():
        def one(lang: str, text: str) -> Iterator[tuple]:
            if LETTER.search(text):
                counts = gram_counts(text)
                yield lang, np.minimum(counts, 2**31 - 1).astype("<u4").tobytes(), sum(map(str.isalpha, text))

        return one

    rows = map_rows(training_rows(docs, id_col, text_col, lang_col, fit_rows), [F.col("lang"), F.col("text")], "lang string, counts binary, letters bigint", start).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    if not rows:
        return Centroids([], np.zeros(0, int), np.zeros((0, WIDTH), np.float32), np.ones(WIDTH), np.zeros((0, len(LENGTHS))))
    counts = np.stack([np.frombuffer(r["counts"], "<u4") for r in rows])
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    vectors, labels, letters = weighted(counts, idf), np.array([r["lang"] for r in rows]), np.array([r["letters"] for r in rows])
    languages, owner, centroids, floor = sorted(set(labels)), [], [], []
    for n, lang in enumerate(languages):
        of_lang = vectors[labels == lang]
        found = clustered(of_lang, k)
        scores = of_lang @ found.T
        owner += [n] * len(found)
        floor += [floors(scores.max(axis=1), letters[labels == lang], slack)] * len(found)
        centroids.append(found)
    return Centroids([str(x) for x in languages], np.array(owner), np.concatenate(centroids), idf, np.array(floor))


def identify(docs: DataFrame, model: Centroids, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language, cosine and rejection of each text.

    ``und`` with score 0 stands for a null text or one without letters; such
    rows are rejected, as are all rows of a model without languages.
    """

    def start():
        def one(doc_id: int | None, held_out: bool, text: str) -> Iterator[tuple]:
            yield doc_id, held_out, *model.verdict(text)

        return one

    i = F.col(quoted(id_col))
    return map_rows(docs, [i.cast("bigint"), is_held_out(i), text_of(quoted(text_col))], "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean", start)


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, k: int = 4, slack: float = 0.4) -> DataFrame:
    """Fit on the labelled rows that are not held out, then identify every row."""
    return identify(docs, fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, fit_rows=fit_rows, k=k, slack=slack), id_col=id_col, text_col=text_col)


def keep_identified(docs: DataFrame, model: Centroids, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is not rejected, the language column set to the predicted one; no row is shuffled."""

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.verdict(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text_col))]
            return with_columns(batch, {lang_col: [lang for lang, _, _ in found]}).filter(pa.array([not rejected for _, _, rejected in found], pa.bool_()))

        return one

    return map_whole(docs, start)
