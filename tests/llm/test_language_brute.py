"""Language identification once more, with plain loops over the same sample."""

import math
import random
from collections import Counter

import numpy as np

from vellum.llm.language import WIDTH, language_id, training_rows


def grams(text):
    words = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).split(" ")
    raw = (" " + " ".join(w for w in words if w) + " ").encode()
    out = Counter(raw)
    for size in (2, 3):
        for k in range(len(raw) - size + 1):
            code = raw[k]
            for b in raw[k + 1 : k + size]:
                code = code * 257 + b
            out[(code * 2654435761) % 2**32 >> 20] += 1
    return out


def vector(counts, idf):
    v = {k: math.log1p(n) * idf[k] for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()} if norm else {}


def dot(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def unit_sum(vectors):
    total = Counter()
    for v in vectors:
        for k, x in v.items():
            total[k] += x
    norm = math.sqrt(sum(x * x for x in total.values()))
    return {k: x / norm for k, x in total.items()}


def cluster(vectors, k):
    mean = unit_sum(vectors)
    order = sorted(range(len(vectors)), key=lambda i: dot(vectors[i], mean))
    centroids = [unit_sum([vectors[i] for i in part]) for part in np.array_split(order, min(k, len(vectors)))]
    for _ in range(12):
        own = [max(range(len(centroids)), key=lambda c: (dot(v, centroids[c]), -c)) for v in vectors]
        centroids = [unit_sum([v for v, c in zip(vectors, own) if c == n]) if n in own else centroids[n] for n in range(len(centroids))]
    return centroids


def test_against_plain_loops(spark):
    rng = random.Random(11)
    letters = {"aa": "abcdeilmno", "bb": "kxzqwvyjöü", "cc": "абвгдежз"}
    texts = [(k, lang, " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 8))) for _ in range(rng.randint(3, 40)))) for k, lang in enumerate(rng.choices(list(letters), k=90))]
    texts += [(200, "aa", None), (201, None, "123 ..."), (202, "bb", "kx"), (203, None, "")]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(3)
    sample = [(r.lang, grams(r.text)) for r in training_rows(docs, "doc_id", "text", "lang", 2000).collect() if any(map(str.isalpha, r.text))]
    seen = Counter(slot for _, counts in sample for slot in counts)
    idf = [math.log((1 + len(sample)) / (1 + seen[slot])) + 1 for slot in range(WIDTH)]
    centroids = []
    for lang in sorted({lang for lang, _ in sample}):
        rows = sorted((np.bincount(list(c.elements()), minlength=WIDTH).astype("<u4").tobytes(), c) for own, c in sample if own == lang)
        centroids += [(lang, c) for c in cluster([vector(c, idf) for _, c in rows], 4)]
    got = {r.doc_id: r for r in language_id(docs).collect()}
    assert len(got) == len(texts)
    for doc_id, _, text in texts:
        if not any(map(str.isalpha, text or "")):
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
            continue
        own = vector(grams(text), idf)
        scores = sorted(((dot(own, c), lang) for lang, c in centroids), reverse=True)
        assert abs(got[doc_id].score - scores[0][0]) < 1e-3
        assert got[doc_id].lang_pred in {lang for x, lang in scores if x > scores[0][0] - 1e-3}
