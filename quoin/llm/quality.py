"""Quality of texts by a factorisation machine.

Features of a text are its hashed words (lengths normalised), statistics of its form, and its size. Each has a
weight and a short vector; a pair of features counts the product of their vectors, which the identity of the sum's
square gives for all pairs in linear time. Scores are probabilities of the label 1.

Null and empty texts have no words and all statistics zero, and are scored like others. Learned from: labelled rows
that aren't held out, a sample of about SAMPLE of them by the hash of the id; rows that share an id take its least
label, null labels are left out. With no labelled row every score is one half. Repeated rows are scored each; very
long texts whole; further columns are left out or carried along.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import held_out, map_batches

#: Labelled rows learned from, about; hashed words; length of the vectors; rounds over the sample.
SAMPLE, WORDS, RANK, ROUNDS = 6000, 1 << 15, 8, 4
THRESHOLD = 0.7

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "mark": [*b"#$%&*|!<>{}[]=~^_\\@"], "stop": [*b".,;:?'\"()-"], "line": [10, 13], "gap": [9, 11, 12, 32]}
#: Form statistics: shares of the kinds of bytes and of others, and those named in form().
FORMS = len(_KINDS) + 1 + 9


def _kinds():
    import numpy as np

    table = np.full(256, len(_KINDS), np.uint8)
    for k, members in enumerate(_KINDS.values()):
        table[list(members)] = k
    return table


def form(raw: bytes, words: list[bytes], counts: dict[bytes, int], table) -> list[float]:
    """Statistics of the form of a text, each of the order of one."""
    import numpy as np

    shares = np.bincount(table[np.frombuffer(raw, np.uint8)], minlength=len(_KINDS) + 1) / max(1, len(raw))
    n = max(1, len(words))
    most = max(counts.values(), default=0)
    marked = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?'\")")
    shouted = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    single = sum(c for w, c in counts.items() if len(w) == 1 and w.isalpha() is False)
    letters = sum(len(w) * c for w, c in counts.items())
    lines = raw.count(b"\n") + 1
    return [*shares.tolist(), np.log1p(len(raw)) / 10, np.log1p(n) / 10, letters / n / 10, len(counts) / n, most / n, marked / n, shouted / n, single / n, min(n / lines, 200) / 100]


def features(text: str | None, table) -> tuple:
    """(feature numbers, values): the form first, then hashed words."""
    import numpy as np
    from collections import Counter

    raw = (text or "").encode()
    words = raw.split()
    counts = Counter(words)
    at = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % WORDS
    x = np.fromiter(counts.values(), np.float64, len(counts))
    folded = np.bincount(at, x, WORDS) if len(at) > WORDS // 4 else None
    if folded is None:
        at, where = np.unique(at, return_inverse=True)
        x = np.bincount(where, x, len(at)) if len(at) else x
    else:
        at = np.flatnonzero(folded)
        x = folded[at]
    x = x / max(1e-9, np.sqrt((x * x).sum()))
    dense = np.array(form(raw, words, counts, table)) if raw else np.zeros(FORMS)
    return np.concatenate([np.arange(FORMS), at + FORMS]).astype(np.int32), np.concatenate([dense, x]).astype(np.float32)


class Machine:
    def __init__(self):
        import numpy as np

        rng = np.random.default_rng(7)
        self.bias = 0.0
        self.weights = np.zeros(FORMS + WORDS, np.float32)
        self.vectors = (rng.standard_normal((FORMS + WORDS, RANK)) * 0.02).astype(np.float32)
        self.mean, self.scale = np.zeros(FORMS, np.float32), np.ones(FORMS, np.float32)
        self.fitted = False

    def scaled(self, x):
        """Values with the form statistics centred, in units of their spread."""
        import numpy as np

        x = x.copy()
        x[:FORMS] = np.clip((x[:FORMS] - self.mean) / self.scale, -4, 4)
        return x

    def raw(self, at, x) -> tuple[float, object]:
        v = self.vectors[at]
        total = x @ v
        return self.bias + float(self.weights[at] @ x) + 0.5 * float(total @ total - ((x * x) @ (v * v)).sum()), total

    def score(self, at, x) -> float:
        import numpy as np

        if not self.fitted:
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, self.scaled(x))[0], -30, 30))))

    def fit(self, rows: list[tuple]) -> Machine:
        """rows: (feature numbers, values, label). Adaptive gradient descent on the logistic loss."""
        import numpy as np

        if not rows:
            return self
        dense = np.stack([x[:FORMS] for _, x, _ in rows])
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
        rng = np.random.default_rng(11)
        seen_w, seen_v, seen_b = np.full(self.weights.shape, 1e-2, np.float32), np.full(self.vectors.shape, 1e-2, np.float32), 1e-2
        rows = [(at, self.scaled(x), y) for at, x, y in rows]
        rate, decay = 0.1, 1e-4
        for _ in range(ROUNDS):
            for i in rng.permutation(len(rows)):
                at, x, y = rows[i]
                raw, total = self.raw(at, x)
                g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
                gw = g * x + decay * self.weights[at]
                v = self.vectors[at]
                gv = g * (x[:, None] * total - v * (x * x)[:, None]) + decay * v
                seen_b += g * g
                seen_w[at] += gw * gw
                seen_v[at] += gv * gv
                self.bias -= rate * g / np.sqrt(seen_b)
                self.weights[at] -= rate * gw / np.sqrt(seen_w[at])
                self.vectors[at] -= rate * gv / np.sqrt(seen_v[at])
        self.fitted = True
        return self


def learned(docs: DataFrame, labels: DataFrame) -> Machine:
    import numpy as np

    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    share = min(1.0, SAMPLE / max(1, n))
    # about SAMPLE rows of two numbers, however many there are
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches):
        table = _kinds()
        for cols in batches:
            found = [features(t, table) for t in cols["text"]]
            yield {"doc_id": cols["doc_id"], "quality": cols["quality"], "at": [a.tobytes() for a, _ in found], "x": [x.tobytes() for _, x in found]}

    rows = map_batches(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text"), run, "doc_id long, quality int, at binary, x binary")
    got = sorted(((r.doc_id, r.quality, bytes(r.at), bytes(r.x)) for r in rows.collect()))
    return Machine().fit([(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), y) for _, y, a, x in got])


def scored(docs: DataFrame, labels: DataFrame, keep_text: bool = True, learn_from: DataFrame | None = None) -> DataFrame:
    """docs with held_out, score and predicted; learn_from: the documents that the labels are of, docs if it is None."""
    machine = docs.sparkSession.sparkContext.broadcast(learned(docs if learn_from is None else learn_from, labels))
    kept = [f for f in docs.schema if f.name not in ("held_out", "score", "predicted")]
    gone = set() if keep_text else {"text"}
    schema = T.StructType([*(f for f in kept if f.name not in gone), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        table = _kinds()
        for cols in batches:
            score = [machine.value.score(*features(t, table)) for t in cols["text"]]
            yield {k: v for k, v in cols.items() if k not in gone} | {"score": score}

    out = map_batches(docs.select(*(f.name for f in kept), held_out(F.col("doc_id")).alias("held_out")), run, schema)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
