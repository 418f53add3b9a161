"""Toxicity by a linear-chain conditional random field over tokens.

Tokens are runs of digits, letters and bytes of other characters, lower-case A-Z. Two states, clean
and toxic; a token's features are its word and its beginnings of 4 to 7 bytes, hashed; transitions
are learned. A chain is a whole document; it is worked on in pieces of ``PIECE`` tokens, between which
the messages of both directions are carried. Documents alone carry labels, so token labels are derived on the training rows: a token is toxic if its document is marked
and one of its features occurs in far more marked than clean documents. The field is trained on
those, by gradient steps on the exact log-likelihood (forward-backward). A document's score is a
logistic function of what its tokens' marginals come to (the largest, and the logarithm of the
expected number of toxic tokens), fitted on the training rows and weighed back to the true share.

Fitted on a bounded sample of labelled rows: about ``fit_rows`` documents of either label and of at
most ``fit_bytes`` of text, chosen by a hash of their id. Of rows that share an id one is taken, and
near copies (equal least word-shingle hash) count once. What reaches the driver are hashes of the
sampled tokens. Scoring needs one row at a time and shuffles nothing.

Defined cases: a null, empty or wordless text has no toxic token and gets the score that this comes
to; a null label teaches nothing; without marked or clean training rows every score is 0; of several
labels of one document each counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .shared import fold_is, stage, unit_hash

U = np.uint64
PIECE = 128
FIT_ROWS = 1200
FIT_BYTES = 1 << 16
_SIZE = 1 << 18
_STARTS = (4, 5, 6, 7)
_WIDTH = 1 + len(_STARTS)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features uint32 [tokens, 5], document, start, end) of a block; words shorter than a beginning
    have the word's own feature in its place."""
    starts, ends, doc = tb.words(data, offsets, tb.ALNUM)
    low = tb.LOWER[data]
    out = np.empty((len(starts), _WIDTH), np.uint32)
    shift = U(64 - 18)
    out[:, 0] = tb.xxh64(low, starts, ends) >> shift
    for k, n in enumerate(_STARTS, 1):
        cut = np.minimum(starts + n, ends)
        h = tb.mix(tb.xxh64(low, starts, cut) + U(n)) >> shift
        out[:, k] = np.where(ends - starts >= n, h, out[:, 0])
    return out, doc, starts, ends


def pieces(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place in it) of each token, and which pieces follow another of their document."""
    count = np.bincount(doc, minlength=n_docs)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    per = -(-count // PIECE)
    first = np.cumsum(per) - per
    follows = np.ones(int(per.sum()), bool)
    follows[first[per > 0]] = False
    return np.repeat(first, count) + within // PIECE, within % PIECE, follows


class Field:
    """The parameters: a weight for each feature (toxic over clean), three of transitions, and a start."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: float):
        self.weights, self.moves, self.start = weights, moves, start  # moves: clean-toxic, toxic-clean, toxic-toxic over clean-clean
        self.logistic = np.array([0.0, 0.0, 0.0])

    def emissions(self, features: np.ndarray) -> np.ndarray:
        x = self.weights[features]
        return x.sum(axis=1)


def _step(odds: np.ndarray, message: np.ndarray, enter: float, leave: float, stay: float) -> np.ndarray:
    """The message behind a token: forward with (up, down), backward with (down, up)."""
    return odds * (enter + stay * message) / (1 + leave * message)


def _through(odds: np.ndarray, enter: float, leave: float, stay: float):
    """All steps of [places, pieces] as one fractional-linear map for each piece."""
    a, b, c, d = (np.full(odds.shape[1], x) for x in (1.0, 0.0, 0.0, 1.0))
    for e in odds:
        a, b, c, d = e * (enter * c + stay * a), e * (enter * d + stay * b), c + leave * a, d + leave * b
        scale = 1 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    return lambda k, x: (a[k] * x + b[k]) / (c[k] * x + d[k])


def _carried(odds: np.ndarray, length: np.ndarray, follows: np.ndarray, moves: tuple, begin: float) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the forward message behind the piece before it, and the backward message of the
    piece after it; zero where there is none."""
    up, down, stay = moves
    n = len(follows)
    alpha, beta = np.zeros(n), np.zeros(n)
    later = np.flatnonzero(follows)
    if not len(later):
        return alpha, beta
    before = later - 1  # these are full
    # rank of each piece in its document, so that one step takes all documents
    rank = np.arange(n) - np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    order = later[np.argsort(rank[later], kind="stable")]
    cuts = np.flatnonzero(np.diff(rank[order], prepend=0, append=n + 1))
    number = np.full(n, -1)
    number[before] = np.arange(len(before))
    ahead = _through(odds[1:, before], up, down, stay)
    for a, z in zip(cuts, cuts[1:], strict=False):
        k = order[a:z] - 1
        entry = np.where(follows[k], _step(odds[0, k], alpha[k], up, down, stay), odds[0, k] * begin)
        alpha[k + 1] = ahead(number[k], entry)
    back = _through(odds[-2::-1, before], down, up, stay)
    last = later[~np.append(follows, False)[later + 1]]  # ends of documents
    message = odds[length[last] - 1, last]
    for t in range(int(length[last].max()) - 2, -1, -1):
        on = length[last] - 1 > t
        message = np.where(on, _step(odds[t, last], message, down, up, stay), message)
    out = np.zeros(n)  # the message of each piece to the one before it
    out[last] = message
    for a, z in reversed(list(zip(cuts, cuts[1:], strict=False))):
        k = order[a:z] - 1
        beta[k] = out[k + 1]
        out[k] = back(number[k], _step(odds[-1, k], beta[k], down, up, stay))
    return alpha, beta


def forward_backward(emit: np.ndarray, length: np.ndarray, moves: np.ndarray, start: float, follows: np.ndarray | None = None):
    """Toxic marginals [pieces, places], pair marginals of the three moves (summed), and log Z, which
    adds up over the pieces of a document.

    ``emit`` holds the log-odds of each token; places at or beyond ``length`` are ignored. A piece
    that ``follows`` goes on from the full piece before it. Messages are odds (toxic over clean), so
    each step is one fractional-linear map.
    """
    n, steps = emit.shape
    odds = np.exp(np.clip(emit, -30, 30)).T.copy()  # [places, pieces]
    up, down, stay = np.exp(moves)
    follows = np.zeros(n, bool) if follows is None else follows
    followed = np.append(follows[1:], False)
    live = np.arange(steps)[:, None] < length[None, :]
    come, go = _carried(odds, length, follows, (up, down, stay), float(np.exp(start)))
    alpha, beta = np.empty_like(odds), np.ones_like(odds)
    log_z = np.where(follows, np.log1p(come * down), 0.0)
    alpha[0] = np.where(follows, _step(odds[0], come, up, down, stay), odds[0] * np.exp(start))
    for t in range(1, steps):
        a = alpha[t - 1]
        alpha[t] = _step(odds[t], a, up, down, stay)
        log_z += np.where(live[t], np.log1p(a * down), 0)
    last = np.maximum(length - 1, 0)
    log_z += np.where(followed, 0, np.log1p(alpha[last, np.arange(n)]))
    beta[steps - 1] = np.where(followed, _step(1.0, go, down, up, stay), 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(live[t + 1], _step(1.0, np.where(live[t + 1], odds[t + 1] * beta[t + 1], 0), down, up, stay), 1)
    both = alpha * beta
    marginal = np.where(live, both / (1 + both), 0).T
    # pairs (t, t + 1): clean-clean 1, clean-toxic up b, toxic-clean a down, toxic-toxic a stay b
    a, b = np.concatenate([alpha[:-1].ravel(), come]), np.concatenate([(odds[1:] * beta[1:]).ravel(), odds[0] * beta[0]])
    total = 1 + up * b + a * (down + stay * b)
    on = np.concatenate([live[1:].ravel(), follows])
    pairs = np.array([(np.where(on, x / total, 0)).sum() for x in (up * b, a * down, a * stay * b)])
    return marginal, pairs, log_z


def _padded(values: np.ndarray, piece: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, PIECE))
    out[piece, place] = values
    return out


def token_labels(features: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which tokens count as toxic: those of marked documents with a feature that tells."""
    marked = labels > 0
    pair = np.unique(doc[:, None].astype(np.int64) * _SIZE + features)
    df = [np.bincount(pair[marked[pair // _SIZE] == m] % _SIZE, minlength=_SIZE) for m in (False, True)]
    n = [max(1, int((marked == m).sum())) for m in (False, True)]
    lift = ((df[1] + 0.5) / (n[1] + 1)) / ((df[0] + 0.5) / (n[0] + 1))
    telling = (lift > 12) & (df[1] >= max(3, 0.012 * n[1]))
    return marked[doc] & telling[features].any(axis=1)


class Likelihood:
    """The penalised log-likelihood of token labels, and its slope; ``local`` are features from 0 on."""

    def __init__(self, local: np.ndarray, doc: np.ndarray, n_docs: int, toxic: np.ndarray, ridge: float):
        self.local, self.toxic, self.n_docs, self.ridge, self.size = local, toxic, n_docs, ridge, int(local.max()) + 1
        self.piece, self.place, self.follows = pieces(doc, n_docs)
        self.length = np.bincount(self.piece, minlength=len(self.follows))
        self.begins = np.concatenate(([True], doc[1:] != doc[:-1]))
        x, y = toxic[:-1][~self.begins[1:]], toxic[1:][~self.begins[1:]]
        self.pairs = np.array([(~x & y).sum(), (x & ~y).sum(), (x & y).sum()], float)

    def at(self, params: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and slope at (weights, three moves, start)."""
        w, moves, start = params[:-4], params[-4:-1], params[-1]
        emit = w[self.local].sum(axis=1)
        marginal, pairs, log_z = forward_backward(_padded(emit, self.piece, self.place, len(self.follows)), self.length, moves, start, self.follows)
        gap = self.toxic - marginal[self.piece, self.place]
        value = emit[self.toxic].sum() + moves @ self.pairs + start * self.toxic[self.begins].sum() - log_z.sum()
        slope = np.concatenate([np.bincount(self.local.ravel(), weights=np.repeat(gap, self.local.shape[1]), minlength=self.size), self.pairs - pairs, [gap[self.begins].sum()]])
        slope[:-4] -= self.ridge * self.n_docs * w
        return value - self.ridge * self.n_docs / 2 * (w @ w), slope


def train_field(features: np.ndarray, doc: np.ndarray, labels: np.ndarray, steps: int = 60, ridge: float = 2e-3) -> tuple[Field, np.ndarray]:
    """The field, and the token labels derived for it."""
    toxic = token_labels(features, doc, labels)
    used, local = np.unique(features, return_inverse=True)
    likelihood = Likelihood(local.reshape(features.shape), doc, len(labels), toxic, ridge)
    params = np.zeros(len(used) + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        grad = likelihood.at(params)[1] / max(1, len(labels))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        params[-4:-1] = np.clip(params[-4:-1], -8, 8)
    weights = np.zeros(_SIZE, np.float32)
    weights[used] = params[:-4]
    return Field(weights, params[-4:-1].copy(), float(params[-1])), toxic


def marginals(field: Field, features: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The marginal probability of each token to be toxic; tokens come by document."""
    if not len(doc):
        return np.zeros(0)
    piece, place, follows = pieces(doc, n_docs)
    length = np.bincount(piece, minlength=len(follows))
    marginal, _, _ = forward_backward(_padded(field.emissions(features), piece, place, len(follows)), length, field.moves, field.start, follows)
    return marginal[piece, place]


def evidence(p: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """[documents, 3]: one, the largest marginal, and log(1 + expected toxic tokens)."""
    out = np.ones((n_docs, 3))
    out[:, 1] = 0
    np.maximum.at(out[:, 1], doc, p)
    out[:, 2] = np.log1p(np.bincount(doc, weights=p, minlength=n_docs))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * w * [0, 1, 1]
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.diag([1e-6, 1, 1])
        w = w + np.clip(np.linalg.solve(hess, grad), -4, 4)
    return w


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", usable=None, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Field | None:
    """A field of the labelled rows that ``usable`` (a condition on the labels' rows) admits."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = (known if usable is None else known.where(usable)).select(F.col(doc_id).alias("__id"), (F.col(label) > 0).cast("int").alias("__y")).distinct()
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    at = unit_hash(23, "__id")
    # staged, so that Catalyst knows how small it is and never shuffles the texts for it
    sample = stage(known.where(at < F.when(F.col("__y") == 1, F.lit(fit_rows / counts[1])).otherwise(F.lit(fit_rows / counts[0]))), "sample")

    def tokens(batches):
        for block in tb.blocks(batches, "text"):
            data, offsets = tb.utf8(block.column(1))
            features, doc, _, _ = token_features(data, offsets)
            edge = np.searchsorted(doc, np.arange(block.num_rows + 1))
            rows, copy = [], []
            for k in range(block.num_rows):
                f = features[edge[k] : edge[k + 1]]
                rows.append(f.tobytes())
                w = f[:, 0].astype(U)
                w = tb.mix(w[:-2] + (w[1:-1] << U(18)) + (w[2:] << U(36))) if len(w) > 2 else w
                copy.append(int(w.min() >> U(1)) if len(w) else 0)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(copy, pa.int64()), block.column(2), pa.array(rows, pa.binary())], names=["y", "copy", "at", "tokens"])

    short = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= fit_bytes)
    # of an id's rows, however many, one is taken, by task before the shuffle, and only then made to tokens
    own = short.join(sample.select("__id").distinct(), F.col(doc_id) == F.col("__id")).select("__id", F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("text")).alias("x"))
    one = own.groupBy("__id").agg(F.min("x").alias("x")).join(sample, "__id")
    joined = one.select(F.col("__y").alias("y"), F.col("x.text").alias("text"), unit_hash(23, "__id").alias("at"))
    rows = joined.mapInArrow(tokens, "y int, copy long, at double, tokens binary").toPandas().sort_values(["y", "at", "copy"])
    rows = rows.drop_duplicates(["y", "copy"]).reset_index(drop=True)
    held = [np.frombuffer(t, np.uint32).reshape(-1, _WIDTH) for t in rows.tokens]
    doc = np.repeat(np.arange(len(rows)), [len(t) for t in held])
    y = rows.y.to_numpy()
    if not len(doc) or not y.any() or y.all():
        return None
    features = np.concatenate(held)
    field, _ = train_field(features, doc, y)
    share = counts[1] / (counts[0] + counts[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    field.logistic = _logistic(evidence(marginals(field, features, doc, len(y)), doc, len(y)), y, weight)
    return field


def score(docs: DataFrame, field: Field | None, *, text: str = "text", keep: list[str] | None = None, spans: float | None = None) -> DataFrame:
    """Adds score and predicted to the ``keep`` columns (all by default); with ``spans`` also the
    toxic spans: (start, end, p) in bytes of the text, of each run of tokens whose marginals reach it."""
    keep = docs.columns if keep is None else keep
    cast = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        f = cast.value
        for block in tb.blocks(batches, -1):
            n = block.num_rows
            data, offsets = tb.utf8(block.column(block.num_columns - 1))
            features, doc, start, end = token_features(data, offsets)
            p = marginals(f, features, doc, n) if f else np.zeros(len(doc))
            s = 1 / (1 + np.exp(-np.clip(evidence(p, doc, n) @ f.logistic, -30, 30))) if f else np.zeros(n)
            columns, names = [*block.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*block.schema.names[:-1], "score", "predicted"]
            if spans is not None:
                found = [[] for _ in range(n)]
                hit = np.flatnonzero(p >= spans)
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (doc[hit[1:]] != doc[hit[:-1]])
                for a, z in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hit)), strict=True):
                    d = doc[hit[a]]
                    found[d].append({"start": int(start[hit[a]] - offsets[d]), "end": int(end[hit[z - 1]] - offsets[d]), "p": float(p[hit[a:z]].max())})
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    if spans is not None:
        schema = schema.add("spans", SPANS)
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = fold_is("doc_id", 5, 0)
    field = fit(docs, labels, usable=~held)
    return score(docs.withColumn("held_out", held), field, keep=["doc_id", "held_out"])
