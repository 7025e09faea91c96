"""Quality scores by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 512, 32  # bytes of a chunk, and how many of them the next chunk repeats
WIDTH, STRIDE, FILTERS, HIDDEN = 6, 2, 32, 16
PAD = 256  # the value that fills chunks of short texts
SAMPLE = 4000  # labelled documents that the fit may use
SAMPLE_CHUNKS = 6  # chunks of each of them, spread over the whole text
AT_ONCE = 512  # chunks in one forward step


def held_out(id: Column) -> Column:
    """Documents that no label may be learned from."""
    return F.crc32(id.cast("string")) % 3 == 1


def chunk_starts(n: int) -> range | list[int]:
    """Starts of the chunks of ``n`` bytes: every byte is covered, and the last chunk ends with the text."""
    if n <= CHUNK:
        return [0]
    return [*range(0, n - CHUNK, CHUNK - OVERLAP), n - CHUNK]


def chunk_matrix(texts: list[bytes], starts: list[list[int]]) -> np.ndarray:
    out = np.full((sum(map(len, starts)), CHUNK), PAD, dtype=np.int16)
    row = 0
    for text, places in zip(texts, starts):
        for at in places:
            part = np.frombuffer(text, dtype=np.uint8, count=min(CHUNK, len(text) - at), offset=at)
            out[row, : len(part)] = part
            row += 1
    return out


def _convolve(filters: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Filter responses (chunk, place, filter): the sum of each filter's weight for the byte at every offset."""
    places = (CHUNK - WIDTH) // STRIDE + 1
    total = None
    for j in range(WIDTH):
        part = np.take(filters[j], chunks[:, j : j + STRIDE * places : STRIDE], axis=0)
        total = part if total is None else np.add(total, part, out=total)
    return total


def _features(model: dict, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    responses = _convolve(model["filters"], chunks)
    best = responses.argmax(axis=1)
    return np.take_along_axis(responses, best[:, None, :], axis=1)[:, 0, :], best


def _filled(chunks: np.ndarray) -> np.ndarray:
    return (chunks != PAD).mean(axis=1, dtype=np.float32)[:, None]


def chunk_logits(model: dict, chunks: np.ndarray) -> np.ndarray:
    pooled = _convolve(model["filters"], chunks).max(axis=1)
    x = np.concatenate([np.maximum(pooled + model["bias"], 0), _filled(chunks)], axis=1)
    return np.maximum(x @ model["inner"] + model["inner_bias"], 0) @ model["outer"] + model["outer_bias"]


def document_features(logits: np.ndarray) -> list[float]:
    """What the last layer sees of a document: mean, lowest and highest logit of its chunks."""
    return [float(logits.mean()), float(logits.min()), float(logits.max()), 1.0]


def train(chunks: np.ndarray, document: np.ndarray, label: np.ndarray, epochs: int = 8, seed: int = 7) -> dict:
    """Fits the network on chunks that carry their document's label, then the last layer on whole documents.

    ``document`` numbers each chunk's document, ``label`` is by document.  Adam on the logistic loss; the
    gradient of a pooled filter goes to the place of its maximum only.  Without samples every score is 0.5.
    """
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    model = {"filters": f32(WIDTH, PAD + 1, FILTERS, scale=0.3), "bias": np.zeros(FILTERS, np.float32), "inner": f32(FILTERS + 1, HIDDEN, scale=0.2),
             "inner_bias": np.zeros(HIDDEN, np.float32), "outer": f32(HIDDEN, scale=0.2), "outer_bias": np.zeros(1, np.float32)}
    model["filters"][:, PAD] = 0
    model["last"] = np.zeros(4)
    if not len(chunks):
        return model
    fitted = [k for k in model if k != "last"]
    moments = {k: (np.zeros_like(model[k]), np.zeros_like(model[k])) for k in fitted}
    y = label[document].astype(np.float32)
    step, batch = 0, 128
    for epoch in range(epochs):
        order = rng.permutation(len(chunks))
        rate = 0.01 * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, n = chunks[rows], len(rows)
            pooled, best = _features(model, x)
            a = np.maximum(pooled + model["bias"], 0)
            xa = np.concatenate([a, _filled(x)], axis=1)
            hidden = np.maximum(xa @ model["inner"] + model["inner_bias"], 0)
            error = ((1 / (1 + np.exp(-np.clip(hidden @ model["outer"] + model["outer_bias"], -30, 30))) - y[rows]) / n).astype(np.float32)
            back = np.outer(error, model["outer"]) * (hidden > 0)
            down = (back @ model["inner"].T)[:, :FILTERS] * (a > 0)
            grads = {"outer": hidden.T @ error, "outer_bias": error.sum(keepdims=True), "inner": xa.T @ back, "inner_bias": back.sum(axis=0), "bias": down.sum(axis=0), "filters": np.zeros_like(model["filters"])}
            for j in range(WIDTH):
                byte = np.take_along_axis(x, best * STRIDE + j, axis=1)
                flat = byte.astype(np.int64) * FILTERS + np.arange(FILTERS)
                grads["filters"][j] = np.bincount(flat.ravel(), weights=down.ravel(), minlength=(PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
            step += 1
            for k in fitted:
                m, v = moments[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                model[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    logits = np.concatenate([chunk_logits(model, chunks[i : i + AT_ONCE]) for i in range(0, len(chunks), AT_ONCE)])
    cuts = np.flatnonzero(np.diff(document)) + 1
    seen = document[np.r_[0, cuts]]
    table = np.array([document_features(part) for part in np.split(logits, cuts)])
    model["last"] = _logistic(table, label[seen].astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a small logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> dict:
    """Fits on at most ``sample`` labelled documents that are not held out, in the order of a hash of their id, with
    ``SAMPLE_CHUNKS`` chunks each from places over the whole text.  Null labels, ids and texts train nothing."""
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    chosen = known.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for value in batch.column(2):
                raw = value.as_py().encode()
                starts = chunk_starts(len(raw))
                picked = starts if len(starts) <= SAMPLE_CHUNKS else [starts[i * (len(starts) - 1) // (SAMPLE_CHUNKS - 1)] for i in range(SAMPLE_CHUNKS)]
                parts.append([raw[at : at + CHUNK] for at in picked])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.binary()))], names=["id", "label", "parts"])

    joined = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")  # at most ``sample`` narrow rows
    got = joined.mapInArrow(run, f"id {joined.schema[0].dataType.simpleString()}, label int, parts array<binary>").toArrow()
    rows = sorted(zip(got["id"].to_pylist(), got["label"].to_pylist(), got["parts"].to_pylist()))[:sample]
    parts = [bytes(p) for _, _, ps in rows for p in ps]
    document = np.array([i for i, (_, _, ps) in enumerate(rows) for _ in ps], dtype=np.int64)
    return train(chunk_matrix(parts, [[0]] * len(parts)), document, np.array([y for _, y, _ in rows], dtype=np.int64))


def score(docs: DataFrame, model: dict, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``score`` (probability of label 1) of every row: all chunks of the whole text are read, a bounded
    number at a time.  Null and empty texts are one empty chunk; repeated rows are scored again; an empty table
    gives none; other columns are not read, and nothing but the text enters the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            texts, starts, owners, held = [], [], [], 0
            logits: dict[int, list[np.ndarray]] = {}

            def flush() -> None:
                values = chunk_logits(model, chunk_matrix(texts, starts))
                at = 0
                for i, places in zip(owners, starts):
                    logits.setdefault(i, []).append(values[at : at + len(places)])
                    at += len(places)

            for i, value in enumerate(batch.column(0)):
                raw = (value.as_py() or "").encode()
                places = chunk_starts(len(raw))
                for at in range(0, len(places), AT_ONCE):
                    texts.append(raw)
                    starts.append(places[at : at + AT_ONCE])
                    owners.append(i)
                    held += len(starts[-1])
                    if held >= AT_ONCE:
                        flush()
                        texts, starts, owners, held = [], [], [], 0
            if held:
                flush()
            for i, parts in logits.items():
                z = np.dot(document_features(np.concatenate(parts)), model["last"])
                scores[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], names=[*keep, "score"])

    rows = docs.select(F.col(text).alias("_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, score double")
