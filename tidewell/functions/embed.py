"""Embeddings: a deterministic hash embedder in column expressions, and an optional model in ONNX form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EmbeddingError


def unit(vector: Column) -> Column:
    """vector over its length; vector and length are computed once each."""
    length = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-9))
    both = F.transform(F.array(vector), lambda v: F.struct(v.alias("v"), length(v).alias("n")))
    return F.element_at(F.transform(both, lambda b: F.transform(b["v"], lambda x: x / b["n"])), 1)


def hash_embed(text: Column, dim: int = 384) -> Column:
    """A unit vector from the text's hash: equal texts get equal vectors, others centred independent ones."""
    seed = F.array(F.xxhash64(text))
    parts = F.element_at(F.transform(seed, lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.xxhash64(h, i).cast("double") / float(1 << 63))), 1)
    return F.transform(unit(parts), lambda x: x.cast("float"))


def hash_model_id(dim: int = 384) -> str:
    return f"hash-{dim}"


def letter_frequencies(text: Column) -> Column:
    """A unit vector of the counts of a to z: small, deterministic and expressible in SQL."""
    low = F.array(F.lower(F.coalesce(text, F.lit(""))))
    counts = F.element_at(F.transform(low, lambda t: F.array(*((F.size(F.split(t, chr(c))) - 1).cast("double") for c in range(97, 123)))), 1)
    return unit(counts)


def normalize(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-9)


def _session(model: str, tokenizer: str, max_tokens: int):
    try:
        import onnxruntime
        from tokenizers import Tokenizer
    except ImportError as e:
        raise EmbeddingError(f"the model runtime is missing: {e}") from e
    tokens = Tokenizer.from_file(tokenizer)
    tokens.enable_truncation(max_tokens)
    tokens.enable_padding()
    return onnxruntime.InferenceSession(model), tokens


def _feed(session, enc: list) -> dict[str, np.ndarray]:
    feed = {"input_ids": [e.ids for e in enc], "attention_mask": [e.attention_mask for e in enc], "token_type_ids": [getattr(e, "type_ids", [0] * len(e.ids)) for e in enc]}
    return {i.name: np.array(feed[i.name], dtype=np.int64) for i in session.get_inputs() if i.name in feed}


def pooled(session, tokens, texts: list[str]) -> np.ndarray:
    """Mean of the last hidden states over the mask, unit length; zeros for a text without tokens."""
    enc = tokens.encode_batch(texts)
    mask = np.array([e.attention_mask for e in enc], dtype=np.int64)
    hidden = session.run(None, _feed(session, enc))[0]
    return normalize((hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1))


def logits(session, tokens, pairs: list[tuple[str, str]]) -> list[float]:
    """Scores of (query, content) pairs: of shape [n], [n, 1], or the second column of wider ones."""
    found = np.asarray(session.run(None, _feed(session, tokens.encode_batch(pairs)))[0])
    return (found if found.ndim == 1 else found[:, 0] if found.shape[1] == 1 else found[:, 1]).astype(float).tolist()


def by_length(texts: list[str], batch: int, max_chars: int) -> list[list[int]]:
    """Places of texts in batches of like length: at most `batch` of them, and at most max_chars when padded to the longest (one text may be longer)."""
    out: list[list[int]] = []
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if not out or len(out[-1]) == batch or len(texts[i]) * (len(out[-1]) + 1) > max_chars:
            out.append([])
        out[-1].append(i)
    return out


def embedded(session, tokens, texts: list[str], batch: int = 32, max_chars: int = 1 << 16) -> np.ndarray:
    """`pooled` of all texts, in their order; batches are of like length, so little is padding."""
    parts = by_length(texts, batch, max_chars)
    found = [pooled(session, tokens, [texts[i] for i in part]) for part in parts]
    back = np.argsort([i for part in parts for i in part], kind="stable")
    return np.concatenate(found)[back] if found else np.zeros((0, 0))


def onnx_embed(model: str, tokenizer: str, max_tokens: int = 512, batch: int = 32):
    """embed(column) -> column: mean pooling over the mask, unit length. The model is loaded once in each Python worker."""

    def run(stream: Iterator[pd.Series]) -> Iterator[pd.Series]:
        session, tokens = _session(model, tokenizer, max_tokens)
        for texts in stream:
            yield pd.Series(embedded(session, tokens, [t or "" for t in texts], batch).astype(np.float32).tolist())

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))


def onnx_rerank_score(model: str, tokenizer: str, max_tokens: int = 512, batch: int = 32):
    """score(query, content) -> column of logits: of shape [n], [n, 1], or the second column of wider ones."""

    def run(stream: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        session, tokens = _session(model, tokenizer, max_tokens)
        for queries, contents in stream:
            out: list = []
            for at in range(0, len(queries), batch):
                out += logits(session, tokens, list(zip(queries.iloc[at : at + batch], contents.iloc[at : at + batch], strict=True)))
            yield pd.Series(out)

    return F.pandas_udf(run, T.DoubleType())
