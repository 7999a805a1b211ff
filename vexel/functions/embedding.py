"""Text embedders behind one protocol, and the column function that applies one.

A model is loaded once for each Python worker, by the embedder's load(); what
travels to the executors is only its description.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import Enum
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from vexel.functions.text import hash_features_batch

#: Rows that an embedder gets at once, and the bytes of text from which it gets fewer.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20

Encode = Callable[[list[str]], np.ndarray]


class Embedder(Protocol):
    dimension: int

    def load(self) -> Encode: ...


class AlternativeModel(str, Enum):
    small = "small"
    large = "large"
    bgem3 = "bgem3"


def masked_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens that the mask keeps: states (batch, tokens, width), mask (batch, tokens)."""
    kept = states * mask[:, :, None]
    return kept.sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic and offline: hashed character n-grams."""

    dimension: int = 64

    def load(self) -> Encode:
        return lambda texts: hash_features_batch(texts, self.dimension).astype(np.float32)


@dataclass(frozen=True)
class OnnxEmbedder:
    """A sentence encoder as an ONNX file that every executor can read at the path."""

    path: str
    dimension: int = 512
    cpu_cores: int | None = None

    def __post_init__(self) -> None:
        if self.cpu_cores is not None and not isinstance(self.cpu_cores, int):
            raise ValueError("the number of CPU cores must be an integer or None")

    def load(self) -> Encode:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        if self.cpu_cores:
            options.inter_op_num_threads = options.intra_op_num_threads = self.cpu_cores
        model = onnxruntime.InferenceSession(self.path, options, providers=["CPUExecutionProvider"])
        source = model.get_inputs()[0].name
        return lambda texts: np.asarray(model.run(None, {source: np.array(texts, dtype=object)})[0], np.float32)


@dataclass(frozen=True)
class TransformerEmbedder:
    """The small, large or bgem3 model, where its library and weights are installed."""

    kind: AlternativeModel = AlternativeModel.bgem3
    max_length: int = 512

    @property
    def dimension(self) -> int:
        return 384 if self.kind is AlternativeModel.small else 1024

    def load(self) -> Encode:
        if self.kind is AlternativeModel.bgem3:
            from FlagEmbedding import BGEM3FlagModel

            dense = BGEM3FlagModel("BAAI/bge-m3")
            return lambda texts: np.asarray(dense.encode(texts, max_length=self.max_length)["dense_vecs"], np.float32)
        import torch
        from transformers import AutoModel, AutoTokenizer

        name = f"intfloat/multilingual-e5-{self.kind.value}"
        tokenizer, model = AutoTokenizer.from_pretrained(name), AutoModel.from_pretrained(name)

        def encode(texts: list[str]) -> np.ndarray:
            batch = tokenizer([f"passage {t}" for t in texts], max_length=self.max_length, padding=True, truncation=True, return_tensors="pt")
            with torch.no_grad():
                states = model(**batch).last_hidden_state.numpy()
            pooled = masked_mean(states, batch["attention_mask"].numpy())
            return pooled / np.linalg.norm(pooled, axis=1, keepdims=True)

        return encode


def embedding_model(use_quantized_onnx_model: bool = True, alternative_model: AlternativeModel = AlternativeModel.bgem3, onnx_path: str | None = None, onnx_model_cpu_core_count: int | None = None, e5_model_size: AlternativeModel | None = None) -> Embedder:
    """The embedder that the options choose; e5_model_size, where given, overrides the alternative model."""
    if onnx_model_cpu_core_count is not None and not isinstance(onnx_model_cpu_core_count, int):
        raise ValueError("the number of CPU cores must be an integer or None")
    if use_quantized_onnx_model:
        if onnx_path is None:
            raise ValueError("the ONNX model needs the path of its file")
        return OnnxEmbedder(onnx_path, cpu_cores=onnx_model_cpu_core_count)
    return TransformerEmbedder(AlternativeModel(e5_model_size or alternative_model))


def _encoded(encode: Encode, texts: pa.Array) -> pa.Array:
    """The texts' embeddings as lists, encoded a slice at a time."""
    parts, start = [], 0
    while start < len(texts):
        rows = min(SLICE_ROWS, len(texts) - start)
        while rows > 1 and texts.slice(start, rows).nbytes > SLICE_BYTES:
            rows //= 2
        parts.append(np.asarray(encode([t or "" for t in texts.slice(start, rows).to_pylist()]), np.float32))
        start += rows
    sizes = np.repeat([0, *(p.shape[1] for p in parts)], [1, *(len(p) for p in parts)])
    values = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values))


def embed(text: Column, embedder: Embedder) -> Column:
    """The embedding of a text column; null texts count as empty. An embedder gets few rows or few bytes of text at once, whatever the Arrow batch holds."""

    @arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = embedder.load()
        for texts in batches:
            yield _encoded(encode, texts)

    return run(text)


def extract_embeddings(text: str, embedder: Embedder) -> np.ndarray:
    """The embedding of one text, on the driver."""
    return embedder.load()([text])[0]
