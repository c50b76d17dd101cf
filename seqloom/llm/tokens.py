"""A public tokenizer inside tasks. The vocabulary's path is a parameter; nothing of it is kept in the repository."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Callable

from pyspark import SparkFiles
from pyspark.sql import SparkSession

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: The byte-level BPE's published pre-tokenization pattern (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(path: str | None = None) -> str:
    """The given path, else $SEQLOOM_TOKENIZER, else the vocabulary of the installed public_tokenizers package; without any of them an error."""
    path = path or os.environ.get("SEQLOOM_TOKENIZER")
    if path:
        return path
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.origin:
        raise FileNotFoundError("give the vocabulary's path or set SEQLOOM_TOKENIZER")
    return os.path.join(os.path.dirname(spec.origin), DEFAULT_VOCABULARY)


def shipped(spark: SparkSession, path: str | None = None) -> Callable[[], str]:
    """Send the vocabulary, which only the driver needs to have, to all executors; what is returned finds it in a task."""
    path = vocabulary_path(path)
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: SparkFiles.get(name)


@functools.cache
def encoder(path: str):
    """The tokenizer, loaded once in a Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def token_lengths(path: str):
    """The number of bytes of each token id."""
    import numpy as np

    enc = encoder(path)
    out = np.zeros(enc.n_vocab + 1, dtype=np.int64)
    for i in range(enc.n_vocab):
        try:
            out[i] = len(enc.decode_single_token_bytes(i))
        except KeyError:  # an id the vocabulary leaves free
            pass
    return out


def clean(text: str) -> str:
    """Text that can be encoded as UTF-8: lone surrogates become U+FFFD."""
    return text.encode("utf-8", "replace").decode("utf-8", "replace")
