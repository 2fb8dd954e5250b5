"""Tokenizers by the path of their vocabulary file. The files are never part of this repository."""

from __future__ import annotations

import hashlib
import os


def public_path(name: str) -> str:
    """A vocabulary of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's own object: tokenizers for .json, sentencepiece for .model."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=path)
    raise ValueError(f"no tokenizer library for {path}")


def version(path: str) -> str:
    """Digest of the vocabulary file and the library's version: counts stored under another one are never used."""
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    digest.update(f"{library.__name__} {library.__version__}".encode())
    return digest.hexdigest()
