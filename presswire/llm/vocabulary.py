"""Public vocabularies, read where they are installed; paths are parameters."""

from __future__ import annotations

import base64
import functools

import public_tokenizers

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


@functools.lru_cache(4)
def ranks(path: str = MULTI) -> dict[bytes, int]:
    """Token bytes to rank, of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(4)
def tiktoken_encoding(path: str = MULTI):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(4)
def known_characters(path: str = PIECES) -> frozenset[str]:
    """Characters that a sentencepiece vocabulary with byte fallback has pieces for."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(c for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for c in sp.id_to_piece(i)) | {" "}
