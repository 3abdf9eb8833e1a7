"""Where the files of public tokenizers are."""

from __future__ import annotations

import os


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file: in the folder AUDITLOOM_TOKENIZERS if that is set, else where the vocabularies are installed."""
    if folder := os.environ.get("AUDITLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
