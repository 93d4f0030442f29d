"""Places of public tokenizer files."""

from __future__ import annotations

import os


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """``name`` in ``folder``, or where the installed package of public tokenizers keeps it."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    """The pattern by which the byte-level vocabularies part a text before merging."""
    import public_tokenizers

    return public_tokenizers.PATTERN
