"""Places of the public vocabulary files."""

from __future__ import annotations


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
