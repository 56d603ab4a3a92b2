"""Where a vocabulary file lies, on the driver or an executor."""

from __future__ import annotations

import os


def find(name: str) -> str:
    """A path as it is, or the place of a file of the public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def library(name: str):
    """The tokenizers library's encoder of a .json vocabulary, single-threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(find(name))
