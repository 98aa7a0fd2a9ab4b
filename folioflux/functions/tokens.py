"""Token counters from vocabulary files; the files' path is the caller's."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

#: Pieces that byte-pair merges stay within.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_counter(path: str, pattern: str = PIECES) -> Callable[[str], int]:
    """A counter for chunkers by byte-pair ranks from a file, which every executor must be able to open; it is read once a process."""
    return lambda text: len(_encoding(path, pattern).encode_ordinary(text))
