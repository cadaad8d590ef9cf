"""Public tokenizers inside tasks: files by path, one core a task, texts cut where no token can cross.

The files are read where tasks run, as every machine of a cluster that tokenizes has them; their folder is a parameter.
"""

from __future__ import annotations

import os

import numpy as np

FOLDER = "/opt/tokenizers"


def tokenizer(name: str, folder: str = FOLDER, plain_specials: bool = False):
    """A tokenizer of the tokenizers library on one core; plain_specials: strings of special tokens are text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(f"{folder}/{name}")
    found.encode_special_tokens = plain_specials
    return found


def text_slices(texts: list, rows: int = 512, chars: int = 1_000_000):
    """(from, to) of runs of texts of about so many rows or characters, so that memory follows neither."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars or i + 1 - start == rows:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Numbers(dict):
    """Numbers of keys from 0 on, in the order in which they were first asked for; new holds those since it was emptied."""

    def __init__(self):
        super().__init__()
        self.given, self.new = 0, []

    def __missing__(self, key: str) -> int:
        number = self[key] = self.given
        self.given += 1
        self.new.append(key)
        return number

    def of(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for sizes[0] numbers, then from first[1] and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
