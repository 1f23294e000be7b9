"""Token ids of a public byte-level BPE vocabulary.

The ids are those of the tokenizers library with the vocabulary file. Texts
made only of characters for which both libraries are known to agree (see
tests) go through tiktoken with the same vocabulary as ranks, which needs a
quarter of the time; all others go through tokenizers itself.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Sequence

import numpy as np

#: Printable ASCII, TAB, LF, CR and Latin letters with their punctuation.
AGREED = re.compile("[\t\n\r -~¡-¬®-ɏ‐-‧€]*")

#: Split pattern of the vocabulary. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MARK = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """path: the vocabulary's JSON file; ranks: the same vocabulary as ranks, if there
    is one (by default the file of the same name beside it)."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        ranks = ranks or os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self.size = self.slow.get_vocab_size()

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and MARK not in text and AGREED.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode_all(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        return [self.encode(t) if t else np.zeros(0, np.uint32) for t in texts]

    @functools.cached_property
    def ends_sentence(self) -> np.ndarray:
        """For each id: whether its text ends a sentence or a line."""
        out = np.zeros(self.size, bool)
        for token, i in self.slow.get_vocab().items():
            out[i] = token.endswith((".", "!", "?", "Ċ"))
        return out


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
