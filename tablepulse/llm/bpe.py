"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

The ids are the library's. They are worked out by tiktoken's engine, several times faster, on the vocabulary
of the same file (its ids are the ranks of its merges); texts that hold the string of a special token, or a run
of white space that is too long for that engine, go to the library itself.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

import numpy as np

#: Fixed value: how byte-level BPE cuts a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level files write printable bytes as themselves, and the others as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """``ids`` of a text are those of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = _bytes_of_characters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
        self.engine = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def sizes(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for."""
        out = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for i in range(self.engine.max_token_value + 1):
            out[i] = len(self.engine.decode_single_token_bytes(i))
        for token in self.special:
            out[self.tokenizer.token_to_id(token)] = len(token.encode())
        return out

    def ids(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        if not text:
            return np.zeros(0, np.uint32)
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.plain(text)

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text that holds no special token."""
        try:
            return self.engine.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its pattern backtracks, which a run of a million blanks is too much for
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder of a file for each Python process."""
    return Encoder(path)
