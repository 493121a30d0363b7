"""Subword ids of texts by a byte-level BPE vocabulary, in tasks."""

from __future__ import annotations

import base64
import functools
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Tokenizer files, by public_tokenizers.path: the vocabulary as JSON, and the same as ranks of byte strings.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: The vocabulary's pattern of pieces, without the one rule that looks ahead (of a run of spaces the last goes with what follows):
#: it needs a matcher with backtracking, which takes longer than all the rest. So texts are cut there first.
PIECES = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", "")
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts that match have a blank after another space; the ids of all others are those of their parts, cut before each blank.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RUNS = f"{SPACE} |{re.escape(SPECIAL)}"
CUT = re.compile(f"[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])")


class Encoder:
    """Ids as the JSON vocabulary's tokenizer gives them; texts without its special token go the faster way, by the ranks."""

    def __init__(self, dtype: str = "<u4"):
        import tiktoken

        with open(public_tokenizers.path(RANKS), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.code = np.dtype(dtype).char
        self.sizes = np.zeros(len(ranks), np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))

    def __call__(self, text: str) -> bytes:
        """The text's ids as little-endian bytes of the encoder's dtype."""
        if SPECIAL in text:
            return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        out, at = array(self.code), 0
        for cut in CUT.finditer(text):
            out.extend(self.encode(text[at : cut.end()]))
            at = cut.end()
        out.extend(self.encode(text[at:] if at else text))
        return out.tobytes()


    def parts(self, split: pa.Array, some: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts one after the other, each with a blank before it, and where each begins, and the end.

        Many are encoded as one text. What ends with a space is encoded alone, as its pieces would reach into the next.
        """
        alone = pc.match_substring_regex(split, f"^$|{SPACE}$|{re.escape(SPECIAL)}").to_numpy(zero_copy_only=False)
        bytes_ = pc.binary_length(split).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        count, ids = np.zeros(len(split), np.int64), []
        for a in range(0, len(split), some):
            here = np.arange(a, min(a + some, len(split)))
            together = here[~alone[here]]
            x = np.frombuffer(self("".join(f" {part}" for part in split.take(pa.array(together)).to_pylist())), self.code)
            upto = np.searchsorted(self.sizes[x].cumsum(), bytes_[together].cumsum()) + 1
            count[together] = np.diff(upto, prepend=0)
            others = {k: np.frombuffer(self(f" {split[int(k)].as_py()}"), self.code) for k in here[alone[here]]}
            for k, y in others.items():
                count[k] = len(y)
            if others:
                at = np.concatenate([[0], count[here].cumsum()])
                joined = np.empty(at[-1], "<u2")
                own = np.zeros(at[-1], bool)
                for k, y in others.items():
                    joined[at[k - a] : at[k - a + 1]] = y
                    own[at[k - a] : at[k - a + 1]] = True
                joined[~own] = x
                x = joined
            ids.append(x)
        return np.concatenate([np.zeros(0, "<u2"), *ids]), np.concatenate([[0], count.cumsum()])


@functools.cache
def encoder(dtype: str = "<u4") -> Encoder:
    """One for each Python worker and dtype, kept between its tasks."""
    return Encoder(dtype)


def blanks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different parts of texts between their blanks, and the text and the code of every part, in order."""
    split = pc.split_pattern(texts, " ")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary, np.repeat(np.arange(len(texts)), n), coded.indices.to_numpy()


def ids_of(texts: pa.Array, split: pa.Array, owner: np.ndarray, code: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian bytes of 16 bits; what blanks() gives of the texts is encoded once, as most parts recur."""
    encode = encoder("<u2")
    every, start = encode.parts(split)
    size = np.diff(start)
    first = np.diff(owner, prepend=-1) > 0  # has no blank before it
    out, bounds = [], np.concatenate([np.flatnonzero(first), [len(owner)]])
    runs = pc.match_substring_regex(texts, RUNS).to_pylist()
    for k, run in enumerate(runs):
        if run:
            out.append(encode(texts[k].as_py()))
            continue
        a, b = bounds[k], bounds[k + 1]
        rest = code[a + 1 : b]
        n = size[rest]
        to = n.cumsum()
        at = np.repeat(start[rest] - to + n, n) + np.arange(to[-1] if len(to) else 0)
        out.append(encode(split[int(code[a])].as_py()) + every[at].tobytes())
    return pa.array(out, pa.binary())
