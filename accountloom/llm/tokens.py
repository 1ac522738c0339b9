"""Token ids of whole text columns, one Arrow batch at a time.

The tokenizer file's own model encodes every distinct word once per worker; a
batch then gathers the ids of its words by position.  A byte-level tokenizer cuts
a text in front of every space that a visible character follows, so the ids of a
text are those of its space-separated parts, in order.  Texts with a space before
other white space or with an added token such as ``<|endoftext|>``, and parts outside the
Latin blocks, go to the tokenizer whole.
"""

from __future__ import annotations

import functools
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# FIXED VALUES: the split pattern of this kind of tokenizer and its byte alphabet.
BYTE_LEVEL_SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                    r"|\s+(?!\S)|\s+")
PRINTABLE_BYTES = (range(33, 127), range(161, 173), range(174, 256))

ODD_SPACE = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
STOPS = ".,;:!?"
MEMO_LETTERS = 64


def _byte_alphabet() -> str:
    """The character that stands for each byte, in byte order."""
    shown = {b for r in PRINTABLE_BYTES for b in r}
    hidden = [b for b in range(256) if b not in shown]
    place = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
    return "".join(chr(place[b]) for b in range(256))


class BatchEncoder:
    """Ids of text columns by one tokenizer file; equal to its ``encode_batch``.

    ``memo_limit`` bounds the words a worker remembers, in two generations of words of up
    to ``MEMO_LETTERS`` characters; a word that is forgotten is encoded again, which
    changes nothing else.
    """

    def __init__(self, path: str, memo_limit: int = 300_000) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold an added token, as text, are encoded whole: the library cuts there first
        added = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD_SPACE, *added])
        self.model = self.tokenizer.model
        self.split = regex.compile(BYTE_LEVEL_SPLIT).findall
        self.alphabet = _byte_alphabet()
        self.limit = memo_limit
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def _recall(self, key: str) -> bytes | None:
        found = self.memo.get(key)
        if found is None:
            found = self.older.get(key)
            if found is not None:
                self.memo[key] = found
        return found

    def _remember(self, key: str, ids: bytes) -> None:
        if len(key) <= MEMO_LETTERS:
            self.memo[key] = ids

    def _piece(self, piece: str) -> bytes:
        found = self._recall(piece)
        if found is None:
            shown = charmap_decode(piece.encode(), "strict", self.alphabet)[0]
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            self._remember(piece, found)
        return found

    def _part(self, part: str) -> bytes:
        found = self._recall(part)
        if found is None:
            word = part.rstrip(STOPS)
            try:
                part.encode("latin-1")
            except UnicodeEncodeError:
                found = self._whole(part)
            else:
                if part[:1] == " " and word[1:].isalpha():  # one word, perhaps with stops behind it
                    found = self._piece(word)
                    return found + self._piece(part[len(word):]) if len(word) < len(part) else found
                found = b"".join([self._piece(p) for p in self.split(part)])
            self._remember(part, found)
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)``: the ids of row i are ``ids[offsets[i]:offsets[i + 1]]``."""
        if len(self.memo) > self.limit:  # what is not met again in a generation is forgotten
            self.older, self.memo = self.memo, {}
        # a fresh copy: some kernels misread arrays that are slices of others
        texts = pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), ""), pa.array([""], pa.large_string())])
        texts = texts.slice(0, len(column))
        rows = len(texts)
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        if len(odd):
            mask = np.zeros(rows, bool)
            mask[odd] = True
            whole = [self._whole(texts[int(i)].as_py()) for i in odd]
            texts = pc.replace_with_mask(texts, pa.array(mask),
                                         pa.array([""] * len(odd), pa.large_string()))
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.flatten()
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy().astype(np.int64)
        known = [self._part(" " + w) for w in words]
        first = bounds[:-1]  # a split text has one part at least
        heads = [self._part(words[i]) for i in index[first].tolist()]
        if len(odd):
            for i, ids in zip(odd.tolist(), whole):
                heads[i] = ids
        index[first] = len(known) + np.arange(rows)
        known += heads
        lengths = np.fromiter((len(k) >> 2 for k in known), np.int64, len(known))
        pool = np.frombuffer(b"".join(known), "<u4")
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        per_part = lengths[index]
        ends = np.cumsum(per_part)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[index] - (ends - per_part), per_part) + np.arange(total)
        upto = np.concatenate(([0], ends))
        return upto[bounds], pool[at]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> BatchEncoder:
    """The worker's encoder of a tokenizer file; it lives as long as the worker."""
    return BatchEncoder(path)


def default_tokenizer() -> str:
    """Place of the public 50k byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
