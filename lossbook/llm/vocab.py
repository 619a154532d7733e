"""Encoding with a public tokenizer, each distinct word once.

Both tokenizers used here split a text at white space before anything else, so the ids of a text are
the ids of its words, one after the other. Words are therefore encoded once and looked up afterwards.
"""

from __future__ import annotations

import json
import os
import string
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KNOWN_WORDS = 400_000            # words of one generation; a worker keeps two
WORDS_AT_ONCE = 20_000           # whose encodings, far larger than their ids, are held together
WORDS_OF_TEXT = 200              # words of letters that are encoded as one text
# letters that stay one letter when they are composed and lower-cased, and the ASCII signs
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17F}\x{410}-\x{44F}"
SIGNS = string.punctuation
ID_BYTES = 4


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _encode(path: str, words: list[str]) -> list[list[int]]:
    t = tokenizer(path)
    blocks = (words[i:i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE))
    return [e.ids for block in blocks for e in t.encode_batch_fast(block, add_special_tokens=False)]


def _packed(lists: list[list[int]]) -> list[bytes]:
    """Each list as the bytes of its 32-bit ids, cut out of one buffer."""
    ends = list(accumulate(map(len, lists), initial=0))
    raw = np.fromiter(chain.from_iterable(lists), np.uint32, ends[-1]).tobytes()
    return [raw[ID_BYTES * a:ID_BYTES * b] for a, b in pairwise(ends)]


@lru_cache(maxsize=4)
def _closing(path: str) -> np.ndarray | None:
    """Which ids end a piece of text, of a tokenizer that marks these ends; else None."""
    with open(path, encoding="utf-8") as f:
        facts = json.load(f)
    suffix = facts["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    ids = facts["model"]["vocab"]
    out = np.zeros(1 + max([*ids.values(), *(t["id"] for t in facts.get("added_tokens", []))]), bool)
    out[[i for piece, i in ids.items() if piece.endswith(suffix)]] = True
    return out


def _together(path: str, words: list[str]) -> list[bytes]:
    """Ids of words of letters, many encoded as one text.

    Every word ends a piece; if a text has as many ends as words, each word is one piece and the ends cut the ids. The words of a text
    that has more are encoded one by one.
    """
    out, closing = [], _closing(path)
    for at in range(0, len(words), WORDS_AT_ONCE):
        end = min(at + WORDS_AT_ONCE, len(words))
        blocks = [words[i:min(i + WORDS_OF_TEXT, end)] for i in range(at, end, WORDS_OF_TEXT)]
        for block, e in zip(blocks, tokenizer(path).encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = (ID_BYTES * (np.flatnonzero(closing[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in pairwise([0, *ends])] if len(ends) == len(block) else _packed(_encode(path, block))
    return out


def _fresh(path: str, words: list[str]) -> list[bytes]:
    """The bytes of each word's ids."""
    if _closing(path) is None:
        return _packed(_encode(path, words))
    letters = list(map(str.isalpha, words))
    simple = iter(_together(path, [w for w, ok in zip(words, letters) if ok]))
    others = iter(_packed(_encode(path, [w for w, ok in zip(words, letters) if not ok])))
    return [next(simple if ok else others) for ok in letters]


class WordEncoder:
    """Ids of words as (lengths, flat ids); frequent words are remembered between calls.

    Letters and digits followed by ASCII signs are encoded apart from these marks, which the
    tokenizer splits off as well. Words are kept in two generations: a full one becomes the older one,
    and words that come again move on, so rare words leave and frequent ones stay.
    """

    def __init__(self, path: str):
        self.path, self.recent, self.older = path, {}, {}

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = words.to_numpy(zero_copy_only=False).tolist()
        if len(self.recent) > KNOWN_WORDS:
            self.recent, self.older = {}, self.recent
        got = list(map(self.recent.get, words))
        places = [i for i, ids in enumerate(got) if ids is None]
        if places:
            missing = [words[i] for i in places]
            found = list(map(self.older.get, missing))
            fresh = iter(_fresh(self.path, [w for w, ids in zip(missing, found) if ids is None]))
            found = [next(fresh) if ids is None else ids for ids in found]
            self.recent.update(zip(missing, found))
            for i, ids in zip(places, found):
                got[i] = ids
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // ID_BYTES
        return lengths, np.frombuffer(b"".join(got), np.uint32)

    def plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as they are, none remembered."""
        lists = _encode(self.path, words.to_pylist())
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return lengths, np.fromiter((x for ids in lists for x in ids), np.uint32, int(lengths.sum()))

    def __call__(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        stem = pc.ascii_rtrim(distinct, characters=SIGNS)
        plain = pc.match_substring_regex(stem, f"^[{LETTERS}0-9]+$")
        marks = pc.if_else(plain, pc.replace_substring_regex(distinct, f"^[{LETTERS}0-9]+", ""), "")
        stem = pc.if_else(plain, pc.ascii_lower(stem), distinct)
        stems, marks = stem.dictionary_encode(), marks.dictionary_encode()
        stem_len, stem_ids = self._ids(stems.dictionary)
        mark_len, mark_ids = self._ids(marks.dictionary)
        a, b = stems.indices.to_numpy(), marks.indices.to_numpy()
        lengths = stem_len[a] + mark_len[b]
        lists = gather(np.concatenate([stem_len, mark_len]), np.concatenate([stem_ids, mark_ids]), np.stack([a, b + len(stem_len)], 1).ravel())
        return lengths, lists


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker: tasks that it runs later find the words of earlier ones."""
    return WordEncoder(path)


def gather(lengths: np.ndarray, flat: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Concatenate the lists (lengths, flat) in the order of `index`."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    n = lengths[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[index] - (ends - n), n) + np.arange(total)]
