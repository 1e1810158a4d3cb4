"""Token ids of whole texts, as the tokenizers library gives them.

Texts go through tiktoken, given the same vocabulary, which is several times as fast as the
tokenizers library. Two kinds of text it does not take whole: those with an added token in them, and
those with a very long run of blanks or of other characters, on which its pattern engine and
its merges may give up or take long. Byte-level models split a text into words first and never
merge across them, so that ids of words, strung together, are the ids of the text: such texts are
split here, each distinct word of a batch is encoded once, and a memory of words saves the rest
(it is emptied when it is full). Tests hold the ids of both ways against the tokenizers library's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import regex
import tiktoken

from creditmill.llm.vocabulary import Vocabulary, added_tokens

#: Fixed value: how byte-level models of this kind split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task remembers, and characters of text worked on at once.
REMEMBERED, CHARS = 500_000, 1_000_000
#: Bytes of a run, of ASCII blanks and controls or of others, beyond which a text is split here.
RUN = 5_000


def splitter(path: str) -> Callable[[str], list[str]]:
    """Words of a text, with added tokens as words of their own."""
    find = regex.compile(WORDS).findall
    own = added_tokens(path)
    if not own:
        return find
    fixed = regex.compile("(" + "|".join(map(regex.escape, sorted(own, key=len, reverse=True))) + ")")

    def split(text: str) -> list[str]:
        if not any(t in text for t in own):
            return find(text)
        return list(chain.from_iterable([x] if x in own else find(x) for x in fixed.split(text)))

    return split


def longest_run(data: bytes) -> int:
    """Bytes of the longest run that is all up to the blank in the table of characters, or all beyond it."""
    low = np.frombuffer(data, np.uint8) <= 32
    edges = np.flatnonzero(low[1:] != low[:-1])
    return int(np.diff(edges, prepend=-1, append=len(low) - 1).max()) if len(low) else 0


def batches_of(texts: list[str | None], chars: int = CHARS) -> Iterator[list[str]]:
    """Texts in their order, in lists of about so many characters; null counts as empty."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoder(path: str) -> Callable[[list[str | None]], Iterator[np.ndarray]]:
    """A function from texts to their ids, one array of unsigned 32-bit integers for each."""
    vocabulary, split = Vocabulary(path), splitter(path)
    own_ids = {w: np.array([i], np.uint32).tobytes() for w, i in vocabulary.added.items()}
    ranks = {t: i for i, t in vocabulary.bytes_of.items() if i not in vocabulary.added.values()}
    library = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    newline = ranks[b"\n"]
    known: dict[str, bytes] = {}

    def learn(words: list[str]) -> None:
        """One call for all words between line ends, which no word of letters or signs touches; others alone."""
        plain = [w for w in words if w not in own_ids and not w.isspace()]
        ids = np.array(library.encode_ordinary("\n".join(plain)), np.uint32)
        ends = np.append(np.flatnonzero(ids == newline), len(ids)).tolist() if plain else []
        start, data = 0, ids.tobytes()
        for word, end in zip(plain, ends, strict=True):
            known[word] = data[4 * start : 4 * end]
            start = end + 1
        for word in set(words).difference(plain):
            known[word] = own_ids.get(word) or np.array(library.encode_ordinary(word), np.uint32).tobytes()

    def by_words(texts: list[str]) -> list[np.ndarray]:
        words = [split(t) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        learn(list(set(chain.from_iterable(words)).difference(known)))
        return [np.frombuffer(b"".join(map(known.__getitem__, own)), np.uint32) for own in words]

    def whole(text: str) -> bool:
        return longest_run(text.encode()) <= RUN and not any(t in text for t in own_ids)

    def encode(texts: list[str | None]) -> Iterator[np.ndarray]:
        for some in batches_of(texts):
            easy = [whole(t) for t in some]
            others = iter(by_words([t for t, e in zip(some, easy, strict=True) if not e]))
            for text, e in zip(some, easy, strict=True):
                yield library.encode_to_numpy(text, disallowed_special=()) if e else next(others)

    return encode
