"""Token ids of whole texts by a tokenizer file of the `tokenizers` library, a word at a time.

The tokenizer never joins characters across white space, so a text's ids are those of its words one after
another. Words repeat, hence their ids are kept; the library encodes only words that a task hasn't met.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

#: Words, and their parts, whose ids a worker keeps; beyond it, it starts again.
KEPT_WORDS, KEPT_PARTS = 500_000, 750_000
#: By how much less is kept and made at once where memory is scarce.
LEAN = 5
#: Documents whose ids a task holds at once.
SLICE = 400
#: The one letter that, in lower case, is a letter and a mark; and the one whose lower case depends on its place.
DOTTED, SIGMA = "\u0130", "\u03a3"
#: Characters of texts whose ids are made at once.
CHUNK_CHARS = 1_500_000


class WordEncoder:
    """encode(texts) gives an array of ids for each text, as the library does with add_special_tokens=False."""

    def __init__(self, path: str, lean: bool = False):
        """lean: a LEANth of the words is kept, and of the text made at once, in less memory and more time."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.share = LEAN if lean else 1
        self.reset()

    def reset(self) -> None:
        #: A word is two parts, letters and the marks after them: their numbers, the second in the upper 32 bits.
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {"": 0}
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(1, np.int32), np.zeros(1, np.int32)

    def learn(self, words: list[str]) -> None:
        """Marks after letters are tokens of their own, and the tokenizer lowers letters: so are parts met again."""
        parts, unseen, split = self.parts, [], []
        for word in words:
            known = parts.get(word)
            if known is not None:
                split.append(known)
                continue
            core = word.rstrip(".,;:!?")
            if not core.isalpha() or DOTTED in core:
                core, tail = word, ""
            else:
                tail = word[len(core) :]
                if SIGMA not in core:
                    core = core.lower()
            if core not in parts:
                parts[core] = len(parts)
                unseen.append(core)
            if tail not in parts:
                parts[tail] = len(parts)
                unseen.append(tail)
            split.append(parts[core] | parts[tail] << 32 if tail else parts[core])
        self.words.update(zip(words, split))
        if unseen:
            self.encode_parts(unseen)

    def encode_parts(self, unseen: list[str]) -> None:
        """Letters are encoded as one text of words, each of which ends in a token that ends words; others one by one."""
        first = len(self.start)
        letters = np.fromiter((p.isalpha() and DOTTED not in p for p in unseen), bool, len(unseen))
        words = [p for p, is_word in zip(unseen, letters) if is_word]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):  # a letter to one library and none to the other
            letters[:], ids, ends = False, ids[:0], ends[:0]
        rest = [p for p, is_word in zip(unseen, letters) if not is_word]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        start, length = np.zeros(len(unseen), np.int32), np.zeros(len(unseen), np.int32)
        length[letters] = np.diff(ends, prepend=0)
        start[letters] = ends - length[letters]
        length[~letters] = list(map(len, found))
        start[~letters] = len(ids) + np.cumsum(length[~letters]) - length[~letters]
        more = np.fromiter(chain.from_iterable(found), np.uint32, int(length[~letters].sum()))
        self.start = np.concatenate([self.start, np.int32(len(self.flat)) + start])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32), more])
        assert len(self.start) == first + len(unseen) == len(self.parts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out, chunk, chars = [], [], 0
        for text in texts:
            chunk.append(text.replace("\n", " ") if text else "")
            chars += len(chunk[-1])
            if chars > CHUNK_CHARS // self.share:
                out += self._encode(chunk)
                chunk, chars = [], 0
        return out + self._encode(chunk) if chunk else out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.parts) > KEPT_PARTS // self.share:
            self.reset()
        elif len(self.words) > KEPT_WORDS // self.share:
            self.words.clear()
        words = " ".join(texts).split(" ")
        known = list(map(self.words.get, words))
        if None in known:
            missing = [i for i, k in enumerate(known) if k is None]
            self.learn(list(dict.fromkeys([words[i] for i in missing])))
            for i in missing:
                known[i] = self.words[words[i]]
        numbers = np.array(known, "<i8").view("<u4")  # both parts of each word, in order
        length = self.length[numbers]
        ends = np.cumsum(length, dtype=np.int32)  # a chunk's ids are far fewer than 2 ** 31
        ids = self.flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(self.start[numbers] - ends + length, length)]
        last = 2 * np.cumsum([t.count(" ") + 1 for t in texts]) - 1  # each text's last part
        return np.split(ids, ends[last][:-1])


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, lean: bool = False) -> WordEncoder:
    """The worker's own encoder of this file, kept for its next task."""
    if (path, lean) not in _encoders:
        _encoders[path, lean] = WordEncoder(path, lean)
    return _encoders[path, lean]


def forget() -> None:
    """Lets go of the encoders a worker has kept, at the start of tasks that need the memory and encode nothing."""
    _encoders.clear()
