"""Token ids of whole texts with a public tokenizer file, cached by word.

Both tokenizer kinds cut a text before every blank that precedes a visible character, so a
text is the concatenation of independent chunks; each distinct chunk goes through the
``tokenizers`` library and is then reused.  A chunk of Latin letters and marks after them is
two pre-tokens, so it goes straight to the library's model, and at byte level so do such words with one line break
between them; any other chunk goes through the whole chain.  Ids are identical to encoding the whole
text; texts with runs of blanks are cut more strictly, and texts that hold an added token
(``<|endoftext|>``) literally are encoded whole.
"""

from __future__ import annotations

import os
import re
import threading
import time
import weakref

import numpy as np

from veilframe.llm.workers import release

_CODERS: dict[tuple[str, bool, int], "Coder"] = {}
#: Seconds after its last use that a worker process keeps a coder.
KEPT = 5.0
_CUT = re.compile(r"(?= \S)")
#: Latin letters that every Unicode version knows as letters, without the one whose lower case has two characters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)[!-/:-@\[-`{-~]*").fullmatch


def _byte_marks() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_MARKS = _byte_marks()


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Coder:
    """Encodes texts to unsigned 32-bit ids.

    ``leading_blank``: the kind whose words carry their leading blank (byte level); otherwise
    white space is dropped and words are independent.  Words are remembered in two generations
    of ``limit`` each: a full one becomes the old one, and old words that are met again move on.
    """

    def __init__(self, path: str, leading_blank: bool, limit: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.model._resize_cache(0)  # words are remembered here
        self.added = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.blank = leading_blank
        self.limit = limit
        self.used = time.monotonic()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = self.tok.get_vocab_size()
        self.raw = [i.to_bytes(4, "little") for i in range(size)]
        self.tails: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        if leading_blank:
            self.line = self._model(_MARKS[ord("\n")])
            self.opens = np.zeros(size, bool)
            for token, i in self.tok.get_vocab().items():
                self.opens[i] = token.startswith("Ġ")
        else:
            self.mark = self.tok.encode("\x01", add_special_tokens=False).ids
            assert len(self.mark) == 1

    def _model(self, pretoken: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(pretoken)])

    def _word(self, letters: str, opened: bool = True) -> bytes:
        """Ids of a word of plain Latin letters; ``opened``: behind a blank."""
        if not self.blank:
            letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_MARKS)
        return self._model("Ġ" + letters if self.blank and opened else letters)

    def _tail(self, marks: str) -> bytes:
        """Ids of the marks behind a word."""
        tail = self.tails.get(marks)
        if tail is None:
            if len(self.tails) >= self.limit:
                self.tails = {}
            self.tails[marks] = tail = self._model(marks)
        return tail

    def _plain(self, word: str, end: int) -> bytes:
        """Ids of a word of letters up to ``end`` and marks; both are remembered apart as well."""
        if end == len(word):
            return self._word(word)
        letters, marks = word[:end], word[end:]
        own = self.young.get(letters) or self.old.get(letters)
        if own is None:
            self.young[letters] = own = self._word(letters)
        return own + self._tail(marks)

    def _opening(self, word: str) -> bytes | None:
        """Ids of a byte-level word of letters and marks that begins a text or a line; None for any other word."""
        ids = self.bare.get(word)
        if ids is None:
            plain = _PLAIN(word)
            if plain is None:
                return None
            end = plain.end(1)
            ids = self._word(word[:end], False)
            if end < len(word):
                ids += self._tail(word[end:])
            if len(self.bare) >= self.limit:
                self.bare = {}
            self.bare[word] = ids
        return ids

    def _openings(self, words: list[str]) -> bytes | None:
        """Ids of such words with one line break between them; None if one is another word."""
        out = [self._opening(w) for w in words]
        return None if None in out else self.line.join(out)

    def _lines(self, word: str) -> bytes | None:
        """Ids of words of letters and marks with one line break between them, the first behind a blank; None for any other chunk.

        They are hardly ever met again as a whole, so only the words in them are remembered.
        """
        first, *rest = word.split("\n")
        ids = self.young.get(first) or self.old.get(first)
        if ids is None:
            plain = _PLAIN(first)
            if plain is None:
                return None
            self.young[first] = ids = self._plain(first, plain.end(1))
        later = self._openings(rest)
        return None if later is None else ids + self.line + later

    def _first(self, word: str) -> bytes:
        """Ids of what a byte-level text begins with."""
        ids = self._openings(word.split("\n"))
        return self.whole(word) if ids is None else ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str], into: dict[str, bytes]) -> None:
        """Encodes unseen words in joined runs; the run is cut back where a word must begin."""
        for i in range(0, len(words), 4096):
            run = words[i : i + 4096]
            if self.blank:
                ids = self._run(" " + " ".join(run))
                cuts = np.flatnonzero(self.opens[ids])
                ends = np.append(cuts[1:], len(ids))
            else:
                ids = self._run(" \x01 ".join(run) + " \x01")
                ends = np.flatnonzero(ids == self.mark[0])
                cuts = np.append(0, ends[:-1] + 1)
            if len(cuts) != len(run):  # a word that holds the mark, or none: one by one
                into.update((w, self.whole(" " + w if self.blank else w)) for w in run)
                continue
            raw = ids.tobytes()
            into.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(run, cuts.tolist(), ends.tolist()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        self.used = time.monotonic()
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        out: list[tuple[bytes, list]] = []
        hard: list[tuple[list, int, str]] = []
        for t in texts:
            if any(a in t for a in self.added):
                out.append((self.whole(t), []))
            elif not self.blank:
                out.append((b"", self._parts(t.replace("\n", " ").split(" "), hard, False)))
            else:
                first, *words = t.split(" ")
                parts = self._parts(words, hard, True)
                if parts is None:  # a run of blanks, or white space after a blank
                    first, *words = _CUT.split(t)
                    parts = self._parts([w[1:] for w in words], hard, False)
                out.append((self._first(first), parts))
        fresh = list({w for _, _, w in hard})
        learned: dict[str, bytes] = {}
        if fresh:
            self._learn(fresh, learned)
            self.young.update(learned)
        for parts, i, w in hard:
            parts[i] = learned[w]
        return [first + b"".join(parts) for first, parts in out]

    def _parts(self, words: list[str], hard: list, strict: bool) -> list | None:
        """Ids of each word; those for the library's whole chain are left open in ``hard``.

        ``strict``: None if a blank between the words does not open one.
        """
        young, old, blank, raw, model = self.young, self.old, self.blank, self.raw, self.model.tokenize
        parts = list(map(young.get, words))
        left = []
        for i in [i for i, p in enumerate(parts) if p is None]:
            w = words[i]
            ids = old.get(w)
            if ids is None:
                plain = _PLAIN(w)
                if plain is None:
                    if blank and "\n" in w and (ids := self._lines(w)) is not None:
                        parts[i] = ids
                        continue
                    if strict and (not w or w[0].isspace()):
                        return None
                    left.append((parts, i, w))
                    continue
                end = plain.end(1)
                if blank and end == len(w) and w.isascii():  # most words: without the calls
                    ids = b"".join([raw[t.id] for t in model("Ġ" + w)])
                else:
                    ids = self._plain(w, end)
            parts[i] = young[w] = ids
        hard += left
        return parts


def _drop(key: tuple[str, bool, int], seen: weakref.ref[Coder]) -> None:
    left = KEPT
    while left > 0:
        time.sleep(left)
        own = seen()
        if own is None:
            return
        left = own.used + KEPT - time.monotonic()
        if left <= 0 and _CODERS.get(key) is own:
            del _CODERS[key]
        del own
    release()


def forget() -> None:
    """Drops the coders of this worker at once, for a task that needs none."""
    if _CODERS:
        _CODERS.clear()
        release()


def coder(path: str, leading_blank: bool, limit: int = 600_000) -> Coder:
    """One coder per worker process, file and limit.

    Workers outlive a stage and serve the next one, so a coder that was not used for ``KEPT``
    seconds is dropped with all its words.  A task that still holds it may go on using it.
    """
    key = (path, leading_blank, limit)
    own = _CODERS.get(key)
    if own is None:
        own = _CODERS[key] = Coder(path, leading_blank, limit)
        threading.Thread(target=_drop, args=(key, weakref.ref(own)), daemon=True).start()
    own.used = time.monotonic()
    return own
