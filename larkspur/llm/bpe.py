"""Byte-pair encoding with a given vocabulary: a backtracking encoder and a decoder by offset table.

The encoder never plays merges back. One Aho-Corasick pass over the reversed word finds every longer token that
starts at each place, single characters are looked up where none does; the encoder takes the longest that may
stand after its predecessor and backs up from places where none fits. Two tokens may stand together if byte-pair
merging of their joined text would give just these two, which depends on the pair alone and is kept in a table. A
place that failed once is never tried again, so the work is linear in the length of the word.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame

from larkspur.llm.workers import hand_back

END = "</w>"
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CONTROL = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\s")
LATE = float("inf")


def byte_alphabet() -> list[str]:
    """A visible character for each byte: its own where it has a glyph in Latin-1, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Memo(dict):
    """Results of ``make`` by key. Of what was used before the last ``most`` new keys nothing is kept, and nothing of texts
    from ``length`` characters on, so memory is bounded."""

    def __init__(self, make, most: int, length: int = 0):
        self.make, self.most, self.length, self.old = make, most, length, {}

    def __missing__(self, key):
        if self.length and len(key) >= self.length:
            return self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


class Codec:
    """Encoder and decoder for a vocabulary file with word ends (``end_of_word_suffix``)."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**model["vocab"], **self.special}
        blob, self.offsets = bytearray(), []
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        for name in self.names:
            self.offsets.append(len(blob))
            blob += name.encode()
        self.offsets.append(len(blob))
        self.blob = bytes(blob)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab = model["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, float] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            t = vocab[a + b]
            self.pairs[vocab[a], vocab[b]] = r
            if t not in self.parts:
                self.parts[t], self.rank[t] = (vocab[a], vocab[b]), r
        alphabet = byte_alphabet()
        self.bytes = alphabet
        self.last = {c: chr(0xE000 + ord(c)) for c in alphabet}
        self.length: dict[int, int] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.reach = ahocorasick.Automaton()
        sound: set[int] = set()
        keys: dict[str, int] = {}
        for name, t in sorted(vocab.items(), key=lambda x: self.rank.get(x[1], -1)):
            key = name[: -len(END) - 1] + self.last[name[-len(END) - 1]] if name.endswith(END) and len(name) > len(END) else name
            if t in self.parts:  # a token that merging its own text does not give can stand nowhere
                a, b = self.parts[t]
                if a not in sound or b not in sound or self._first_merge(a, b) != self.rank[t]:
                    continue
            sound.add(t)
            self.length[t] = len(key)
            keys[key] = t
            if len(key) > 1:
                self.reach.add_word(key[::-1], t)
        self.reach.make_automaton()
        self.single = {key: t for key, t in keys.items() if len(key) == 1}
        self.shorter = {t: next((keys[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in keys), None) for key, t in keys.items()}
        self.base = len(self.names)
        self.fits = Memo(lambda p: self._first_merge(*divmod(p, self.base)) is None, 1 << 18)
        self.of_word = Memo(self._word, 1 << 17, 64)
        self.text_of_word = Memo(self._text_of_word, 1 << 17, 64)
        self.text_of_chunk = Memo(self._chunk, 1 << 17, 64)

    def forget(self) -> None:
        """Empties the memos, so that an idle worker holds the tables only, and no memory that was freed around them."""
        for memo in (self.fits, self.of_word, self.text_of_word, self.text_of_chunk):
            memo.clear()
            memo.old = {}
        for known in self.edges:
            known.clear()
        hand_back()

    def _edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """What stands at one end of ``t`` while it is being merged, from the single character to ``t``, each
        with the rank of the merge that ends it."""
        known = self.edges[side]
        if t not in known:
            out, until, x = [(t, LATE)], self.rank.get(t), t
            while x in self.parts:
                x = self.parts[x][side]
                out.append((x, until))
                until = self.rank.get(x)
            known[t] = out[::-1]
        return known[t]

    def _first_merge(self, a: int, b: int) -> int | None:
        """The rank of the merge across the border of ``a`` and ``b``, played in order of time; None if there is none.

        Of two equal merges the left one comes first: one inside ``a`` precedes one across, one inside ``b``
        follows it.
        """
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (x, next_left), (y, next_right) = left[i], right[j]
            across = self.pairs.get((x, y), LATE)
            if across < next_left and across <= next_right and across < LATE:
                return across
            if next_left == next_right == LATE:
                return None
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _word(self, word: str) -> tuple[int, ...]:
        """Token ids of one word of the pre-tokenizer."""
        key = word if word.isascii() and word.isprintable() else "".join([self.bytes[b] for b in word.encode("utf-8", "replace")])
        key = self.last[key[-1]] + key[-2::-1]
        n, length, shorter, fits, base = len(key), self.length, self.shorter, self.fits, self.base
        longest = dict(reversed(list(self.reach.iter(key))))  # by the place where tokens end; of several the first, longest, stays
        failed = bytearray(n + 1)
        tokens: list[int] = []
        place, new, t = 0, True, None
        while place < n:
            if new:
                t = longest.get(n - 1 - place)
                if t is None:
                    t = self.single.get(key[n - 1 - place])
                new = False
            while t is not None:
                after = place + length[t]
                if not failed[after] and (not tokens or fits[tokens[-1] * base + t]):
                    tokens.append(t)
                    place, new = after, True
                    break
                t = shorter[t]
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks a single character")
                failed[place] = 1
                t = tokens.pop()
                place -= length[t]
                t = shorter[t]
        return tuple(tokens)

    def _words(self, chunk: str) -> list[str | int]:
        """The pre-tokenizer's words of a text without white space, special tokens as their ids."""
        if chunk.isalpha() and chunk.isascii() and chunk not in self.special:
            return [chunk.lower()]
        out: list[str | int] = []
        for part in self.specials.split(chunk) if self.specials and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = (part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")).lower()
                letters = plain.rstrip(".,:;!?")
                if letters.isalpha():  # as most: letters, or letters and marks
                    out += [letters, plain[len(letters) :]] if len(letters) < len(plain) else [plain]
                else:
                    out += PATTERN.findall(plain)
        return out

    def _ids(self, chunk: str) -> list[int]:
        """Token ids of a text without white space."""
        return [i for word in self._words(chunk) for i in (self.of_word[word] if isinstance(word, str) else (word,))]

    def _text(self, ids: tuple[int, ...]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.decode(ids)

    def _text_of_word(self, word: str) -> tuple[str, str]:
        return self._text(self._word(word))

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """The ids of a text without white space and what they decode to."""
        got = [self.text_of_word[word] if isinstance(word, str) else self._text((word,)) for word in self._words(chunk)]
        if len(got) == 1:
            return got[0]
        return " ".join([x for x, _ in got]), " ".join([x for _, x in got])

    def chunks(self, text: str, most: int = 1 << 22) -> Iterator[list[str]]:
        """White-space separated chunks of a text, in lists from about ``most`` characters each."""
        place = 0
        while place < len(text):
            cut = len(text)
            if cut - place > most and (m := SPACE.search(text, place + most)):
                cut = m.end()
            part = text[place:cut] if place or cut < len(text) else text
            yield [x for x in SPACE.split(part) if x] if CONTROL.search(part) else part.split()
            place = cut

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text; none for null."""
        return [i for part in self.chunks(text or "") for chunk in part for i in self._ids(chunk)]

    def decode(self, ids) -> str:
        """The tokens' texts joined by spaces, each cut from the table."""
        o = self.offsets
        return b" ".join([self.blob[o[i] : o[i + 1]] for i in ids]).decode()

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the decoded text."""
        ids, decoded, n, of_chunk = hashlib.sha256(), hashlib.sha256(), 0, self.text_of_chunk.__getitem__
        for part in self.chunks(text or ""):
            if part:
                a, b = zip(*map(of_chunk, part))
                if not all(a):
                    raise ValueError("a chunk without tokens")
                gap = b" " if n else b""
                numbers = " ".join(a).encode()
                ids.update(gap + numbers)
                decoded.update(gap + " ".join(b).encode())
                n += numbers.count(b" ") + 1
        return n, ids.hexdigest(), decoded.hexdigest()


_codecs: dict[int, Codec] = {}


def _codec(file_text: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = hash(file_text)
    if key not in _codecs:
        _codecs[key] = Codec(file_text)
    return _codecs[key]


def _sent(docs: DataFrame, path: str):
    """The vocabulary, read by the driver and sent once to each executor; its size is that of the file."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, ids array<int>)`` for every row; a null or empty text has no ids. Rows keep their order and copies."""
    vocabulary = _sent(docs, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(vocabulary.value)
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], "ids": [codec.encode(t) for t in f["text"]]})
        codec.forget()

    return docs.select(id_col, "text").mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, text)`` of rows ``(id, ids)``; null ids give an empty text."""
    vocabulary = _sent(rows, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(vocabulary.value)
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], "text": [codec.decode(x if x is not None else ()) for x in f["ids"]]})

    return rows.select(id_col, "ids").mapInPandas(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of encoding every text and decoding it again.

    Null texts count as empty; texts of any length are encoded whole; repeated rows get equal results; columns of other
    names are not read; an empty table gives an empty one.
    """
    vocabulary = _sent(docs, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(vocabulary.value)
        try:
            for f in frames:
                n, ids, decoded = zip(*map(codec.digest, f["text"]), strict=True) if len(f) else ((), (), ())
                yield pd.DataFrame({id_col: f[id_col], "n_tokens": pd.Series(n, dtype="int64"), "ids_sha256": pd.Series(ids, dtype=object), "decoded_sha256": pd.Series(decoded, dtype=object)})
        finally:
            codec.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInPandas(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
