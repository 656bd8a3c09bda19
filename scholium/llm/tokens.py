"""Exact and fast encoding of whole texts by the tokenizers library.

Neither vocabulary's pre-tokenizer lets a token cross a single space between
two other characters, so a text falls into the parts between its spaces, and a
part into fragments, that the library may encode one by one with the same ids
as the whole. Parts recur, so Arrow numbers the different parts of a batch,
each worker keeps bounded caches of their ids, and a batch's ids are gathered at
once. A fragment that is one run of common letters is one pre-token, and goes
straight to the library's BPE model; any other is encoded by the whole tokenizer. Texts in
which white space meets white space are encoded whole where the vocabulary
keeps white space.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ID = 4  # bytes of an id, little-endian
CACHE = 450_000
_MEETS = re.compile(r"\s\s")
_LETTER = r"A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of common letters ends a token of either vocabulary where plain punctuation, white space or the end follows; so does
#: plain punctuation before white space or the end. Anything else stays whole up to the next space.
_JOINED = re.compile(rf" ?[{_LETTER}]+(?![^ \n.,;:!?*%&$#])|[.,;:!?*%&$#]+(?![^ \n])|\n| ?[^ \n]+")
_PARTED = re.compile(rf"[{_LETTER}]+(?![^ \n\t\r.,;:!?*%&$#])|[.,;:!?*%&$#]+(?![^ \n\t\r])|[^ \n\t\r]+")
#: Stands for the ids of a part whose text has to be encoded whole.
WHOLE = b"?"
_RUN = re.compile(rf" ?[{_LETTER}]+")
_WORD = re.compile(rf"[{_LETTER}]+")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 is itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Recent:
    """A cache of two generations: what recurs is carried over when the older one goes."""

    def __init__(self, size: int):
        self.size, self.now, self.old = size, {}, {}

    def lacking(self, wanted: list[str]) -> list[str]:
        """What of ``wanted`` is in neither generation; what only the older one has is carried over."""
        if len(self.now) > self.size:
            self.now, self.old = {}, self.now
        new = [w for w, held in zip(wanted, map(self.now.get, wanted)) if held is None]
        if self.old:
            known = [(w, held) for w, held in zip(new, map(self.old.get, new)) if held is not None]
            self.now.update(known)
            new = [w for w in new if w not in self.now] if known else new
        return new


class Encoder:
    """ids of whole texts, as unsigned 32-bit integers.

    ``joined``: the pre-tokenizer keeps one leading space with a word (byte-level
    vocabularies); else white space is dropped, letters are lowered and only parts words.
    ``special``: a special token written out in a text, such as <|endoftext|>, gets
    that token's id, which is the library's plain call; else it is text like any other.
    No fragment rule cuts within one.
    """

    def __init__(self, path: str, joined: bool, cache: int = CACHE, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.bare = Tokenizer(self.tokenizer.model)
        self.letters = _byte_letters()
        self.joined = joined
        self.parts, self.fragments = Recent(cache), Recent(cache)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _fragments(self, part: str, lead: str) -> list[str] | None:
        """What a part falls into; None where its white space may meet other white space."""
        if not self.joined:
            return _PARTED.findall(part)
        if not part or part[0].isspace() or part[-1].isspace() or _MEETS.search(part):
            return None
        return _JOINED.findall(lead + part)

    def _runs(self, runs: list[str]):
        """The ids of runs of letters, which are one pre-token each."""
        spelt = [(f if self.joined else f.lower()).encode().decode("latin-1").translate(self.letters) for f in runs]
        return (array("I", e.ids).tobytes() for e in self.bare.encode_batch_fast(spelt, add_special_tokens=False))

    def _learn(self, new: list[str]) -> None:
        """Enter fragments; a run that is known as a part, whose space is understood, is not encoded again."""
        runs, others, now, lead = [], [], self.fragments.now, int(self.joined)
        for f in new:
            if not _RUN.fullmatch(f):
                others.append(f)
            elif (held := self.parts.now.get(f[lead:]) if not lead or f[0] == " " else None) is not None:
                now[f] = held
            else:
                runs.append(f)
        now.update(zip(runs, self._runs(runs), strict=True))
        now.update((f, array("I", e.ids).tobytes()) for f, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True))

    def _compose(self, parts: list[str], lead: str) -> list[bytes]:
        cut = [self._fragments(p, lead) for p in parts]
        missing = self.fragments.lacking(list({f for fs in cut if fs for f in fs}))
        for at in range(0, len(missing), 4096):
            self._learn(missing[at : at + 4096])
        get = self.fragments.now.__getitem__
        return [WHOLE if fs is None else b"".join(map(get, fs)) for fs in cut]

    def _know(self, parts: list[str]) -> list[bytes]:
        """The ids of different parts after a space."""
        runs, others = [], []
        for p in self.parts.lacking(parts):
            (runs if _WORD.fullmatch(p) else others).append(p)
        now, lead = self.parts.now, " " if self.joined else ""
        for at in range(0, len(runs), 4096):
            some = runs[at : at + 4096]
            now.update(zip(some, self._runs([lead + p for p in some]), strict=True))
        now.update(zip(others, self._compose(others, lead), strict=True))
        return list(map(now.__getitem__, parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; nulls count as empty."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = texts.fill_null("")
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()[:-1].astype(np.int64)
        flat = split.flatten().dictionary_encode()
        parts = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = flat.indices.to_numpy().astype(np.int64)
        held = self._know(parts)
        if self.joined:
            firsts = [parts[i] for i in which[starts].tolist()]
            which[starts] = len(held) + np.arange(len(starts))
            held += self._compose(firsts, "")
        counted = np.ones(len(which), bool)
        if WHOLE in held:
            absent = np.fromiter((h is WHOLE for h in held), bool, len(held))
            for i in np.flatnonzero(np.logical_or.reduceat(absent[which], starts)).tolist():
                counted[starts[i] : starts[i + 1] if i + 1 < len(starts) else None] = False
                counted[starts[i]], which[starts[i]] = True, len(held)
                held.append(self.whole(texts[i].as_py()))
            held = [b"" if h is WHOLE else h for h in held]
        pool = np.frombuffer(b"".join(held), "<u4")
        size = np.fromiter(map(len, held), np.int64, len(held)) // ID
        begin = np.cumsum(size) - size
        n = np.where(counted, size[which], 0)
        ends = np.cumsum(n)
        place = np.repeat(begin[which] - ends + n, n)
        place += np.arange(len(place))
        return pool[place], np.add.reduceat(n, starts)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, joined: bool, special: bool = False) -> Encoder:
    """One encoder for each worker process and vocabulary: its cache outlives the task."""
    key = (path, joined, special)
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = Encoder(path, joined, special=special)
    return _encoders[key]


def slices(texts: pa.Array, limit: int = 1 << 22):
    """Positions of runs of texts of about ``limit`` bytes, so that a batch of long texts stays small."""
    begin, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        held += n
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def ended(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after each text's, and the edges of the texts among them."""
    stops = np.cumsum(counts)
    return np.insert(ids, stops, end), np.r_[0, stops + np.arange(1, len(stops) + 1)]
