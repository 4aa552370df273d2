"""Exact token ids from a per-worker cache of short pieces.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so the ids of the text are the joined ids of its
pieces. Frequent pieces come from a dict; only unseen pieces go through the library. Layouts that are not known here
are encoded whole by the library. Whole texts are always encoded, of any length.
"""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters that are one kind for every regex library and need no normalisation on their own (not U+0130, whose lower
#: case has a second character that is no letter).
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: White space as the tokenizer files' \s has it.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of letters ends safely before white space, ASCII punctuation, or the end.
_AFTER = f"(?=[{_BLANK}!-/:-@\\[-`{{-~]|\\Z)"
#: White space is dropped: a run of letters, or all up to the next white space.
_DROPPING = re.compile(f"[{_LATIN}]+{_AFTER}|[^{_BLANK}]+")
#: White space counts: a word takes one space before it; of a longer run the last one is left to the next piece.
_KEEPING = re.compile(f" ?[{_LATIN}]+{_AFTER}| ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]")

#: A piece that is one pre-token by itself: the model can encode it without the pipeline before it.
_ONE = re.compile(f" ?[{_LATIN}]+")

#: Longer pieces are encoded each time, so that the cache's memory has a bound.
PIECE_CHARS = 40
#: Entries of one of a worker's two generations; when the young one is full it becomes the old one, which is dropped.
GENERATION = 300_000


def byte_letters() -> dict[int, str]:
    """What a byte-level tokenizer's model sees for the space and for each letter of _LATIN that takes two bytes.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in (32, *range(0xC0, 0x180))}


_SHOWN = byte_letters()


def split_kind(spec: dict) -> re.Pattern | None:
    """How texts of this tokenizer file can be cut; None: not known, never cut."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if (spec.get("model") or {}).get("type") != "BPE" or spec.get("truncation") or spec.get("padding"):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return _KEEPING
    steps = pre.get("pretokenizers") or [{}]
    want = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    kinds = [x["type"] for x in (norm or {}).get("normalizers", [])]
    drops = steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[0].get("pattern", {}).get("Regex") == want
    return _DROPPING if drops and kinds == ["NFC", "Replace", "Lowercase"] and not steps[-1].get("use_regex") else None


class Pieces:
    """One tokenizer file with its cache; ``ids(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = split_kind(spec)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def cut(self, text: str) -> list[str] | None:
        """The pieces; None where only the library may cut (a special token's string beside kept white space)."""
        if self.pattern is None or (self.pattern is _KEEPING and any(s in text for s in self.special)):
            return None
        return self.pattern.findall(text)

    def encode(self, piece: str) -> list[int]:
        """The ids of one piece."""
        if self.pattern is not None:
            bare = piece[1:] if piece[:1] == " " else piece
            if bare.isascii() and bare.isalpha():
                shown = bare.lower() if self.pattern is _DROPPING else piece.replace(" ", _SHOWN[32])
                return [t.id for t in self.model.tokenize(shown)]
            if _ONE.fullmatch(piece):
                shown = (piece if self.pattern is _KEEPING else piece.lower()).translate(_SHOWN)
                return [t.id for t in self.model.tokenize(shown)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def seen(self, piece: str) -> bytes:
        """The ids' bytes of a piece that the young generation lacks, which takes it in."""
        out = self.old.get(piece)
        if out is None:
            out = array("I", self.encode(piece)).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self.young) >= GENERATION:
                self.young, self.old = {}, self.young
            self.young[piece] = out
        return out

    def ids(self, text: str) -> bytes:
        pieces = self.cut(text) if text else []
        if pieces is None:
            return self.whole(text)
        found = list(map(self.young.get, pieces))
        if None in found:
            at, young = 0, self.young
            try:
                while True:
                    at = found.index(None, at)
                    found[at] = young.get(pieces[at]) or self.seen(pieces[at])
                    young = self.young
            except ValueError:
                pass
        return b"".join(found)


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """This process's Pieces of the file."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]

