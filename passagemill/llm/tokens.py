"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

The ids are those of ``tokenizers`` for a byte-level BPE file. Where the file is of the
plain byte-level kind, words are looked up in a bounded cache and only new words are
merged (by tiktoken, with the ranks of the same file); any other file is left to
``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from array import array

_LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
#: The file's own splitting rule for texts of Latin letters, ASCII and common dashes and quotes.
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_ODD = re.compile(rf"[^\x00-\x1b\x20-\x7e{_LATIN}–—‘-„…€]")
_FULL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE files write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            letters[chr(256 + extra)] = b
            extra += 1
    return letters


class Encoder(dict):
    """Maps pieces to id bytes; ``encode`` maps texts."""

    def __init__(self, path: str, most: int = 1 << 16):
        super().__init__()
        self.path, self.most, self.slow = path, most, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        vocab = model.get("vocab") or {}
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        letters = _byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges") or ()]
        plain = (
            model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
            and all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word")) for x in spec.get("added_tokens") or ())
        )
        if not plain:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            return
        import regex
        import tiktoken

        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if k not in added}
        bpe = tiktoken.Encoding("byte_level", pat_str=_FULL, mergeable_ranks=ranks, special_tokens={})
        self.merge = getattr(bpe._core_bpe, "encode_single_piece", None) or (lambda b: bpe.encode_ordinary(b.decode()))
        self.full = regex.compile(_FULL)
        self.added = {k: array("I", [v]).tobytes() for k, v in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = array("I", self.merge(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        pieces = (self.full if _ODD.search(text) else _PLAIN).findall(text)
        return b"".join(map(self.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.slow is not None:
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        return b"".join(self.added.get(part) or self._plain(part) for part in self.split.split(text) if part)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
