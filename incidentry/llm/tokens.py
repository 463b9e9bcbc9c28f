"""Token ids of whole texts by the ``tokenizers`` library, with a memo per pre-token.

The file of a tokenizer is a parameter: a path, or the name of a file of the ``public_tokenizers`` package, which is
then looked up on the executor. A text of common characters is cut into pre-tokens as the tokenizer's own rule cuts it; each
new one goes through the library's model and is remembered, and the ids of the pre-tokens concatenate to those of the text
(``tests/llm`` compares with encoding whole texts). A text with other characters, with an added token's string, or for a
tokenizer of another rule is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from incidentry.llm.common import worker_memo
from incidentry.session import pickle_by_value

#: Pre-tokens remembered per Python worker, about 150 bytes each; a full memo starts anew.
MEMO_UNITS = 600_000

#: Texts without these are cut here: what stays are white space, letters, digits and marks that every version of
#: Unicode and every engine of regular expressions sorts alike, in composed form, and whose lower case is among them.
_UNSURE = re.compile("[^\t\n\r -~\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u012f"
                     "\u0131-\u017f\u0218-\u021b\u2010-\u2027\u2030-\u205e]")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0218-\u021b"
#: How the two kinds of tokenizer cut such texts, and the rules as their files name them.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_LEVEL = re.compile(rf"{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(rf"{_ENDINGS}|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_WORD_RULE = _ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def load_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    if not os.path.isabs(name):
        import public_tokenizers
        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for what follows 255, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class _Units(dict):
    """Ids (bytes) by pre-token; a new one is looked up in the model."""

    def __init__(self, model, size: int):
        super().__init__()
        self.model, self.letters = model, _byte_letters()
        self.bytes_of = [i.to_bytes(4, "little") for i in range(size)]

    def __missing__(self, unit: str) -> bytes:
        shown = unit if unit.isascii() and unit.isalnum() else unit.encode().decode("latin-1").translate(self.letters)
        of = self.bytes_of
        found = self[unit] = b"".join([of[t.id] for t in self.model.tokenize(shown)])
        return found


class Encoder:
    """Texts to little-endian unsigned 32-bit ids (bytes)."""

    def __init__(self, name: str):
        self.tokenizer = load_tokenizer(name)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units = _Units(self.tokenizer.model, self.tokenizer.get_vocab_size())
        self.lower, self.rule = False, None
        file = json.loads(self.tokenizer.to_str())
        cut, normal = file["pre_tokenizer"] or {}, file["normalizer"]
        if cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and normal is None:
            self.rule = _BYTE_LEVEL
        elif normal and [n["type"] for n in normal.get("normalizers", [])] == _WORD_NORMALIZERS:
            first = (cut.get("pretokenizers") or [{}])[0]
            if first.get("pattern") == {"Regex": _WORD_RULE} and first["behavior"] == "Removed" and first["invert"]:
                self.lower, self.rule = True, _WORD_LEVEL

    @staticmethod
    def of(name: str) -> Encoder:
        memo = worker_memo("tokenizers")
        if name not in memo:
            memo[name] = Encoder(name)
        return memo[name]

    def encode(self, texts: list[str]) -> list[bytes]:
        unit, out = self.units.__getitem__, []
        for text in texts:
            if len(self.units) > MEMO_UNITS:
                self.units.clear()
            if self.rule is None or _UNSURE.search(text) or self._added_in(text):
                out.append(self._whole(text))
            else:
                out.append(b"".join(map(unit, self.rule.findall(text.lower() if self.lower else text))))
        return out

    def _added_in(self, text: str) -> bool:
        return any(t[:2] in text for t in self.added) and any(t in text.lower() for t in self.added)

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, "<u4").tobytes()


pickle_by_value(__name__)
