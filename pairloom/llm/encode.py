"""Exact, fast use of public tokenizers: pieces that cannot influence each other are encoded once and kept.

Both vocabularies split a text into pieces before any merge. For texts of ASCII and Latin-1
letters those pieces follow from a plain pattern, so each distinct piece goes through the
tokenizer once per worker and a text is the concatenation of its pieces' ids. Any other text,
one that holds an added token such as an end mark, and every text of a vocabulary whose file
splits texts otherwise go through the tokenizer whole, so the result never depends on the
short cut: it is that of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re
from struct import pack

from pairloom.llm.common import process_cache

#: Pieces kept by one Python worker.
KEPT_PIECES, SHORT_PIECE = 800_000, 8

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(f"[^\\t\\n\\r\\x20-\\x7e{_LETTERS}]")
#: The piece patterns of the two vocabularies, over the letters above.
_PIECES = {
    "spaced": re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+"),
    "lowered": re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+"),
}

#: How the two vocabulary files normalise and split texts, as their patterns above assume.
_SPLITS = {
    "spaced": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "lowered": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
}


def encoder(path: str, kind: str) -> "Encoder":
    """This worker's encoder for a file."""
    return process_cache(f"encoder {kind} {path}", lambda: Encoder(path, kind))


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers. ``kind``: "spaced" keeps white space, "lowered" drops it and case."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        plain = (rules["normalizer"], rules["pre_tokenizer"]) == _SPLITS[kind]
        self.pattern, self.lowered, self.kept = _PIECES[kind] if plain else None, kind == "lowered", {}
        added = [t["content"] for t in rules["added_tokens"]]
        self.added = [x.lower() for x in added] if any(t["normalized"] for t in rules["added_tokens"]) else added
        self.any_case = self.added is not added

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [pack(f"<{len(ids)}I", *ids) for ids in (x.ids for x in found)]

    def is_plain(self, text: str) -> bool:
        """Whether the pieces of ``text`` follow from the pattern."""
        if self.pattern is None or _OTHER.search(text):
            return False
        seen = text.lower() if self.any_case else text
        return not any(x in seen for x in self.added)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        for s in range(0, len(texts), 256):
            every = range(s, min(s + 256, len(texts)))
            plain = [i for i in every if self.is_plain(texts[i])]
            odd = sorted({*every} - {*plain})
            for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
                out[i] = ids
            if len(self.kept) > KEPT_PIECES:
                self.kept = {k: v for k, v in self.kept.items() if len(k) <= SHORT_PIECE}  # these come back most
            if len(self.kept) > KEPT_PIECES:
                self.kept = {}
            get, late, new = self.kept.get, [], set()
            for i in plain:
                pieces = self.pattern.findall(texts[i].lower() if self.lowered else texts[i])
                ids = list(map(get, pieces))
                if None in ids:
                    missing = [k for k, x in enumerate(ids) if x is None]
                    new.update(map(pieces.__getitem__, missing))
                    late.append((i, pieces, ids, missing))
                else:
                    out[i] = b"".join(ids)
            first = list(new)
            self.kept.update(zip(first, self.whole(first)))
            for i, pieces, ids, missing in late:
                for k in missing:
                    ids[k] = self.kept[pieces[k]]
                out[i] = b"".join(ids)
        return out
