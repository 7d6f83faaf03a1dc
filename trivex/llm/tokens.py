"""Public tokenizers over long texts: the ids of the tokenizers library, by a faster byte-pair merger where both are sure to agree."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Texts of these characters only, and without an added token's "<|", take the fast way; any other text goes to the tokenizers library.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]|<\\|")
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_END, _MARK = "</w>", "\x01"
_held: dict[tuple[str, str], "TextTokenizer"] = {}


def _bytes_of() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class TextTokenizer:
    """ids of texts as little-endian uint32 bytes, those of encode(text, add_special_tokens=False).

    kind "bytes" is a byte-level BPE; "spaced" one whose words end in a mark and whose input is lower-cased, with white space dropped. Both are merged by tiktoken from the vocabulary of the same file: ids of merged tokens are in merge order. A word's end is a byte that a Latin text doesn't have, and joins the word's last byte before anything else.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow, self.kind = Tokenizer.from_file(path), kind
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        of, ranks = _bytes_of(), {}
        first = {}  # rank -> id where they differ
        for t, i in model["model"]["vocab"].items():
            if t in special:
                continue
            ended = kind == "spaced" and t.endswith(_END) and len(t) > len(_END)
            raw = bytes(of[c] for c in (t[: -len(_END)] if ended else t)) + (_MARK.encode() if ended else b"")
            rank = i
            if kind == "spaced" and len(raw) <= 1 + ended:
                rank = raw[0] + (0 if ended else 256)
                first[rank] = i
            ranks[raw] = rank
        self.table = np.arange(max(ranks.values()) + 1, dtype="<u4")
        for r, i in first.items():
            self.table[r] = i
        pattern = _PATTERN if kind == "bytes" else f"[^{_MARK}]+{_MARK}"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def of(path: str, kind: str) -> "TextTokenizer":
        if (path, kind) not in _held:
            _held[path, kind] = TextTokenizer(path, kind)
        return _held[path, kind]

    def _slow(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif _OTHER.search(t):
                out.append(self._slow(t))
            elif self.kind == "bytes":
                out.append(self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes())
            else:
                words = _PIECES.findall(t.lower())
                if words:
                    out.append(self.table[self.fast.encode_to_numpy(_MARK.join(words) + _MARK, disallowed_special=())].tobytes())
                else:
                    out.append(b"")
        return out
