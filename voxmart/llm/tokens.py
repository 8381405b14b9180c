"""Token ids of many texts with the tokenizers library, each word encoded once per task.

Both pre-tokenizers cut a text at blanks, so the ids of a text are those of its words in order. Words repeat; their ids come
from a bounded cache, the library encodes what is new. Where a text's blanks are not single spaces and line feeds between
words, or the file's pre-tokenizer is another one, the library encodes the text as a whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of an executor are its parallelism

CACHE = 1_000_000  # words whose ids a Python worker keeps, about 200 MB
# Commas and full stops after letters and digits begin a word of their own; texts where they follow something else are not
# cut there. The search is for the signs, which are few, and looks back from them.
_LOOSE = re.compile(r"[.,](?<![^\W_][.,])")
# Blanks other than single spaces and line feeds, and the mark that words are parted by.
_CROWDED = ["  ", "\n\n", " \n", "\n ", "\0", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
# Words that the byte pre-tokenizer leaves whole, whatever Unicode version it has.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_PLAIN = re.compile(" ?" + _LETTERS.pattern)
# Signs that the byte vocabulary writes bytes with, as printable bytes stand for themselves.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = dict(zip(sorted(set(range(256)) - set(_PRINTED)), range(256, 512)))
_open: dict[str, "Encoder"] = {}


def encoder(path: str, cache: int = CACHE) -> "Encoder":
    """The encoder of a file, shared by the tasks of a Python worker; ``cache`` is that of the first call."""
    if path not in _open:
        _open[path] = Encoder(path, cache)
    return _open[path]


class Encoder:
    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.lib, self.size = Tokenizer.from_file(path), cache
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = self.lib.get_vocab_size(with_added_tokens=True)
        self.kept: dict = {}
        plain = spec.get("post_processor") is None and spec.get("truncation") is None
        added = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"])
                    for t in spec.get("added_tokens", []))
        # Words of letters only, without a special token in them, go to the model itself.
        self.model = None if any(_LETTERS.fullmatch(t["content"]) for t in spec.get("added_tokens", [])) else self.lib.model
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        # "word": blanks vanish; "byte": a space belongs to the word after it, a line feed is a word
        self.kind = None
        if plain and added and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") \
                and norm is None:
            self.kind = "byte"
        elif plain and added and pre.get("type") == "Sequence" and norm and [n["type"] for n in norm.get("normalizers", [])] \
                == ["NFC", "Replace", "Lowercase"]:
            split, level = pre["pretokenizers"]
            if split.get("invert") and split.get("behavior") == "Removed" and r"[^\s" in split["pattern"].get("Regex", "") \
                    and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]:
                self.kind = "word"

    def _library(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list) -> dict:
        """Ids of words the cache does not have."""
        out = {}
        if self.kind == "byte" and self.model:
            for w in filter(_PLAIN.fullmatch, words):
                signs = w.replace(" ", "\u0120") if w.isascii() else w.encode().decode("latin-1").translate(_SIGNS)
                ids = [t.id for t in self.model.tokenize(signs)]
                out[w] = struct.pack(f"<{len(ids)}I", *ids)
        rest = [w for w in words if w not in out] if len(out) < len(words) else []
        if rest:
            out.update(zip(rest, self._library([w.decode() if isinstance(w, bytes) else w for w in rest])))
        return out

    def _resolve(self, words: list, got: list[bytes | None]) -> list[bytes]:
        """Ids of words, where those the cache had are given."""
        ids = self._new(list(dict.fromkeys(w for w, g in zip(words, got) if g is None)))
        if len(self.kept) < self.size:
            self.kept.update(ids)
        return [g if g is not None else ids[w] for w, g in zip(words, got)]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        marks = not _LOOSE.search(text)
        if self.kind == "word":
            words = (text.replace(",", " ,").replace(".", " .") if marks else text).encode().split()
        elif self.kind == "byte" and not any(map(text.__contains__, _CROWDED)) and not (text[0].isspace() or text[-1].isspace()):
            parted = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
            words = (parted.replace(",", "\0,").replace(".", "\0.") if marks else parted).split("\0")
        else:
            return self._library([text])[0]
        got = list(map(self.kept.get, words))
        return b"".join(self._resolve(words, got) if None in got else got)


def public(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
