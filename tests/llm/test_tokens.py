import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import LONG
from voxmart.llm import tokens

HARD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "a b c", "it's we'll I'd, don't.", "x\ty", "<|endoftext|> a <|startoftext|>b",
        "12 3.5 ß,Ö. é. É, ª, á, ñ ö.", "A.\nB,\nC", "naïve Ünïcode 🙂🙂 , . ,. .,", "ΣΑΣ İI ΟΔΟΣ", "\x1c a\x85b  c",
        "word, word. Word, WORD. word,, word.,", LONG, "x" * 5000, "''s 's,", "東京, 東京. 日本"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("cache", [0, 5, 10**6])
def test_ids_are_those_of_the_library(name, cache, documents):
    path = tokens.public(name)
    lib, enc = Tokenizer.from_file(path), tokens.Encoder(path, cache)
    assert enc.kind in ("byte", "word")
    texts = HARD + [r.text for r in documents.collect()]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]


def test_random_texts():
    rng = random.Random(4)
    parts = ["a", "Bc", "é", "1", "22", ".", ",", "'s", "'", " ", " ", "\n", "\t", " ", "🙂", "́", "-", "<|endoftext|>", "\x1c"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        lib, enc = Tokenizer.from_file(tokens.public(name)), tokens.Encoder(tokens.public(name))
        for _ in range(3000):
            t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_signs_after_something_else_than_a_letter_or_digit_are_noticed():
    import itertools

    for text in map("".join, itertools.chain.from_iterable(itertools.product("a1_.,\u00e9 \n", repeat=n) for n in range(5))):
        loose = any(c in ".," and not (i and text[i - 1].isalnum()) for i, c in enumerate(text))
        assert bool(tokens._LOOSE.search(text)) == loose, text


def test_words_of_letters_go_to_the_model_alone(monkeypatch):
    path = tokens.public("byte_bpe_50k.json")
    lib, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    text = "naive naïve Übermäßig \u00e9reè ÀÖØöøÿĀſƀɏ " + " ".join(map(chr, [*range(0xc0, 0xd7), *range(0xd8, 0xf7), *range(0xf8, 0x250)]))
    want = lib.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(enc, "_library", None)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == want


def test_signs_of_bytes_are_those_of_the_library():
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for c in map(chr, [*range(1, 0x800), 0x1f642]):
        assert level.pre_tokenize_str(c)[0][0] == c.encode().decode("latin-1").translate(tokens._SIGNS), c
