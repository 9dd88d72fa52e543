"""The word-wise encoder against the library on whole texts."""

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import words
from tokenizers import Tokenizer

from spillway.llm.tokens import WordEncoder

ODD = [
    "", "a", " ", "\n", " a", "a ", "a\n", "\na", "a  b", "a \n b", "x\ty", "don't stop's it's. 's.",
    "Ⅷ ﬁ é à", "é a ́b", "foo\xa0bar", "<|endoftext|> a<|endoftext|>b", "<|startoftext|>x <|ENDOFTEXT|>.", "A. a. B, b.. c.d. .e", "a\x1cb", "naïve 日本語 テスト 12345 ab12",
    "\n\n\nx", "a\n\nb", "😀 x😀y 👩‍👩‍👧", " ́x", "A.B,C!\nD", "word. word, word!! WORD... ΑΣ ΣΑΣ İstanbul ǅ Straße. ﬀ",
    "Ünï. Ö, ŉ ǰ ẞ", "a. b, c? d; e: f! .. ,a", "ªº µ ﬁ. ① ²", "́", "x" * 3000,
]


@pytest.mark.parametrize("name, blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_same_as_library(name, blanks, monkeypatch):
    monkeypatch.setattr("spillway.llm.tokens.WORDS_KEPT", 50)  # memories turn over
    own = WordEncoder(public_tokenizers.path(name), blanks, 5)
    library = Tokenizer.from_file(public_tokenizers.path(name))  # as it comes
    for _ in range(2):
        for text in [*ODD, *(words(n, 200) for n in range(5))]:
            expected = library.encode(text, add_special_tokens=False)
            assert np.frombuffer(own.ids([text])[0], own.kind).tolist() == [*expected.ids, 5]
            if blanks:
                ids, spans = own.ids_and_spans([text])[0]
                assert ids.tolist() == expected.ids
                assert [tuple(s) for s in spans.tolist()] == expected.offsets


@pytest.mark.parametrize("name, blanks_count", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_a_word_with_symbols_behind_it_is_made_from_both(name, blanks_count):
    """As by the library, and only the symbols are remembered as runs, not every word before them."""
    path = public_tokenizers.path(name)
    own, library = WordEncoder(path, blanks_count), Tokenizer.from_file(path)
    stems = ("leen", "Straße", "ouè", "ÉÉN", "don't", "x1", "", "ª", "日本", "ΟΔΟΣ", "é")
    ends = ("***", ",###", "'", "''", "!?", "_", "-", "$$$.")
    texts = [f"{s}{e} {s}{e}\n{s}" for s in stems for e in ends]
    for text, ids in zip(texts, own.ids(texts)):
        assert np.frombuffer(ids, own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert {"***", ",###", "$$$."} <= set(own.runs) and not {"leen", " leen", "straße", " Straße"} & set(own.runs)


def test_words_of_a_group_are_looked_up_once(monkeypatch):
    """And each text has the library's ids, wherever groups and stretches of words end."""
    from spillway.llm import tokens

    texts = [*ODD, *(words(n % 7, 40 + n) for n in range(30)), "", " \n", "one", "x " * 90]
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    expected = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    for group, gathered in ((1 << 22, 1 << 18), (300, 17), (1, 1), (1 << 22, 64)):
        monkeypatch.setattr(tokens, "_GROUP", group, raising=False)
        monkeypatch.setattr(tokens, "_GATHERED", gathered, raising=False)
        own = tokens.WordEncoder(path, False, 1)
        assert [np.frombuffer(x, own.kind).tolist() for x in own.ids(texts)] == expected

    class Counted(tokens.Memory):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    monkeypatch.setattr(tokens, "_GROUP", 1 << 22, raising=False)
    own.at_start = Counted(own.at_start.find)
    own.ids(["some words and some more"] * 50)
    assert Counted.asked == 4


def test_words_end_at_the_same_white_space():
    import pyarrow as pa
    import pyarrow.compute as pc

    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"a{c}b" for c in marks]))).to_pylist()
    assert [n == 2 for n in found] == [len(f"a{c}b".split()) == 2 for c in marks]
