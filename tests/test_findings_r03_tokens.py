"""Findings of round 3, op10: what is encoded, and how often."""

import numpy as np

from factloom.llm import queries, token_output


class Counted:
    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode(self, *args, **named):
        self.calls += 1
        return self.inner.encode(*args, **named)

    def tokenize(self, *args):
        self.calls += 1
        return self.inner.tokenize(*args)


def test_each_distinct_piece_is_encoded_once():
    """Also of texts with odd white space and marks, where nothing is kept, and where words differ by their marks alone."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path())
    given = ["the  same, words### of a text.\n\n(again)", "same### words$$$ the&&& of.\na text", "über　the words*** <|endoftext|>of a"] * 100
    expected = [own.encode(t, add_special_tokens=False).ids for t in given]
    for kept in (token_output.KEPT, 0):
        enc = token_output.Encoder(queries.tokenizer_path(), kept)
        tokenizer, model = Counted(enc.kept.tokenizer), Counted(enc.kept.model)
        enc.kept.tokenizer, enc.kept.model = tokenizer, model
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(given)] == expected
        assert tokenizer.calls + model.calls <= 30


def test_words_behind_the_first_are_found(monkeypatch):
    """The few that are looked up first, the others that are kept, and those that there is no room for."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path())
    monkeypatch.setattr(token_output, "HOT", 5)
    enc = token_output.Encoder(queries.tokenizer_path(), 20)
    for at in (0, 15, 5, 60, 0):
        given = [f"word{n} of{n % 7},\nand x{n * n}." for n in range(at, at + 12)] + ["", "y" * 100]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(given)] == [own.encode(t, add_special_tokens=False).ids for t in given]
    assert len(enc.kept.words) == 20
