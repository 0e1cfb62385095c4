"""Decoding of bytes in pieces."""

from lamina.llm import bpe


def test_whole_characters_are_decoded_together(monkeypatch):
    coder = bpe.byte_bpe(*bpe.vocabulary())
    text = "дом 你好 🙂 naïvé ไทย " * 50
    ids = coder.encode(text)

    def room(pending):
        raise AssertionError("a byte by itself")

    monkeypatch.setattr(bpe.Utf8, "_room", staticmethod(room))
    assert coder.decode(ids) == text


def test_pieces_of_bytes_decode_like_the_whole():
    data = "aé你🙂".encode() + b"\xff\xe4\xbd" + "🙂".encode()[:3] + b"z\xc3"
    for a in range(len(data) + 1):
        for b in range(a, len(data) + 1):
            machine = bpe.Utf8()
            assert machine.feed(data[:a]) + machine.feed(data[a:b]) + machine.feed(data[b:]) + machine.end() == data.decode(errors="replace")
