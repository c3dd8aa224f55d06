"""RESP-2: values to bytes and back, whole or as bytes come in."""

from __future__ import annotations


class Status(str):
    """A simple string."""


class Error(str):
    """An error."""


class Malformed(ValueError):
    """Bytes that are no RESP."""


#: Largest bulk string and array that are accepted.
MAX_BULK, MAX_ITEMS = 512 << 20, 1 << 20


def dump(value: object) -> bytes:
    """RESP-2 bytes of a Status, Error, int, bytes, None (a null bulk string) or list of these."""
    if isinstance(value, Status):
        return b"+" + value.encode() + b"\r\n"
    if isinstance(value, Error):
        return b"-" + value.encode() + b"\r\n"
    if value is None:
        return b"$-1\r\n"
    if isinstance(value, int):
        return b":%d\r\n" % value
    if isinstance(value, (bytes, bytearray)):
        return b"$%d\r\n%s\r\n" % (len(value), bytes(value))
    if isinstance(value, list):
        return b"*%d\r\n" % len(value) + b"".join(map(dump, value))
    raise TypeError(type(value).__name__)


class Parser:
    """Values from bytes that come in pieces: `feed`, then `next` until it answers that more is needed."""

    MORE = object()

    def __init__(self) -> None:
        self.buffer = bytearray()

    def feed(self, data: bytes) -> None:
        self.buffer += data

    def next(self) -> object:
        """The next value, or MORE. Whatever belongs to an unfinished value stays."""
        got = self._value(0)
        if got is None:
            return self.MORE
        value, end = got
        del self.buffer[:end]
        return value

    def _line(self, at: int) -> tuple[bytes, int] | None:
        end = self.buffer.find(b"\r\n", at)
        return None if end < 0 else (bytes(self.buffer[at:end]), end + 2)

    def _value(self, at: int) -> tuple[object, int] | None:
        if at >= len(self.buffer):
            return None
        kind = self.buffer[at : at + 1]
        line = self._line(at + 1)
        if line is None:
            return None
        text, at = line
        if kind == b"+":
            return Status(text.decode()), at
        if kind == b"-":
            return Error(text.decode()), at
        if kind not in (b":", b"$", b"*"):
            return [x for x in (bytes(kind) + text).split()], at  # an inline command
        try:
            n = int(text)
        except ValueError:
            raise Malformed(f"no number: {text[:20]!r}") from None
        if kind == b":":
            return n, at
        if n == -1:
            return None, at
        if n < 0 or n > (MAX_BULK if kind == b"$" else MAX_ITEMS):
            raise Malformed(f"length {n}")
        if kind == b"$":
            if len(self.buffer) < at + n + 2:
                return None
            if self.buffer[at + n : at + n + 2] != b"\r\n":
                raise Malformed("bulk string without an end")
            return bytes(self.buffer[at : at + n]), at + n + 2
        items = []
        for _ in range(n):
            got = self._value(at)
            if got is None:
                return None
            items.append(got[0])
            at = got[1]
        return items, at


def load(data: bytes) -> list[object]:
    """All whole values of `data`."""
    p = Parser()
    p.feed(data)
    out = []
    while (v := p.next()) is not Parser.MORE:
        out.append(v)
    return out
