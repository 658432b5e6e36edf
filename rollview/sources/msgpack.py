"""The MessagePack format: values to bytes and back, for rows that hosts send and records that they receive."""

from __future__ import annotations

import struct
from typing import Any

from ..errors import InvalidOperation


def pack(value: Any) -> bytes:
    """``value`` in its shortest form. Integers beyond 64 bits are written as 32 bytes, most significant first."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 1 << 64:
            return bytes([value]) if value < 128 else _sized(value, b"\xcc\xcd\xce\xcf", ">B", ">H", ">I", ">Q")
        if -(1 << 63) <= value < 0:
            if value >= -32:
                return struct.pack(">b", value)
            code, form = next((c, f) for c, f, n in ((0xD0, ">b", 7), (0xD1, ">h", 15), (0xD2, ">i", 31), (0xD3, ">q", 63)) if value >= -(1 << n))
            return bytes([code]) + struct.pack(form, value)
        if 0 <= value < 1 << 256:
            return pack(value.to_bytes(32, "big"))
        raise InvalidOperation(f"an integer of {value.bit_length()} bits does not fit")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else _sized(len(raw), b"\xd9\xda\xdb", ">B", ">H", ">I")) + raw
    if isinstance(value, (bytes, bytearray)):
        return _sized(len(value), b"\xc4\xc5\xc6", ">B", ">H", ">I") + bytes(value)
    if isinstance(value, dict):
        head = bytes([0x80 | len(value)]) if len(value) < 16 else _sized(len(value), b"\xde\xdf", ">H", ">I")
        return head + b"".join(pack(k) + pack(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        head = bytes([0x90 | len(value)]) if len(value) < 16 else _sized(len(value), b"\xdc\xdd", ">H", ">I")
        return head + b"".join(map(pack, value))
    raise InvalidOperation(f"{type(value).__name__} has no MessagePack form")


def _sized(n: int, codes: bytes, *forms: str) -> bytes:
    for code, form in zip(codes, forms, strict=True):
        if n < 1 << 8 * struct.calcsize(form):
            return bytes([code]) + struct.pack(form, n)
    raise InvalidOperation("a value is too long")


#: Codes of numbers with their layout, and of strings, bytes, lists and maps with the layout of their length.
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LENGTHS = {
    0xC4: ("bytes", ">B"), 0xC5: ("bytes", ">H"), 0xC6: ("bytes", ">I"), 0xD9: ("text", ">B"), 0xDA: ("text", ">H"), 0xDB: ("text", ">I"),
    0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I"),
}


def unpack(data: bytes) -> Any:
    """The one value that ``data`` holds."""
    value, at = _read(memoryview(data), 0)
    if at != len(data):
        raise InvalidOperation("bytes after the end of a MessagePack value")
    return value


def _read(data: memoryview, at: int) -> tuple[Any, int]:
    try:
        code = data[at]
        at += 1
        if code < 0x80 or code >= 0xE0:
            return code if code < 0x80 else code - 256, at
        if code in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
        if form := _NUMBERS.get(code):
            return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
        if code < 0xC0:
            kind, n = ("map", code & 15) if code < 0x90 else ("list", code & 15) if code < 0xA0 else ("text", code & 31)
        elif code in _LENGTHS:
            kind, form = _LENGTHS[code]
            n, at = struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
        else:
            raise InvalidOperation(f"MessagePack code {code:#x} is not known")
        if kind in ("bytes", "text"):
            if at + n > len(data):
                raise InvalidOperation("a MessagePack value is cut off")
            raw = bytes(data[at : at + n])
            return raw if kind == "bytes" else raw.decode(), at + n
        out: Any = {} if kind == "map" else []
        for _ in range(n):
            key, at = _read(data, at)
            if kind == "map":
                out[key], at = _read(data, at)
            else:
                out.append(key)
        return out, at
    except (IndexError, struct.error) as error:
        raise InvalidOperation("a MessagePack value is cut off") from error
