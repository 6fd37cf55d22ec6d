"""Codecs of block files: timestamps, floats, integers, unsigned integers, booleans, strings.

Each codec works on the arrays of a whole block.  What depends on the value
before it (the words of packed values while encoding, floats, the lengths of
strings) is a loop that is linear in the block.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

# Packed words, (values in a word, bits of a value); the first two hold ones only.
PACKINGS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
# The largest packed value, the largest scale of timestamps, the bits that end floats.
MOST_PACKED = (1 << 60) - 1
LARGEST_SCALE = 10**12
END_OF_FLOATS = 0x7FF8000000000001
# Encodings, in the high half of a first byte.
RAW, PACKED, REPEATED = 0, 1, 2

_MASK = (1 << 64) - 1


class CodecError(ValueError):
    """Bytes that don't decode, or values that can't be encoded."""


def put_varint(v: int) -> bytes:
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def get_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, where it ends)."""
    v = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CodecError("unfinished variable-length integer")
        b = data[at]
        at += 1
        v |= (b & 0x7F) << shift
        if b < 0x80:
            return v & _MASK, at
        shift += 7


def zigzag(v: int) -> int:
    return (v << 1 ^ v >> 63) & _MASK


def unzigzag(v: int) -> int:
    return v >> 1 ^ -(v & 1)


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


# -- packed words ---------------------------------------------------------------------

_ANY = list[int] | np.ndarray


def _words(values: _ANY) -> np.ndarray:
    """Integers of either sign as 64-bit words."""
    if isinstance(values, np.ndarray):
        return values.astype(np.int64).view(np.uint64) if values.dtype.kind == "i" else values.astype(np.uint64)
    return np.array([v & _MASK for v in values], np.uint64)


def _widths(words: np.ndarray) -> np.ndarray:
    """Bits of each word's value."""
    out = np.zeros(len(words), np.int64)
    rest = words.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << step)
        out[big] += step
        rest[big] >>= np.uint64(step)
    return out + (rest > 0)


def pack(values: _ANY) -> bytes:
    """Words of 64 bits, each with as many values as fit."""
    words = _words(values)
    width = _widths(words)
    if len(words) and width.max() > 60:
        raise CodecError("value too large to be packed")
    # from each place on: how many ones follow one another
    other = np.append(np.flatnonzero(words != 1), len(words))
    out, at = [], 0
    while at < len(words):
        left = len(words) - at
        for selector, (n, bits) in enumerate(PACKINGS):
            if n > left:
                continue
            if other[np.searchsorted(other, at)] - at >= n if bits == 0 else width[at : at + n].max() <= bits:
                word = selector << 60
                if bits:
                    word |= int(np.bitwise_or.reduce(words[at : at + n] << (np.arange(n, dtype=np.uint64) * np.uint64(bits))))
                out.append(word)
                at += n
                break
    return struct.pack(f">{len(out)}Q", *out)


def _selected(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, selectors, where the values of each begin)."""
    if len(data) % 8:
        raise CodecError("packed words are cut off")
    words = np.frombuffer(data, ">u8").astype(np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    return words, selectors, np.concatenate([[0], np.cumsum(_COUNTS[selectors])])


_COUNTS = np.array([n for n, _ in PACKINGS])


def _parts(data: bytes):
    """(where, values) of all words of one kind; values has a row a word."""
    words, selectors, first = _selected(data)
    for s in np.unique(selectors).tolist():
        n, bits = PACKINGS[s]
        of = selectors == s
        where = first[:-1][of][:, None] + np.arange(n)
        if bits:
            yield where, words[of][:, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(bits)) & np.uint64((1 << bits) - 1)
        else:
            yield where, np.ones(where.shape, np.uint64)


def unpack_words(data: bytes) -> np.ndarray:
    out = np.empty(count_packed(data), np.uint64)
    for where, values in _parts(data):
        out[where] = values
    return out


def unpack(data: bytes) -> list[int]:
    return unpack_words(data).tolist()


def count_packed(data: bytes) -> int:
    """How many values packed words hold, without unpacking them."""
    return int(_selected(data)[2][-1])


def count_packed_between(data: bytes, low: int, high: int) -> int:
    """How many of the packed values lie from low to high, without putting them in order."""
    if high < 0 or low > high:
        return 0
    low, top = np.uint64(max(low, 0)), np.uint64(min(high, _MASK))
    return sum(int(((v >= low) & (v <= top)).sum()) for _, v in _parts(data))


# -- timestamps --------------------------------------------------------------------------


def encode_times(times: _ANY) -> bytes:
    """Sorted nanoseconds: equal steps as one, else scaled and packed steps, else as they are."""
    t = _words(times)
    if not len(t):
        return b""
    first = struct.pack(">Q", int(t[0]))
    steps = t[1:] - t[:-1]
    power = next(p for p in range(len(str(LARGEST_SCALE)) - 1, -1, -1) if not (steps % np.uint64(10**p)).any())
    scale = np.uint64(10**power)
    if len(steps) and (steps == steps[0]).all():
        return bytes([REPEATED << 4 | power]) + first + put_varint(int(steps[0] // scale)) + put_varint(len(t))
    if len(steps) and steps.max() > MOST_PACKED:
        return bytes([RAW << 4]) + first + steps.astype(">u8").tobytes()
    return bytes([PACKED << 4 | power]) + first + pack(steps // scale)


def times_of(data: bytes) -> np.ndarray:
    """The timestamps as 64-bit integers."""
    if not data:
        return np.empty(0, np.int64)
    kind, scale = data[0] >> 4, np.uint64(10 ** (data[0] & 15))
    if len(data) < 9 or (kind == RAW and len(data) % 8 != 1):
        raise CodecError("timestamps are cut off")
    first = np.frombuffer(data, ">u8", 1, 1).astype(np.uint64)
    if kind == REPEATED:
        step, at = get_varint(data, 9)
        count, _ = get_varint(data, at)
        steps = np.concatenate([first, np.full(max(count - 1, 0), np.uint64(step) * scale, np.uint64)])[:count]
    elif kind == RAW:
        steps = np.frombuffer(data, ">u8", -1, 1).astype(np.uint64)
    elif kind == PACKED:
        steps = np.concatenate([first, unpack_words(data[9:]) * scale])
    else:
        raise CodecError(f"unknown encoding {kind}")
    return np.cumsum(steps, dtype=np.uint64).view(np.int64)


def decode_times(data: bytes) -> list[int]:
    return times_of(data).tolist()


def count_times(data: bytes) -> int:
    """The number of timestamps, without decoding them."""
    if not data:
        return 0
    kind = data[0] >> 4
    if kind == RAW:
        return (len(data) - 1) // 8
    if kind == REPEATED:
        return get_varint(data, get_varint(data, 9)[1])[0]
    return 1 + count_packed(data[9:])


# -- integers ------------------------------------------------------------------------------


def encode_integers(values: _ANY) -> bytes:
    v = _words(values)
    if not len(v):
        return b""
    d = np.diff(v, prepend=np.uint64(0)).view(np.int64)
    steps = (d << 1 ^ d >> 63).view(np.uint64)
    if len(steps) > 2 and (steps[1:] == steps[1]).all():
        return bytes([REPEATED << 4]) + struct.pack(">Q", int(steps[0])) + put_varint(int(steps[1])) + put_varint(len(steps))
    if steps.max() > MOST_PACKED:
        return bytes([RAW << 4]) + steps.astype(">u8").tobytes()
    return bytes([PACKED << 4]) + struct.pack(">Q", int(steps[0])) + pack(steps[1:])


def integers_of(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    kind = data[0] >> 4
    if len(data) < 9 or (kind == RAW and len(data) % 8 != 1):
        raise CodecError("integers are cut off")
    first = np.frombuffer(data, ">u8", 1, 1).astype(np.uint64)
    if kind == REPEATED:
        step, at = get_varint(data, 9)
        count, _ = get_varint(data, at)
        steps = np.concatenate([first, np.full(max(count - 1, 0), step, np.uint64)])[: max(count, 1)]
    elif kind == RAW:
        steps = np.frombuffer(data, ">u8", -1, 1).astype(np.uint64)
    elif kind == PACKED:
        steps = np.concatenate([first, unpack_words(data[9:])])
    else:
        raise CodecError(f"unknown encoding {kind}")
    d = steps >> np.uint64(1) ^ (~(steps & np.uint64(1)) + np.uint64(1))
    return np.cumsum(d, dtype=np.uint64).view(np.int64)


def decode_integers(data: bytes) -> list[int]:
    return integers_of(data).tolist()


def encode_unsigned(values: _ANY) -> bytes:
    return encode_integers(_words(values))


def unsigned_of(data: bytes) -> np.ndarray:
    return integers_of(data).view(np.uint64)


def decode_unsigned(data: bytes) -> list[int]:
    return unsigned_of(data).tolist()


# -- booleans and strings --------------------------------------------------------------------


def encode_booleans(values: list[bool] | np.ndarray) -> bytes:
    return bytes([PACKED << 4]) + put_varint(len(values)) + np.packbits(np.asarray(values, bool)).tobytes()


def booleans_of(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, bool)
    if data[0] >> 4 != PACKED:
        raise CodecError(f"unknown encoding {data[0] >> 4}")
    n, at = get_varint(data, 1)
    if len(data) - at < -(-n // 8):
        raise CodecError("booleans are cut off")
    return np.unpackbits(np.frombuffer(data, np.uint8, -1, at), count=n).astype(bool) if n else np.empty(0, bool)


def decode_booleans(data: bytes) -> list[bool]:
    return booleans_of(data).tolist()


def encode_strings(values: list[str]) -> bytes:
    whole = b"".join(put_varint(len(b)) + b for b in (v.encode() for v in values))
    return bytes([PACKED << 4]) + pa.compress(whole, codec="snappy", asbytes=True)


def decode_strings(data: bytes) -> list[str]:
    if not data:
        return []
    if data[0] >> 4 != PACKED:
        raise CodecError(f"unknown encoding {data[0] >> 4}")
    size, _ = get_varint(data, 1)
    try:
        whole = pa.decompress(data[1:], decompressed_size=size, codec="snappy", asbytes=True) if size else b""
    except (pa.ArrowException, OSError) as e:
        raise CodecError("strings don't decompress") from e
    out, at = [], 0
    while at < len(whole):
        n = whole[at]
        at += 1
        if n >= 0x80:
            n, at = get_varint(whole, at - 1)
        if at + n > len(whole):
            raise CodecError("strings are cut off")
        out.append(whole[at : at + n].decode(errors="replace"))
        at += n
    return out


# -- floats -----------------------------------------------------------------------------------


def encode_floats(values: list[float] | np.ndarray) -> bytes:
    """Each value as the bits in which it differs from the one before.  NaN can't be stored."""
    v = np.asarray(values, np.float64)
    if np.isnan(v).any():
        raise CodecError("unsupported value: NaN")
    words = np.append(v.view(np.uint64), np.uint64(END_OF_FLOATS))
    x = words[1:] ^ words[:-1]
    leads = (64 - _widths(x)) & 31
    trails = _widths(x & (~x + np.uint64(1))) - 1
    # (bits to write, how many) of all values, put together at the end
    pieces, sizes = [int(words[0])], [64]
    lead = trail = None
    for bits, a, b in zip(x.tolist(), leads.tolist(), trails.tolist()):
        if not bits:
            pieces.append(0)
            sizes.append(1)
            continue
        if lead is not None and a >= lead and b >= trail:
            pieces.append(0b10)
            sizes.append(2)
        else:
            lead, trail = a, b
            pieces.append((0b11 << 5 | a) << 6 | (64 - a - b) & 63)
            sizes.append(13)
        pieces.append(bits >> trail)
        sizes.append(64 - lead - trail)
    size = np.array(sizes)
    owner = np.repeat(np.arange(len(size)), size)
    shift = np.cumsum(size)[owner] - 1 - np.arange(len(owner))
    flags = np.array(pieces, np.uint64)[owner] >> shift.astype(np.uint64) & np.uint64(1)
    return bytes([PACKED << 4]) + np.packbits(flags.astype(np.uint8)).tobytes()


def floats_of(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0)
    if data[0] >> 4 != PACKED:
        raise CodecError(f"unknown encoding {data[0] >> 4}")
    size = 8 * (len(data) - 1)
    if size < 64:
        raise CodecError("floats are cut off")
    # words with the next one beside them: any 64 bits are a shift of one pair
    words = np.frombuffer(data[1:] + bytes(-(len(data) - 1) % 8 + 16), ">u8").tolist()
    word, at, out, lead, width = words[0], 64, [], 0, 64
    while word != END_OF_FLOATS:
        out.append(word)
        here = at >> 6
        # what a value begins with is at most 13 bits
        start = (words[here] << 64 | words[here + 1]) >> 115 - (at & 63) & 0x1FFF
        if start < 0x1000:
            at += 1
        else:
            if start < 0x1800:
                at += 2
            else:
                lead, width = start >> 6 & 31, start & 63 or 64
                if lead + width > 64:
                    raise CodecError("floats with more bits than a word")
                at += 13
            here = at >> 6
            if at + width > size:
                raise CodecError("floats are cut off")
            word ^= ((words[here] << 64 | words[here + 1]) >> 128 - (at & 63) - width & (1 << width) - 1) << 64 - lead - width
            at += width
        if at > size:
            raise CodecError("floats are cut off")
    return np.array(out, np.uint64).view(np.float64)


def decode_floats(data: bytes) -> list[float]:
    return floats_of(data).tolist()


# -- blocks -------------------------------------------------------------------------------------

# The types of blocks.
TYPES = ("float", "integer", "boolean", "string", "unsigned")
_ENCODE = {"float": encode_floats, "integer": encode_integers, "boolean": encode_booleans, "string": encode_strings, "unsigned": encode_unsigned}
_ARRAY = {"float": floats_of, "integer": integers_of, "boolean": booleans_of, "string": decode_strings, "unsigned": unsigned_of}


def encode_block(kind: str, times: _ANY, values: list | np.ndarray) -> bytes:
    """Type, length of the timestamps, timestamps, values."""
    if len(times) != len(values):
        raise CodecError("as many times as values are needed")
    ts = encode_times(times)
    return bytes([TYPES.index(kind)]) + put_varint(len(ts)) + ts + _ENCODE[kind](values)


def _split(block: bytes) -> tuple[str, bytes, bytes]:
    if not block or block[0] >= len(TYPES):
        raise CodecError("unknown type of block")
    n, at = get_varint(block, 1)
    return TYPES[block[0]], block[at : at + n], block[at + n :]


def block_arrays(block: bytes, kind: str | None = None) -> tuple[str, np.ndarray, np.ndarray | list[str]]:
    """(type, times, values) as arrays, strings as a list; ``kind`` demands a type."""
    found, ts, values = _split(block)
    if kind is not None and kind != found:
        raise CodecError(f"block of {found} values, not {kind}")
    times, decoded = times_of(ts), _ARRAY[found](values)
    if len(decoded) < len(times):
        raise CodecError("a block has fewer values than times")
    return found, times, decoded[: len(times)]


def decode_block(block: bytes, kind: str | None = None) -> tuple[str, list[int], list]:
    """As ``block_arrays``, in plain lists."""
    found, times, values = block_arrays(block, kind)
    return found, times.tolist(), values if isinstance(values, list) else values.tolist()


def block_count(block: bytes) -> int:
    """The number of points of a block, without decoding it."""
    return count_times(_split(block)[1])
