"""Binary token files: an adaptive context-mixing range coder over token ids.

Ids are coded in blocks of ``BLOCK``, each from a reset state and with its own checksum. For every id
these predictors speak: the id that last followed the two before it (order 2), the id that last
followed the one before it (order 1), and, for order 0, the ids that the block has had of late, over a
floor of the segment's id frequencies, which its header holds. Adaptive weights, chosen by how
sure the first two are and whether they agree, mix them into one distribution, and a carryless range
coder of 64 bits codes the id under it in one step. The block's recent ids lie in a table of
``1 << _RECENT`` places by hash; what share of order 0 they get adapts from a reset too.

All blocks of a segment are coded side by side, one numpy lane each, so a step costs the same few
array operations however many blocks there are. A segment of more distinct ids than the floor can
tell apart is stored with a deflated plain block each, by the same checksums.

File: ``MAGIC``, then segments. Segment: a header of eight longs (documents, ids, bits of the floor or 0
for stored blocks, blocks, and the lengths of the four parts), then the parts, compressed with zlib but for
the last: document ids and sizes; ids of the floor and frequencies; words and checksum of each block;
the coded words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"CLIDS\x02\n\0"
#: Ids of a block.
BLOCK = 2048
_HEAD = struct.Struct("<8q")
_MIX_BITS = 12
_FLOOR_BITS, _MOST_FLOOR_BITS = 18, 20
_ONE, _TWO, _RECENT = 1 << 10, 1 << 11, 8
_U = np.uint64
_32, _LOW32 = _U(32), _U(0xFFFFFFFF)
_TOP = _U(1 << 32)
# Constants of the coder as arrays without dimensions, which numpy takes in half the time of a number of Python.
_1, _2, _3, _4, _8, _12, _15, _16, _31, _16_BITS, _1024, _3900, _3968, _4096 = (
    np.array(k, np.int32) for k in (1, 2, 3, 4, 8, 12, 15, 16, 31, 65535, 1024, 3900, 3968, 4096)
)
_M0, _M1, _M2 = np.array([40503, 0x9E3779B1, 0x85EBCA6B], np.uint32).view(np.int32)


def floor_bits(distinct: int) -> int:
    """Bits of the floor's frequencies, or 0 where there are too many distinct ids for it."""
    bits = max(_FLOOR_BITS, (2 * distinct - 1).bit_length())
    return bits if bits <= _MOST_FLOOR_BITS else 0


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Present ids, their frequencies, at least 1 each, of sum 2 ** bits, and bits."""
    count = np.bincount(ids)
    present = np.flatnonzero(count)
    bits = floor_bits(len(present))
    if not bits:
        return present, count[present], 0
    total = 1 << bits
    count = count[present].astype(np.float64)
    share = np.floor(count / count.sum() * (total - len(present))).astype(np.int64) + 1
    share[np.argmax(share)] += total - share.sum()
    return present, share, bits


def _mask(x: np.ndarray) -> np.ndarray:
    """All bits of 32 where true; selecting by bits takes a third of the time of ``np.where``."""
    return -x.view(np.int8).astype(np.int32)


def _run(n: int, floor: tuple[np.ndarray, np.ndarray, int], ids: np.ndarray | None, words: np.ndarray | None, firsts: np.ndarray | None):
    """Code ``ids``, or decode them from ``words``; the model is the same code for both."""
    present, share, bits = floor
    lanes = -(-n // BLOCK)
    last = n - (lanes - 1) * BLOCK
    size = int(present[-1]) + 1
    spans = np.zeros(size, np.uint64)  # of each id in the floor: its start in the upper half, its frequency in the lower
    spans[present] = ((np.cumsum(share) - share) << 32) | share
    bits_, all_bits = _U(bits), _U(bits + _MIX_BITS)
    most, last_slot = _U((1 << bits + _MIX_BITS) - 1), (1 << bits) - 1
    cell = bits - _RECENT  # a recent id has 1 / 2 ** _RECENT of what the recent ones have
    whole, cell_, near_bits, near_span = _U(1 << bits), _U(cell), _U(cell + 32), _U(1 << cell)
    decoding = ids is None
    row = np.arange(lanes, dtype=np.int64)
    lane_type = np.uint16 if lanes <= 1 << 16 else np.int64  # 16 bits are sorted by radix
    if decoding:
        slots = np.repeat(present.astype(np.int32), share)
        words = np.concatenate((words, np.zeros(4, np.uint32))).astype(np.uint64)
        at = firsts.astype(np.int64)
        code = (words[at] << _32) | words[at + 1]
        at = at + 2
        out = np.zeros((BLOCK, lanes), np.int32)
    else:
        grid = np.zeros((lanes, BLOCK), np.int32)
        grid.ravel()[:n] = ids
        grid = np.ascontiguousarray(grid.T)
        lane_of, written = [], []  # words in the order of steps
    table = np.full(lanes * (_ONE + _TWO), -4, np.int32)  # orders 1 and 2
    recent = np.full(lanes << _RECENT, -1, np.int32)
    # confidence in order 1 (lower half) and order 2 (upper half); in recent ids
    sure, sure0 = np.full(lanes * 32, -(32768 << 16) | 16384, np.int32), np.full(lanes, 16384, np.int32)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    b1, b2, m1 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    rows, row32, row0 = np.stack((row * _ONE, row * _TWO + lanes * _ONE)), row * 32, row << _RECENT
    one_mask, two_mask, recent_mask = (np.array(k - 1, np.int32) for k in (_ONE, _TWO, 1 << _RECENT))
    for t in range(min(BLOCK, n)):
        if t == last and lanes > 1:  # the last block ends
            lanes -= 1
            rows = np.ascontiguousarray(rows[:, :lanes])
            row32, row0, b1, b2, m1, sure0 = (x[:lanes] for x in (row32, row0, b1, b2, m1, sure0))
            if decoding:
                code, at = code[:lanes], at[:lanes]
            else:
                final = low[lanes:]
            low, span = low[:lanes], span[:lanes]
        # hashes are of bits that 32-bit products hold
        cells = np.empty(rows.shape, np.int64)
        cells[0] = ((b1 * _M0) >> _3) & one_mask
        cells[1] = ((m1 + b2 * _M2) >> _15) & two_mask
        cells += rows
        e = table[cells]
        p, s = e >> _2, e & _3
        p1, p2 = p
        s1, s2 = s
        kind = ((s2 << _3) + (s1 << _1) - _mask(p1 == p2)).astype(np.int64)
        kind += row32
        a2 = sure[kind]
        a1, a2 = a2 & _16_BITS, (a2 >> _16) & _16_BITS
        q2 = ((a2 * _3900) >> _16) + _16
        q1 = ((a1 * (_3968 - q2)) >> _16) + _8
        q12 = q1 + q2
        qr = (((_4096 - q12) * (_1024 + sure0 - (sure0 >> _3))) >> _16) + _1  # of order 0, from 1/64 to 8/9 to the recent ids
        q12r = q12 + qr
        qz = _4096 - q12r
        part = span >> all_bits
        # which predictor, as masks: order 2 (by2), order 1 (by1), else (far) a recent id (near) or the floor
        if decoding:
            v = (code - low) // part
            v = np.minimum(v, most, out=v).view(np.int64)
            w = (v >> bits).astype(np.int32)
            by2, far = (w - q2) >> _31, ~((w - q12) >> _31)
            now = ((p1 ^ p2) & by2) ^ p1
            near = far & ((w - q12r) >> _31)
            # quotients of numbers below 2 ** 32 and 2 ** 12 are exact when cut from doubles
            x = ((v - (q12r.astype(np.int64) << bits)) / qz).astype(np.int64)
            np.minimum(np.maximum(x, 0, out=x), last_slot, out=x)
            now ^= (slots[x] ^ now) & (far ^ near)
            index = np.flatnonzero(near)
            spot = ((v[index] - (q12[index].astype(np.int64) << bits)) >> cell) // qr[index]
            now[index] = recent[row0[index] + np.minimum(spot, (1 << _RECENT) - 1)]  # -1, of the last span, in damaged streams
            out[t, :lanes] = now
        else:
            now = grid[t, :lanes]
        same = _mask(p == now)
        m1 = now * _M1
        place = ((m1 >> _12) & recent_mask).astype(np.int64)
        kept = place + row0
        own, floor_shares = spans[now], qz.astype(np.uint64)
        if not decoding:
            by2 = same[1]
            far = ~(same[0] | by2)
            # a recent id is coded as such where that takes fewer bits than the floor
            cheap = (qr.astype(np.uint64) << cell_) > (own & _LOW32) * floor_shares
            cheap &= recent[kept] == now
            near = _mask(cheap) & far
        by1 = ~(far | by2)
        # the predictor's first of 4096 shares, the number of its shares, and the id's span in each of them
        first = (by1 & q2) | (far & q12r)
        first -= near & qr
        shares = (by1 & q1) | (by2 & q2) | (far & (qz ^ ((qz ^ qr) & near)))
        wide = far.astype(np.int64).view(np.uint64)
        own = ((own ^ whole) & wide) ^ whole
        wide = near.astype(np.int64).view(np.uint64)
        own ^= (own ^ ((place.view(np.uint64) << near_bits) | near_span)) & wide
        shares = shares.astype(np.uint64)
        begin = first.astype(np.uint64)
        begin <<= bits_
        begin += (own >> _32) * shares
        begin *= part
        low = low + begin
        own &= _LOW32
        own *= shares
        span = part * own
        go = np.flatnonzero(span <= _TOP)
        if len(go):
            bound, left = low[go], span[go]
            alike = ((bound ^ (bound + left - _U(1))) >> _32) == 0
            if left.max() == _TOP:  # such a span stays, unless its upper words are the same
                moves = alike | (left < _TOP)
                go, bound, left, alike = go[moves], bound[moves], left[moves], alike[moves]
            left = np.where(alike, np.minimum(left, _LOW32), (_U(0) - bound) & _LOW32)
            if decoding:
                ahead = at[go]
                code[go] = (code[go] << _32) | words[np.minimum(ahead, len(words) - 1)]  # a damaged stream may ask for more
                at[go] = ahead + 1
            else:
                lane_of.append(go.astype(lane_type))
                written.append((bound >> _32).astype(np.uint32))
            low[go] = bound << _32
            span[go] = left << _32
        # what each predictor learns: its weight, then its confidence or its new id
        a2 += ((by2 & _16_BITS) - a2) >> _4
        a1 += ((by1 & _16_BITS) - a1) >> _4
        sure[kind] = (a2 << _16) | a1
        step = ((sure0 ^ near) & _16_BITS) >> _4  # up to 65535 if near, else down
        step ^= ~near
        step += _1 + near
        sure0 += step & far
        level = s + ~(same << _1)  # one up or down
        fresh = level >> _31
        e ^= s
        e ^= (e ^ (now << _2)) & fresh
        level &= ~fresh
        level -= level >> _2  # at most 3
        e |= level
        table[cells] = e
        recent[kept] = now
        b2, b1 = b1, now
    if decoding:
        return np.ascontiguousarray(out.T).ravel()[:n]
    if len(low) < len(row):
        low = np.concatenate((low, final))
    for words in (low >> _32, low & _LOW32):
        lane_of.append(row.astype(lane_type))
        written.append(words.astype(np.uint32))
    lane_of = np.concatenate(lane_of)
    return np.concatenate(written)[np.argsort(lane_of, kind="stable")], np.bincount(lane_of)


def encode_segment(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment of whole documents; ``ids`` are those of all documents in order."""
    n = len(ids)
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + sizes.astype("<i8").tobytes(), 1)
    if n == 0:
        return _HEAD.pack(len(doc_ids), 0, 0, 0, len(docs), 0, 0, 0) + docs
    floor = frequencies(ids)
    plain = memoryview(ids.astype("<u4")).cast("B")
    blocks = [plain[i : i + BLOCK * 4] for i in range(0, n * 4, BLOCK * 4)]
    sums = [zlib.crc32(b) for b in blocks]
    if floor[2]:
        words, lengths = _run(n, floor, ids, None, None)
        model = zlib.compress(np.diff(floor[0], prepend=0).astype("<u4").tobytes() + floor[1].astype("<u4").tobytes(), 1)
        body = words.astype("<u4").tobytes()
    else:
        stored = [zlib.compress(b, 6) for b in blocks]
        model, lengths, body = b"", [len(x) for x in stored], b"".join(stored)
    index = zlib.compress(np.array(lengths, "<u4").tobytes() + np.array(sums, "<u4").tobytes(), 1)
    return b"".join((_HEAD.pack(len(doc_ids), n, floor[2], len(sums), len(docs), len(model), len(index), len(body)), docs, model, index, body))


def decode_segments(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, sizes and ids of each segment of an open file. ValueError if a checksum differs."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    while head := stream.read(_HEAD.size):
        if len(head) < _HEAD.size:
            raise ValueError("the file ends within a segment")
        n_docs, n, bits, blocks, *lengths = _HEAD.unpack(head)
        docs, model, index, body = (stream.read(k) for k in lengths)
        if len(body) < lengths[3]:
            raise ValueError("the file ends within a segment")
        docs = np.frombuffer(zlib.decompress(docs), "<i8")
        if n == 0:
            yield docs[:n_docs], docs[n_docs:], np.zeros(0, np.int32)
            continue
        size, sums = np.frombuffer(zlib.decompress(index), "<u4").reshape(2, blocks).astype(np.int64)
        if bits:
            model = np.frombuffer(zlib.decompress(model), "<u4").astype(np.int64)
            half = len(model) // 2
            ids = _run(n, (np.cumsum(model[:half]), model[half:], bits), None, np.frombuffer(body, "<u4"), np.cumsum(size) - size)
        else:
            at = [0, *np.cumsum(size).tolist()]
            try:
                ids = np.frombuffer(b"".join(zlib.decompress(body[a:b]) for a, b in zip(at, at[1:])), "<u4").astype(np.int64)
            except zlib.error as error:
                raise ValueError(f"a stored block is damaged: {error}") from None
        plain = memoryview(ids.astype("<u4")).cast("B")
        for i, x in enumerate(sums.tolist()):
            if zlib.crc32(plain[i * BLOCK * 4 : (i + 1) * BLOCK * 4]) != x:
                raise ValueError(f"block {i} of a segment is damaged")
        yield docs[:n_docs], docs[n_docs:], ids
