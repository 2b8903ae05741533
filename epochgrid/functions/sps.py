"""Sequence parameter sets: size, sampling and colour of H.264 and H.265 video, bit by bit."""

from __future__ import annotations

from dataclasses import dataclass

from ..spec import IngestError

MAX_WIDTH, MAX_HEIGHT = 4096, 2160


class Bits:
    """Unsigned fields and Exp-Golomb codes of a payload without emulation prevention."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    @classmethod
    def of_unit(cls, unit: bytes, header: int) -> Bits:
        return cls(unit[header:].replace(b"\0\0\3", b"\0\0"))

    def u(self, n: int) -> int:
        out = 0
        for _ in range(n):
            byte = self.at >> 3
            if byte >= len(self.data):
                raise IngestError("parameter set is cut off")
            out = out << 1 | self.data[byte] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 32:
                raise IngestError("parameter set is malformed")
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


@dataclass(frozen=True)
class Sps:
    profile: int
    width: int
    height: int
    chroma: int
    luma_bits: int
    chroma_bits: int
    progressive: bool
    matrix: int = 2
    transfer: int = 2
    full: bool = False
    main: bool = True


def _video_signal(b: Bits) -> dict:
    """The start of the usability information, up to the colour description."""
    out = {}
    if b.u(1) and b.u(8) == 255:  # aspect ratio
        b.u(32)
    if b.u(1):  # overscan
        b.u(1)
    if b.u(1):
        b.u(3)
        out["full"] = bool(b.u(1))
        if b.u(1):
            b.u(8)
            out["transfer"], out["matrix"] = b.u(8), b.u(8)
    return out


#: Profiles of H.264 whose sets say how chroma is sampled.
_HIGH = frozenset((100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135))


def avc(unit: bytes) -> Sps:
    b = Bits.of_unit(unit, 1)
    profile = b.u(8)
    b.u(16)
    b.ue()
    chroma, luma_bits, chroma_bits, separate = 1, 8, 8, 0
    if profile in _HIGH:
        chroma = b.ue()
        if chroma == 3:
            separate = b.u(1)
        luma_bits, chroma_bits = 8 + b.ue(), 8 + b.ue()
        b.u(1)
        if b.u(1):
            for i in range(12 if chroma == 3 else 8):
                if b.u(1):
                    last = following = 8
                    for _ in range(16 if i < 6 else 64):
                        if following:
                            following = (last + b.se()) % 256
                        last = following or last
    b.ue()
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.u(1)
        b.se()
        b.se()
        for _ in range(min(b.ue(), 255)):
            b.se()
    b.ue()
    b.u(1)
    columns, rows = b.ue() + 1, b.ue() + 1
    progressive = bool(b.u(1))
    if not progressive:
        b.u(1)
    b.u(1)
    crop = [b.ue() for _ in range(4)] if b.u(1) else [0] * 4
    across, down = (1, 1) if separate or chroma == 0 else ((2, 2), (2, 1), (1, 1))[chroma - 1] if chroma <= 3 else (1, 1)
    down *= 1 if progressive else 2
    signal = _video_signal(b) if b.u(1) else {}
    return Sps(profile, columns * 16 - across * (crop[0] + crop[1]), rows * 16 * (1 if progressive else 2) - down * (crop[2] + crop[3]), chroma, luma_bits, chroma_bits, progressive, **signal)


def hevc(unit: bytes) -> Sps:
    b = Bits.of_unit(unit, 2)
    b.u(4)
    layers = b.u(3)
    b.u(1)
    b.u(3)
    profile = b.u(5)
    compatible = b.u(32)
    b.u(1)
    interlaced = b.u(1)
    b.u(46)
    b.u(8)
    present = [(b.u(1), b.u(1)) for _ in range(layers)]
    if layers:
        b.u(2 * (8 - layers))
    for p, level in present:
        b.u(88 * p + 8 * level)
    b.ue()
    chroma = b.ue()
    separate = b.u(1) if chroma == 3 else 0
    width, height = b.ue(), b.ue()
    if b.u(1):
        across, down = ((1, 1) if separate else {1: (2, 2), 2: (2, 1)}.get(chroma, (1, 1)))
        left, right, top, bottom = (b.ue() for _ in range(4))
        width, height = width - across * (left + right), height - down * (top + bottom)
    luma_bits, chroma_bits = 8 + b.ue(), 8 + b.ue()
    signal = {}
    try:
        signal = _hevc_signal(b, layers)
    except IngestError:
        signal = {}
    return Sps(profile, width, height, chroma, luma_bits, chroma_bits, not interlaced, **signal, main=profile == 1 or bool(compatible >> 30 & 1))


def _hevc_signal(b: Bits, layers: int) -> dict:
    """Skips what lies between the bit depths and the usability information."""
    order_bits = b.ue() + 4
    for _ in range(layers + 1 if b.u(1) else 1):
        b.ue()
        b.ue()
        b.ue()
    for _ in range(6):
        b.ue()
    if b.u(1) and b.u(1):  # scaling lists
        for size in range(4):
            for _ in range(0, 6, 3 if size == 3 else 1):
                if not b.u(1):
                    b.ue()
                else:
                    if size > 1:
                        b.se()
                    for _ in range(min(64, 1 << (4 + (size << 1)))):
                        b.se()
    b.u(2)
    if b.u(1):
        b.u(8)
        b.ue()
        b.ue()
        b.u(1)
    counts: list[int] = []
    for i in range(min(b.ue(), 64)):
        if i and b.u(1):
            b.u(1)
            b.ue()
            counts.append(sum(1 for _ in range(counts[-1] + 1) if b.u(1) or b.u(1)))
        else:
            a, c = b.ue(), b.ue()
            for _ in range(min(a + c, 64)):
                b.ue()
                b.u(1)
            counts.append(a + c)
    if b.u(1):
        for _ in range(min(b.ue(), 64)):
            b.u(order_bits + 1)
    b.u(2)
    return _video_signal(b) if b.u(1) else {}


def colour(sets: list[Sps], width: int, height: int, box: tuple[int, int, bool] | None, is_hevc: bool) -> tuple[bool, bool]:
    """(BT.709, full range) of a track, or why its pictures are not supported. box: transfer, matrix, full of the container."""
    found = None
    for s in sets:
        if (s.luma_bits, s.chroma_bits, s.chroma, s.progressive) != (8, 8, 1, True) or not s.main:
            raise IngestError("only progressive 8-bit 4:2:0 video" + (" of the Main profile" if is_hevc else "") + " is supported")
        if not (0 < s.width <= MAX_WIDTH and 0 < s.height <= MAX_HEIGHT):
            raise IngestError(f"pictures exceed {MAX_WIDTH}x{MAX_HEIGHT}")
        if (s.width, s.height) != (width, height):
            raise IngestError("parameter set and sample entry disagree about the size")
        # An H.265 set without a description leaves 0, which means the same as 2 there.
        known = lambda v: 2 if is_hevc and v == 0 else v
        matrix, transfer, full = known(s.matrix), known(s.transfer), s.full
        if box is not None:
            if 2 not in (matrix, box[1]) and matrix != box[1]:
                raise IngestError("container and parameter set disagree about the colour matrix")
            transfer, full = box[0], box[2]
            matrix = box[1] if box[1] != 2 else matrix
        if matrix not in (1, 2, 5, 6):
            raise IngestError(f"colour matrix {matrix} is not supported")
        if transfer not in (1, 2, 6, 13, 14, 15):
            raise IngestError(f"transfer function {transfer} is not supported")
        now = (matrix == 1, full)
        if found not in (None, now):
            raise IngestError("colours change between parameter sets")
        found = now
    if found is None:
        raise IngestError("no sequence parameter set")
    return found
