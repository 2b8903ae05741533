"""Length-prefixed video units: splitting, classifying, and rewriting to start codes."""

from __future__ import annotations

from collections.abc import Iterator

START_CODE = b"\0\0\0\1"


def units(data: bytes, prefix: int) -> Iterator[bytes | None]:
    """The units of an access unit; None once if it is malformed from there on."""
    at = 0
    while at < len(data):
        if not 1 <= prefix <= 4 or len(data) - at < prefix:
            yield None
            return
        n = int.from_bytes(data[at : at + prefix], "big")
        at += prefix
        if n == 0 or n > len(data) - at:
            yield None
            return
        yield data[at : at + n]
        at += n


# --- H.264 ------------------------------------------------------------------------------------------------------------


def avc_disposable(data: bytes, prefix: int) -> bool:
    """Slices that nothing refers to, and at most SEI, delimiters and filler beside."""
    slices = 0
    for u in units(data, prefix):
        if u is None or u[0] & 0x80:
            return False
        kind, reference = u[0] & 31, u[0] >> 5 & 3
        if kind == 1 and not reference:
            slices += 1
        elif kind not in (6, 9, 12):
            return False
    return slices > 0


def avc_idr(data: bytes, prefix: int) -> bool:
    """Only instantaneous refresh slices among the slices."""
    found = False
    for u in units(data, prefix):
        if u is None or u[0] & 0x80 or not u[0] & 31:
            return False
        kind = u[0] & 31
        if kind == 5:
            found = True
        elif kind in (1, 2, 3, 4, 19, 20, 21):
            return False
    return found


def avc_annex_b(data: bytes, prefix: int) -> bytes:
    out = []
    for u in units(data, prefix):
        if u is None or u[0] & 0x80 or not u[0] & 31:
            raise ValueError("malformed access unit")
        out.append(START_CODE + u)
    if not out:
        raise ValueError("empty access unit")
    return b"".join(out)


# --- H.265 ------------------------------------------------------------------------------------------------------------


def hevc_header(u: bytes) -> tuple[int, int, int] | None:
    """Type, layer and temporal id; None if malformed."""
    if len(u) < 2 or u[0] & 0x80 or not u[1] & 7:
        return None
    return u[0] >> 1 & 63, (u[0] & 1) << 5 | u[1] >> 3, (u[1] & 7) - 1


def hevc_headers(data: bytes, prefix: int) -> list[tuple[int, int, int]]:
    """The headers up to the first malformed unit."""
    out = []
    for u in units(data, prefix):
        h = hevc_header(u) if u is not None else None
        if h is None:
            break
        out.append(h)
    return out


def hevc_disposable(data: bytes, prefix: int, max_temporal_id: int) -> bool:
    """All slices non-reference at the highest temporal layer, beside SEI, delimiters and filler only."""
    slices = 0
    for u in units(data, prefix):
        h = hevc_header(u) if u is not None else None
        if h is None or h[1]:
            return False
        if h[0] < 32:
            if h[0] > 14 or h[0] % 2 or h[2] != max_temporal_id:
                return False
            slices += 1
        elif h[0] not in (35, 38, 39, 40):
            return False
    return slices > 0


def hevc_classify(data: bytes, prefix: int) -> tuple[bool, bool]:
    """(all slices random access, all slices leading and not decodable)."""
    headers = hevc_headers(data, prefix)
    if any(h[1] for h in headers):
        return False, False
    kinds = [h[0] for h in headers if h[0] < 32]
    return bool(kinds) and all(16 <= k <= 23 for k in kinds), bool(kinds) and all(k in (8, 9) for k in kinds)


def hevc_annex_b(data: bytes, prefix: int) -> bytes:
    out = []
    for u in units(data, prefix):
        h = hevc_header(u) if u is not None else None
        if h is None or h[1]:
            raise ValueError("malformed access unit")
        out.append(START_CODE + u)
    if not out:
        raise ValueError("empty access unit")
    return b"".join(out)


# --- configuration records --------------------------------------------------------------------------------------------


def avc_record(data: bytes) -> tuple[int, list[bytes], list[bytes]]:
    """Prefix length, sequence sets and picture sets of an avcC record."""
    if len(data) < 7 or data[0] != 1:
        raise ValueError("avcC")
    at, sets = 6, ([], [])
    for k, count in enumerate((data[5] & 31, None)):
        if count is None:
            count, at = data[at], at + 1
        for _ in range(count):
            n = int.from_bytes(data[at : at + 2], "big")
            unit = data[at + 2 : at + 2 + n]
            if n == 0 or len(unit) < n:
                raise ValueError("avcC")
            sets[k].append(unit)
            at += 2 + n
    return (data[4] & 3) + 1, *sets


def hevc_record(data: bytes) -> tuple[int, bytes]:
    """Prefix length and parameter sets with start codes of an hvcC record."""
    if len(data) < 23 or data[0] != 1:
        raise ValueError("hvcC")
    prefix = (data[21] & 3) + 1
    if prefix == 3:
        raise ValueError("hvcC prefix")
    at, out = 23, []
    for _ in range(data[22]):
        if at + 3 > len(data):
            raise ValueError("hvcC")
        count = int.from_bytes(data[at + 1 : at + 3], "big")
        at += 3
        for _ in range(count):
            n = int.from_bytes(data[at : at + 2], "big")
            unit = data[at + 2 : at + 2 + n]
            if n == 0 or len(unit) < n:
                raise ValueError("hvcC")
            out.append(START_CODE + unit)
            at += 2 + n
    if not out:
        raise ValueError("hvcC without parameter sets")
    return prefix, b"".join(out)


def colour_name(bt709: bool, full: bool) -> str:
    return ("BT.709" if bt709 else "BT.601") + (" full" if full else " limited")
