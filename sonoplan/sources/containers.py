"""Audio containers read from their headers: no decoder, and no more of a file than needed.

``read_header`` takes a seekable binary file. Sizes and places come from the formats' public
specifications; values that a header doesn't give are None. What is damaged raises ValueError.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np

FIELDS = ("container", "codec", "sample_rate", "channels", "bit_depth", "bitrate_kbps", "duration_sec")

# kbit/s by index for MPEG-1 layers I, II, III and MPEG-2 layers I, II and III.
_RATES_1 = {1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
_RATES_2 = {1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_MPEG_HZ = (44100, 48000, 32000)
_ADTS_HZ = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
#: Bits per sample of AU encodings.
_AU_BITS = {1: 8, 2: 8, 3: 16, 4: 24, 5: 32, 6: 32, 7: 64, 27: 8}
#: How far behind a tag the first MPEG frame may be, and how much of an Ogg file's end is searched at first.
_SYNC_WITHIN, _TAIL = 64 << 10, 64 << 10


def _take(f: BinaryIO, n: int) -> bytes:
    b = f.read(n)
    if len(b) < n:
        raise ValueError("the file ends within a header")
    return b


def _size(f: BinaryIO) -> int:
    at = f.tell()
    end = f.seek(0, io.SEEK_END)
    f.seek(at)
    return end


def _row(codec: str | None, rate: int | None, channels: int | None, bits: int | None = None, seconds: float | None = None, kbps: float | None = None, n_bytes: int | None = None) -> dict:
    """``n_bytes``: of the audio, for a mean bitrate where the header has none."""
    if kbps is None and n_bytes and seconds:
        kbps = n_bytes * 8 / seconds / 1000
    return {"codec": codec, "sample_rate": rate or None, "channels": channels or None, "bit_depth": bits or None, "bitrate_kbps": kbps, "duration_sec": seconds}


def iff_chunks(f: BinaryIO, little: bool) -> Iterator[tuple[bytes, int, int]]:
    """(id, place, size) of the chunks from here to the end; they start at even places."""
    end = _size(f)
    while f.tell() + 8 <= end:
        name, n = struct.unpack("<4sI" if little else ">4sI", _take(f, 8))
        at = f.tell()
        yield name, at, min(n, end - at)
        f.seek(min(end, at + n + n % 2))


def wave_layout(f: BinaryIO) -> dict:
    """kind (pcm, float or a number), channels, rate, bits, block (bytes of a frame), data (place, size)."""
    f.seek(12)
    out: dict = {}
    for name, at, n in iff_chunks(f, little=True):
        if name == b"fmt ":
            tag, channels, rate, _, block, bits = struct.unpack("<HHIIHH", _take(f, 16))
            if tag == 0xFFFE and n >= 40:  # the real tag begins the sub-format
                f.seek(at + 24)
                tag = struct.unpack("<H", _take(f, 2))[0]
            out |= {"kind": {1: "pcm", 3: "float"}.get(tag, tag), "channels": channels, "rate": rate, "bits": bits, "block": block}
        elif name == b"data":
            out["data"] = (at, n)
        if "kind" in out and "data" in out:
            return out
    raise ValueError("no format or no samples")


def _wave(f: BinaryIO) -> dict:
    w = wave_layout(f)
    seconds = w["data"][1] / (w["rate"] * w["block"]) if w["rate"] and w["block"] else None
    codec = w["kind"] if isinstance(w["kind"], str) else f"wav-{w['kind']:#06x}"
    return _row(codec, w["rate"], w["channels"], w["bits"], seconds, w["rate"] * w["block"] * 8 / 1000)


def _extended(b: bytes) -> float:
    """80-bit floating point number, big-endian."""
    power, digits = struct.unpack(">HQ", b)
    return digits * 2.0 ** ((power & 0x7FFF) - 16383 - 63)


def aiff_layout(f: BinaryIO) -> dict:
    """As wave_layout, with the byte order: frames, order."""
    f.seek(8)
    compressed = _take(f, 4) == b"AIFC"
    out: dict = {}
    for name, at, n in iff_chunks(f, little=False):
        if name == b"COMM":
            channels, frames, bits, rate = struct.unpack(">hIh10s", _take(f, 18))
            kind = _take(f, 4) if compressed and n >= 22 else b"NONE"
            known = {b"NONE": ("pcm", ">"), b"twos": ("pcm", ">"), b"in24": ("pcm", ">"), b"in32": ("pcm", ">"), b"sowt": ("pcm", "<"), b"fl32": ("float", ">"), b"FL32": ("float", ">"), b"fl64": ("float", ">"), b"FL64": ("float", ">")}
            kind, order = known.get(kind, (kind.decode("latin-1").strip(), ">"))
            wide = -(-bits // 8)
            out |= {"kind": kind, "channels": channels, "rate": int(round(_extended(rate))), "bits": bits, "frames": frames, "order": order, "block": channels * wide}
        elif name == b"SSND":
            offset = struct.unpack(">I", _take(f, 8)[:4])[0]
            out["data"] = (at + 8 + offset, max(0, n - 8 - offset))
        if "kind" in out and "data" in out:
            return out
    if "kind" in out and not out["frames"]:
        return out | {"data": (f.tell(), 0)}
    raise ValueError("no format or no samples")


def _aiff(f: BinaryIO) -> dict:
    a = aiff_layout(f)
    return _row(a["kind"], a["rate"], a["channels"], a["bits"], a["frames"] / a["rate"] if a["rate"] else None, a["rate"] * a["block"] * 8 / 1000)


def au_layout(f: BinaryIO) -> dict:
    f.seek(0)
    _, offset, n, encoding, rate, channels = struct.unpack(">4sIIIII", _take(f, 24))
    bits, left = _AU_BITS.get(encoding), max(0, _size(f) - offset)
    kind = {1: "mulaw", 27: "alaw", 6: "float", 7: "float"}.get(encoding, "pcm" if bits else f"au-{encoding}")
    return {"kind": kind, "channels": channels, "rate": rate, "bits": bits, "order": ">", "block": channels * (bits or 0) // 8, "data": (offset, left if n == 0xFFFFFFFF else min(n, left))}


def _au(f: BinaryIO) -> dict:
    a = au_layout(f)
    per_second = a["rate"] * a["block"]
    return _row(a["kind"], a["rate"], a["channels"], a["bits"], a["data"][1] / per_second if per_second else None, per_second * 8 / 1000 or None)


def _stream_info(b: bytes, n_bytes: int) -> dict:
    """FLAC: 20 bits of rate, 3 of channels less one, 5 of bits less one, 36 of samples, from byte 10 on."""
    x = int.from_bytes(b[10:18], "big")
    rate, samples = x >> 44, x & ((1 << 36) - 1)
    seconds = samples / rate if rate and samples else None
    return _row("flac", rate, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, seconds, n_bytes=n_bytes)


def _flac(f: BinaryIO) -> dict:
    f.seek(f.tell() + 4)
    while True:
        head = _take(f, 4)
        n = int.from_bytes(head[1:], "big")
        if head[0] & 127 == 0:
            return _stream_info(_take(f, 34), _size(f))
        if head[0] & 128:
            raise ValueError("no stream information")
        f.seek(n, io.SEEK_CUR)


def _ogg(f: BinaryIO) -> dict:
    """Vorbis, Opus, FLAC or Speex in Ogg: what the first page says, and the last page's granule."""
    start = f.tell()
    page = _take(f, 27)
    serial, count = page[14:18], page[26]
    packet = _take(f, sum(_take(f, count)))
    size = _size(f)
    skip, clock = 0, None
    if packet[:7] == b"\x01vorbis":
        channels, clock, _, nominal = struct.unpack("<BIii", packet[11:24])
        out = _row("vorbis", clock, channels, kbps=nominal / 1000 if nominal > 0 else None)
    elif packet[:8] == b"OpusHead":
        channels, skip, _ = struct.unpack("<BHI", packet[9:16])
        clock, out = 48000, _row("opus", 48000, channels)  # decoded at this rate whatever the source's
    elif packet[:5] == b"\x7fFLAC":
        out = _stream_info(packet[17:51], size)
        clock = out["sample_rate"]
    elif packet[:8] == b"Speex   ":
        clock, _, _, channels, kbps = struct.unpack("<IIIIi", packet[36:56])
        out = _row("speex", clock, channels, kbps=kbps / 1000 if kbps > 0 else None)
    else:
        raise ValueError("no known codec in the first page")
    tail = _TAIL
    while out["duration_sec"] is None and clock:
        f.seek(max(start, size - tail))
        end = f.read(tail)
        at = end.rfind(b"OggS")
        while at >= 0:
            granule = struct.unpack("<q", end[at + 6 : at + 14])[0] if at + 18 <= len(end) and end[at + 14 : at + 18] == serial else -1
            if granule >= 0:  # -1: no packet ends on that page
                out["duration_sec"] = max(0, granule - skip) / clock
                break
            at = end.rfind(b"OggS", 0, at)
        if tail >= size:
            break
        tail *= 4
    if out["bitrate_kbps"] is None and out["duration_sec"]:
        out["bitrate_kbps"] = size * 8 / out["duration_sec"] / 1000
    return out


def skip_id3(f: BinaryIO) -> int:
    """The place behind the ID3v2 tags at the start (sizes have seven bits a byte)."""
    at = 0
    while True:
        f.seek(at)
        head = f.read(10)
        if len(head) < 10 or head[:3] != b"ID3":
            f.seek(at)
            return at
        at += 10 + (head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]) + (10 if head[5] & 16 else 0)


def mpeg_frame(head: bytes) -> dict | None:
    """Of a frame header of four bytes: version (1, 2, 2.5), layer, kbps, rate, channels, samples, size."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = (2.5, None, 2, 1)[head[1] >> 3 & 3], 4 - (head[1] >> 1 & 3)
    kbps, hz = head[2] >> 4, head[2] >> 2 & 3
    if version is None or layer == 4 or kbps in (0, 15) or hz == 3:
        return None
    kbps = (_RATES_1[layer] if version == 1 else _RATES_2[min(layer, 2)])[kbps]
    rate = int(_MPEG_HZ[hz] / {1: 1, 2: 2, 2.5: 4}[version])
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    slot = 4 if layer == 1 else 1
    size = (samples // 8 // slot * kbps * 1000 // rate + (head[2] >> 1 & 1)) * slot
    return {"version": version, "layer": layer, "kbps": kbps, "rate": rate, "channels": 1 if head[3] >> 6 == 3 else 2, "samples": samples, "size": size}


def _mpeg(f: BinaryIO) -> dict:
    """The first frame that another of its kind follows; the number of frames where a Xing, Info or
    VBRI header has it, else by the constant rate."""
    start, size = f.tell(), _size(f)
    near = f.read(_SYNC_WITHIN)
    for at in range(max(0, len(near) - 3)):
        frame = mpeg_frame(near[at : at + 4]) if near[at] == 0xFF else None
        if frame is None:
            continue
        f.seek(start + at + frame["size"])
        after = f.read(4)
        follows = mpeg_frame(after)
        if follows and (follows["rate"], follows["layer"], follows["version"]) == (frame["rate"], frame["layer"], frame["version"]) or not after or after[:3] == b"TAG":
            break
    else:
        raise ValueError("no frame found")
    f.seek(start + at)
    head = f.read(frame["size"])
    audio = size - start - at
    if size >= 128:
        f.seek(size - 128)
        audio -= 128 * (f.read(3) == b"TAG")
    side = 4 + ((17 if frame["channels"] == 1 else 32) if frame["version"] == 1 else 9 if frame["channels"] == 1 else 17)
    frames = n_bytes = None
    if head[side : side + 4] in (b"Xing", b"Info") and len(head) >= side + 16:
        flags, *numbers = struct.unpack(">III", head[side + 4 : side + 16])
        frames = numbers[0] if flags & 1 else None
        n_bytes = numbers[flags & 1] if flags & 2 else None
    elif head[36:40] == b"VBRI" and len(head) >= 54:
        n_bytes, frames = struct.unpack(">II", head[46:54])
    codec = f"mp{frame['layer']}"
    if frames:
        return _row(codec, frame["rate"], frame["channels"], None, frames * frame["samples"] / frame["rate"], n_bytes=n_bytes or audio)
    return _row(codec, frame["rate"], frame["channels"], None, audio * 8 / (frame["kbps"] * 1000), frame["kbps"])


def _adts(f: BinaryIO) -> dict:
    """AAC without a container has no length: its frames are counted, header by header."""
    start, data, at, frames, first = f.tell(), f.read(), 0, 0, None
    while at + 7 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xF6 == 0xF0:
        n = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if n < 7:
            break
        first = first or data[at : at + 7]
        frames += 1 + (data[at + 6] & 3)
        at += n
    if first is None or (hz := first[2] >> 2 & 15) >= len(_ADTS_HZ):
        raise ValueError("no frame found")
    seconds = frames * 1024 / _ADTS_HZ[hz]
    return _row("aac", _ADTS_HZ[hz], (first[2] & 1) << 2 | first[3] >> 6, None, seconds, n_bytes=at or start)


def _atoms(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, place, end) of the contents of the atoms between two places."""
    while at + 8 <= end:
        f.seek(at)
        n, kind = struct.unpack(">I4s", _take(f, 8))
        begin = at + 8
        if n == 1:
            n, begin = struct.unpack(">Q", _take(f, 8))[0], at + 16
        n = n or end - at
        if n < begin - at:
            raise ValueError("an atom of no size")
        yield kind, begin, min(end, at + n)
        at += n


def _mp4(f: BinaryIO) -> dict:
    """The first sound track: its clock and length, its sample description."""
    size, media = _size(f), 0
    tracks: list[dict] = []

    def walk(at: int, end: int) -> None:
        nonlocal media
        for kind, begin, stop in _atoms(f, at, end):
            if kind == b"trak":
                tracks.append({})
            if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                walk(begin, stop)
            elif kind == b"mdat":
                media += stop - begin
            elif kind == b"mdhd" and tracks:
                f.seek(begin)
                wide = _take(f, 4)[0] == 1
                f.seek(16 if wide else 8, io.SEEK_CUR)
                tracks[-1]["clock"], tracks[-1]["length"] = struct.unpack(">IQ" if wide else ">II", _take(f, 12 if wide else 8))
            elif kind == b"hdlr" and tracks:
                f.seek(begin + 8)
                tracks[-1]["sound"] = _take(f, 4) == b"soun"
            elif kind == b"stsd" and tracks and stop - begin >= 44:
                f.seek(begin + 12)
                codec = _take(f, 4)
                f.seek(16, io.SEEK_CUR)
                channels, bits, _, _, rate = struct.unpack(">HHHHI", _take(f, 12))
                tracks[-1] |= {"codec": codec.decode("latin-1").strip(), "channels": channels, "bits": bits, "rate": rate >> 16}

    walk(0, size)
    t = next((t for t in tracks if t.get("sound")), None)
    if t is None:
        raise ValueError("no sound track")
    codec = {"mp4a": "aac"}.get(t.get("codec"), t.get("codec"))
    seconds = t["length"] / t["clock"] if t.get("clock") else None
    return _row(codec, t.get("rate") or t.get("clock"), t.get("channels"), t.get("bits") if codec != "aac" else None, seconds, n_bytes=media)


def _ape(f: BinaryIO) -> dict:
    """Monkey's Audio from 3.98 on: a descriptor names the size of itself, the header follows it."""
    start = f.tell()
    version, own = struct.unpack("<4xHxxI", _take(f, 12))
    if version < 3980:
        raise ValueError(f"version {version / 1000:g} has another header")
    f.seek(start + own)
    _, _, block, last, frames, bits, channels, rate = struct.unpack("<HHIIIHHI", _take(f, 24))
    seconds = ((frames - 1) * block + last) / rate if frames and rate else None
    return _row("ape", rate, channels, bits, seconds, n_bytes=_size(f))


def read_header(f: BinaryIO) -> dict | None:
    """container, codec, sample_rate, channels, bit_depth, bitrate_kbps, duration_sec; None for a file of
    another kind."""
    f.seek(0)
    head = f.read(12)
    named: str | None = None
    parse: Callable[[BinaryIO], dict] | None = None
    if head[:4] in (b"RIFF", b"RF64") and head[8:] == b"WAVE":
        named, parse = "wav", _wave
    elif head[:4] == b"FORM" and head[8:] in (b"AIFF", b"AIFC"):
        named, parse = "aiff", _aiff
    elif head[:4] == b".snd":
        named, parse = "au", _au
    elif head[4:8] == b"ftyp":
        named, parse = "mp4", _mp4
    else:
        at = skip_id3(f)
        head = f.read(4)
        f.seek(at)
        if head == b"fLaC":
            named, parse = "flac", _flac
        elif head == b"OggS":
            named, parse = "ogg", _ogg
        elif head == b"MAC ":
            named, parse = "ape", _ape
        elif head[:1] == b"\xff" and head[1:2] and head[1] & 0xF6 == 0xF0:
            named, parse = "aac", _adts
        elif at or head[:1] == b"\xff" and head[1:2] and head[1] & 0xE0 == 0xE0:
            named, parse = "mp3", _mpeg
    if parse is None:
        return None
    try:
        return {"container": named, **parse(f)}
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError(f"damaged {named} header: {e}") from e


def samples(raw: bytes) -> tuple[np.ndarray, int] | None:
    """(float32 samples as (n, channels), rate) of uncompressed WAV, AIFF or AU; None for other files."""
    f = io.BytesIO(raw)
    if raw[:4] in (b"RIFF", b"RF64") and raw[8:12] == b"WAVE":
        a = wave_layout(f) | {"order": "<"}
        unsigned = a["bits"] <= 8
    elif raw[:4] == b"FORM" and raw[8:12] in (b"AIFF", b"AIFC"):
        a, unsigned = aiff_layout(f), False
    elif raw[:4] == b".snd":
        a, unsigned = au_layout(f), False
    else:
        return None
    at, n = a["data"]
    wide, channels = -(-(a["bits"] or 0) // 8), a["channels"]
    if a["kind"] not in ("pcm", "float") or not channels or wide not in ((1, 2, 3, 4) if a["kind"] == "pcm" else (4, 8)):
        raise ValueError(f"{a['kind']} of {a['bits']} bits can't be decoded")
    n = min(n, len(raw) - at) // (wide * channels) * wide * channels
    body = np.frombuffer(raw, np.uint8, n, at)
    if a["kind"] == "float":
        x = body.view(f"{a['order']}f{wide}").astype(np.float64)
    elif wide == 1:
        x = (body.astype(np.float64) - 128) / 128 if unsigned else body.view(np.int8) / 128
    elif wide == 3:  # three bytes become the upper ones of four
        full = np.zeros((n // 3, 4), np.uint8)
        full[:, 1:] = body.reshape(-1, 3) if a["order"] == "<" else body.reshape(-1, 3)[:, ::-1]
        x = full.view("<i4").ravel() / 2147483648
    else:
        x = body.view(f"{a['order']}i{wide}") / float(1 << (8 * wide - 1))
    return np.asarray(x, np.float32).reshape(-1, channels), a["rate"]
