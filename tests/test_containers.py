"""Headers and samples of files that are put together here, byte by byte after the formats' specifications."""

from __future__ import annotations

import io
import struct

import numpy as np
import pytest

from sonoplan.sources import audio, containers

RATE = 8000


def tone(n=4000, channels=2):
    t = np.arange(n) / RATE
    return np.stack([np.sin(2 * np.pi * 440 * (k + 1) * t) * 0.5 for k in range(channels)], 1)


def packed(x, width, order, unsigned=False):
    if width == 1:
        return (np.round(x * 127) + 128).astype(np.uint8).tobytes() if unsigned else np.round(x * 127).astype(np.int8).tobytes()
    if width == 3:
        b = np.round(x * 8388607).astype("<i4").view(np.uint8).reshape(*x.shape, 4)[..., :3]
        return (b if order == "<" else b[..., ::-1]).tobytes()
    return np.round(x * ((1 << 8 * width - 1) - 1)).astype(f"{order}i{width}").tobytes()


def chunk(name, body, order=">"):
    return name + struct.pack(order + "I", len(body)) + body + b"\0" * (len(body) % 2)


def extended(rate):
    power = rate.bit_length() - 1
    return struct.pack(">HQ", 16383 + power, rate << (63 - power))


def wav(x, width, floating=False, extensible=False):
    data = x.astype(f"<f{width}").tobytes() if floating else packed(x, width, "<", True)
    tag, channels = 3 if floating else 1, x.shape[1]
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, RATE, RATE * width * channels, width * channels, 8 * width)
    if extensible:
        head += struct.pack("<HHIH14s", 22, 8 * width, 3, tag, b"\0\0\0\0\x10\0\x80\0\0\xaa\0\x38\x9b\x71")
    body = b"WAVE" + chunk(b"LIST", b"odd", "<") + chunk(b"fmt ", head, "<") + chunk(b"data", data, "<")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def aiff(x, width, kind=None):
    order = "<" if kind == b"sowt" else ">"
    data = x.astype(f">f{width}").tobytes() if kind in (b"fl32", b"fl64") else packed(x, width, order)
    common = struct.pack(">hIh", x.shape[1], len(x), 8 * width) + extended(RATE) + ((kind + b"\0\0") if kind else b"")
    body = (b"AIFC" if kind else b"AIFF") + chunk(b"COMM", common) + chunk(b"NAME", b"abc") + chunk(b"SSND", struct.pack(">II", 0, 0) + data)
    return b"FORM" + struct.pack(">I", len(body)) + body


def au(x, width, encoding, floating=False, known=True):
    data = x.astype(f">f{width}").tobytes() if floating else packed(x, width, ">")
    return struct.pack(">4sIIIII", b".snd", 28, len(data) if known else 0xFFFFFFFF, encoding, RATE, x.shape[1]) + b"note" + data


def page(serial, granule, packet):
    lacing = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
    return b"OggS" + struct.pack("<BBqIIIB", 0, 2, granule, serial, 0, 0, len(lacing)) + lacing + packet


def stream_info(rate, channels, bits, samples):
    return struct.pack(">HH", 4096, 4096) + bytes(6) + (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | samples).to_bytes(8, "big") + bytes(16)


def mpeg(frames, kbps_index=9, xing=None, vbri=None):
    """MPEG-1 layer III at 44.1 kHz, stereo."""
    head = bytes([0xFF, 0xFB, kbps_index << 4, 0x00])
    size = containers.mpeg_frame(head)["size"]
    body = [head + bytes(size - 4) for _ in range(frames)]
    if xing is not None:
        body.insert(0, (head + bytes(32) + b"Xing" + struct.pack(">III", 3, xing, 12345)).ljust(size, b"\0"))
    if vbri is not None:
        body.insert(0, (head + bytes(32) + b"VBRI" + struct.pack(">HHHII", 1, 0, 0, 54321, vbri)).ljust(size, b"\0"))
    return b"".join(body)


def id3(n):
    return b"ID3\x04\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + bytes(n)


def atom(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def mp4(codec, bits=16, wide=False, first=True, media=5000):
    clock = struct.pack(">B3xQQIQ", 1, 0, 0, 44100, 44100 * 5) if wide else struct.pack(">B3xIIII", 0, 0, 0, 44100, 44100 * 5)
    entry = struct.pack(">I4s6xH8xHHHHI", 36, codec, 1, 2, bits, 0, 0, 44100 << 16)
    sound = atom(b"trak", atom(b"mdia", atom(b"mdhd", clock) + atom(b"hdlr", bytes(8) + b"soun" + bytes(12)) + atom(b"minf", atom(b"stbl", atom(b"stsd", struct.pack(">II", 0, 1) + entry)))))
    video = atom(b"trak", atom(b"mdia", atom(b"mdhd", struct.pack(">B3xIIII", 0, 0, 0, 1000, 99000)) + atom(b"hdlr", bytes(8) + b"vide" + bytes(12))))
    moov, data = atom(b"moov", atom(b"mvhd", bytes(100)) + video + sound), atom(b"mdat", bytes(media))
    if wide:
        data = struct.pack(">I4sQ", 1, b"mdat", media + 16) + bytes(media)
    return atom(b"ftyp", b"M4A \0\0\0\0") + (moov + data if first else data + moov)


def adts(frames):
    n = 200
    head = bytes([0xFF, 0xF1, 1 << 6 | 4 << 2 | 0, 2 << 6 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 31, 0xFC])
    return (head + bytes(n - 7)) * frames


def read(raw):
    return containers.read_header(io.BytesIO(raw))


def row(container, codec, rate, channels, bits, seconds):
    return {"container": container, "codec": codec, "sample_rate": rate, "channels": channels, "bit_depth": bits, "duration_sec": pytest.approx(seconds)}


X = tone()
HEADERS = {
    "wav": (wav(X, 2), row("wav", "pcm", 8000, 2, 16, 0.5), 256.0),
    "wav24": (wav(X, 3, extensible=True), row("wav", "pcm", 8000, 2, 24, 0.5), 384.0),
    "wav float": (wav(X, 4, True), row("wav", "float", 8000, 2, 32, 0.5), 512.0),
    "aiff": (aiff(X, 2), row("aiff", "pcm", 8000, 2, 16, 0.5), 256.0),
    "aifc": (aiff(X, 2, b"sowt"), row("aiff", "pcm", 8000, 2, 16, 0.5), 256.0),
    "au": (au(X, 3, 4), row("au", "pcm", 8000, 2, 24, 0.5), 384.0),
    "au open": (au(X, 2, 3, known=False), row("au", "pcm", 8000, 2, 16, 0.5), 256.0),
    "flac": (b"fLaC" + b"\x04\0\0\x03abc" + b"\x80\0\0\x22" + stream_info(96000, 6, 24, 480_000) + bytes(949), row("flac", "flac", 96000, 6, 24, 5.0), "mean"),
    "flac behind a tag": (id3(300) + b"fLaC\x80\0\0\x22" + stream_info(44100, 1, 16, 0), row("flac", "flac", 44100, 1, 16, None) | {"duration_sec": None}, None),
    "vorbis": (page(7, 0, b"\x01vorbis" + struct.pack("<IBIiii", 0, 2, 44100, 0, 128000, 0) + b"\xb8\x01") + page(7, 44100, bytes(300)) + page(7, 88200, bytes(10)) + page(8, 10**9, b"x") + page(7, -1, b"y"), row("ogg", "vorbis", 44100, 2, None, 2.0), 128.0),
    "opus": (page(1, 0, b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 44100, 0, 0)) + page(1, 48000 * 3 + 312, bytes(60_000)), row("ogg", "opus", 48000, 1, None, 3.0), "mean"),
    "flac in ogg": (page(3, 0, b"\x7fFLAC\x01\0\0\x01fLaC\0\0\0\x22" + stream_info(48000, 2, 16, 96000)), row("ogg", "flac", 48000, 2, 16, 2.0), "mean"),
    "mp3": (id3(1000) + mpeg(100) + b"TAG" + bytes(125), row("mp3", "mp3", 44100, 2, None, 100 * 417 * 8 / 128_000), 128.0),
    "mp3 with frames": (mpeg(20, xing=383), row("mp3", "mp3", 44100, 2, None, 383 * 1152 / 44100), 12345 * 8 / (383 * 1152 / 44100) / 1000),
    "mp3 with bytes": (b"\xff\xfb\x90\0 broken " + mpeg(20, vbri=766), row("mp3", "mp3", 44100, 2, None, 766 * 1152 / 44100), 54321 * 8 / (766 * 1152 / 44100) / 1000),
    "m4a": (mp4(b"mp4a"), row("mp4", "aac", 44100, 2, None, 5.0), 8.0),
    "m4a, long, last": (mp4(b"alac", 24, wide=True, first=False), row("mp4", "alac", 44100, 2, 24, 5.0), 8.0),
    "aac": (adts(431), row("aac", "aac", 44100, 2, None, 431 * 1024 / 44100), 200 * 8 / (1024 / 44100) / 1000),
    "ape": (b"MAC " + struct.pack("<HHI", 3990, 0, 52) + bytes(40) + struct.pack("<HHIIIHHI", 2000, 0, 73728, 1000, 11, 16, 2, 44100), row("ape", "ape", 44100, 2, 16, (10 * 73728 + 1000) / 44100), "mean"),
}


@pytest.mark.parametrize("name", HEADERS)
def test_headers(name):
    raw, want, kbps = HEADERS[name]
    got = read(raw)
    if kbps == "mean":
        kbps = len(raw) * 8 / got["duration_sec"] / 1000
    assert got == want | {"bitrate_kbps": kbps if kbps is None else pytest.approx(kbps)}
    assert set(got) == set(containers.FIELDS)


@pytest.mark.parametrize("name", HEADERS)
def test_damaged_files_raise_or_say_less(name):
    """No end of a file, and no flipped byte near its start, does more than raise ValueError."""
    raw = HEADERS[name][0]
    rng = np.random.default_rng(len(raw))
    cuts = [raw[:n] for n in {*range(0, min(len(raw), 130), 3), len(raw) // 2}]
    flips = []
    for _ in range(200):
        b = bytearray(raw[:6000])
        for at in rng.integers(0, min(len(b), 400), 3):
            b[at] = rng.integers(0, 256)
        flips.append(bytes(b))
    for b in cuts + flips:
        try:
            read(b)
        except ValueError:
            pass
        assert set(audio.probe(b, "x.abc")) == set(containers.FIELDS)


def test_other_files_are_none():
    for raw in (b"", b"x", b"RIFF", b"RIFF\0\0\0\0AVI ", b"plain text " * 9, b"\xff"):
        assert read(raw) is None
        assert containers.samples(raw) is None
        assert audio.probe(raw, "a.FLAC")["container"] == "flac"


SAMPLES = {
    "wav8": (wav(X, 1), 0.01), "wav16": (wav(X, 2), 1e-4), "wav24": (wav(X, 3, extensible=True), 1e-6), "wav32": (wav(X, 4), 1e-6), "wav float": (wav(X, 4, True), 1e-6), "wav double": (wav(X, 8, True), 1e-6),
    "aiff8": (aiff(X, 1), 0.01), "aiff16": (aiff(X, 2), 1e-4), "aiff24": (aiff(X, 3), 1e-6), "aiff32": (aiff(X, 4), 1e-6), "aifc little": (aiff(X, 2, b"sowt"), 1e-4), "aifc float": (aiff(X, 4, b"fl32"), 1e-6),
    "au8": (au(X, 1, 2), 0.01), "au16": (au(X, 2, 3), 1e-4), "au24": (au(X, 3, 4, known=False), 1e-6), "au float": (au(X, 4, 6, True), 1e-6), "au double": (au(X, 8, 7, True), 1e-6),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_samples(name):
    raw, off = SAMPLES[name]
    both, rate = audio.decode(raw, name, mono=False)
    assert rate == RATE and both.shape == X.shape and both.dtype == np.float32 and np.abs(both - X).max() < off
    one, _ = audio.decode(raw, name)
    assert one.shape == (len(X),) and np.abs(one - X.mean(1)).max() < off
    half, rate = audio.decode(raw, name, RATE // 2, mono=False)
    assert rate == RATE // 2 and half.shape == (len(X) // 2, 2)


def test_what_cant_be_decoded_says_so(monkeypatch):
    monkeypatch.setattr(audio.shutil, "which", lambda _: None)
    with pytest.raises(ValueError, match="ulaw"):
        audio.decode(au(X, 1, 1), "a.au")
    with pytest.raises(RuntimeError, match="no decoder"):
        audio.decode(HEADERS["flac"][0], "a.flac")
    assert len(audio.decode(wav(X[:0], 2), "empty.wav")[0]) == 0
