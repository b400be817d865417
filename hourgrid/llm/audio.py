"""Telephony audio columns: mu-law, A-law, IMA ADPCM and PCM in WAV containers."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import byte_slices

#: WAV format tags.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
#: Codecs that texts can be stored in.
CODECS = {"mu_law": MU_LAW, "a_law": A_LAW, "ima_adpcm": IMA_ADPCM}

#: Fixed values of the IMA ADPCM format: step sizes, and index changes by code.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
     1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
     7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mu_law_table() -> np.ndarray:
    """The 256 linear values of mu-law codes (G.711): sign, 3 bits exponent, 4 bits mantissa, inverted."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132) << (code >> 4 & 7)
    return np.where(code & 128, 132 - size, size - 132).astype(np.int16)


def a_law_table() -> np.ndarray:
    """The 256 linear values of A-law codes (G.711): even bits inverted, linear in the lowest segment."""
    code = np.arange(256) ^ 0x55
    low, seg = (code & 15) << 4, code >> 4 & 7
    size = np.where(seg == 0, low + 8, (low + 264) << np.maximum(seg - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


_TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """By step index x 16 + code: the change of the value, and the next index."""
    step, code = STEPS[:, None], np.arange(16)
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).ravel().astype(np.int32), after.ravel().astype(np.int32)


_MOVE, _NEXT = _moves()


def decode_ima(streams: list[bytes], block_size: int, channels: int = 1) -> list[np.ndarray]:
    """Samples of IMA ADPCM streams of one block size, channels averaged. All blocks of all
    streams advance together, a code at a time; a last block that is cut short gives the
    samples that its bytes hold."""
    head = 4 * channels
    if channels < 1 or block_size < head:
        raise ValueError(f"ADPCM blocks of {block_size} bytes with {channels} channels")
    counts = [-(-len(x) // block_size) for x in streams]
    table, at = np.zeros((sum(counts), block_size), np.uint8), 0
    for x, n in zip(streams, counts, strict=True):
        table.ravel()[at : at + len(x)] = np.frombuffer(x, np.uint8)
        at += n * block_size
    heads = table[:, :head].reshape(-1, 4)
    value = np.ascontiguousarray(heads[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(heads[:, 2], len(STEPS) - 1).astype(np.int32)
    body = table[:, head:]
    if channels > 1:  # four bytes of each channel in turn
        whole = body.shape[1] // head
        body = np.ascontiguousarray(body[:, : whole * head].reshape(-1, whole, channels, 4).swapaxes(1, 2)).reshape(len(heads), whole * 4)
    codes = np.empty((2 * body.shape[1], len(heads)), np.uint8)
    codes[::2], codes[1::2] = body.T & 15, body.T >> 4
    out = np.empty((len(codes) + 1, len(heads)), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        at_move = index * 16 + code
        value = np.clip(value + _MOVE[at_move], -32768, 32767)
        index = _NEXT[at_move]
        out[k + 1] = value
    samples = out.T.reshape(len(table), channels, len(out))
    samples = np.ascontiguousarray(samples[:, 0]) if channels == 1 else samples.mean(axis=1).astype(np.int16)
    made, row = [], 0
    for x, n in zip(streams, counts, strict=True):
        held = len(x) - (n - 1) * block_size - head if n else -1
        tail = 0 if held < 0 else held * 2 + 1 if channels == 1 else held // head * 8 + 1
        made.append(samples[row : row + n].ravel()[: max(n - 1, 0) * len(out) + tail])
        row += n
    return made


def wav_bytes(payload: bytes, tag: int, rate: int, bits: int = 8, block: int = 1) -> bytes:
    """A mono WAV file that holds ``payload`` as it is."""
    each = 2 * (block - 4) + 1 if tag == IMA_ADPCM else 1
    extra = struct.pack("<HH", 2, each) if tag == IMA_ADPCM else struct.pack("<H", 0)
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16 + len(extra), tag, 1, rate, rate * block // each, block, bits) + extra
    fact = struct.pack("<4sII", b"fact", 4, len(payload) // block * each)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(fact) + len(data), b"WAVE") + head + fact + data


def wav_chunks(media: bytes) -> tuple[int, int, int, int, int, bytes]:
    """(tag, channels, rate, block size, bits, data) of a WAV file; ValueError if it is none."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV header")
    at, fmt, data = 12, None, None
    while at + 8 <= len(media) and data is None:
        name, n = struct.unpack_from("<4sI", media, at)
        body = media[at + 8 : at + 8 + n]
        if name == b"fmt " and len(body) >= 16:
            fmt = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            data = body
        at += 8 + n + (n & 1)
    if fmt is None or data is None:
        raise ValueError("no fmt or data chunk")
    tag, channels, rate, _, block, bits = fmt
    return tag, channels, rate, block, bits, data


def decode_wavs(files: list[tuple[int, int, int, int, int, bytes]]) -> list[np.ndarray | ValueError]:
    """Mono int16 samples of each file, given as :func:`wav_chunks` returns it, or what is
    wrong with it. Channels are averaged; ADPCM files of one form are decoded together."""
    made: list[np.ndarray | ValueError] = []
    adpcm: dict[tuple[int, int], list[int]] = {}
    for i, (tag, channels, _, block, bits, data) in enumerate(files):
        if tag == IMA_ADPCM and channels > 0 and block >= 4 * channels:
            adpcm.setdefault((block, channels), []).append(i)
            made.append(np.empty(0, np.int16))
            continue
        if tag in _TABLES and channels > 0:
            pcm = _TABLES[tag][np.frombuffer(data, np.uint8)]
        elif tag == PCM and bits == 8 and channels > 0:
            pcm = (np.frombuffer(data, np.uint8).astype(np.int16) - 128) * 256
        elif tag == PCM and bits == 16 and channels > 0:
            pcm = np.frombuffer(data[: len(data) & ~1], "<i2")
        else:
            made.append(ValueError(f"format {tag} with {channels} channels of {bits} bits in blocks of {block}"))
            continue
        made.append(pcm if channels == 1 else pcm[: len(pcm) // channels * channels].reshape(-1, channels).mean(axis=1).astype(np.int16))
    for (block, channels), own in adpcm.items():
        for i, pcm in zip(own, decode_ima([files[i][-1] for i in own], block, channels), strict=True):
            made[i] = pcm
    return made


def resample(pcm: np.ndarray, old: int, new: int, lobes: int = 8) -> np.ndarray:
    """``pcm`` at another rate, through a windowed sinc low-pass applied phase by phase."""
    if old == new or not len(pcm):
        return pcm.astype(np.int16)
    up, down = new // (g := gcd(old, new)), old // g
    half = lobes * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.hanning(2 * half + 3)[1:-1]
    taps *= up / taps.sum()
    n = -(-len(pcm) * up // down)
    at = np.arange(n) * down
    out = np.empty(n)
    padded = np.concatenate([np.zeros(half // up + 1), pcm, np.zeros(half // up + 2)])
    for phase in range(up):  # outputs of one phase share their taps
        own = np.flatnonzero((at + half) % up == phase)
        if len(own):
            part = taps[phase::up]
            newest = (at[own] + half) // up + half // up + 1  # index into padded of the newest sample
            series = np.convolve(padded, part)
            out[own] = series[newest]
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def text_payload(text: str | None, unit: int = 192) -> tuple[int, bytes]:
    """(bytes of the text, its UTF-8 filled with spaces to a positive multiple of ``unit``)."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def encode_texts(docs: DataFrame, text_col: str = "text", codec: str | Column = "mu_law", rate: int = 8000, unit: int = 192) -> DataFrame:
    """All columns of ``docs`` but ``text_col`` and, added or replaced: ``codec``, ``n_bytes`` (long)
    and ``media`` (binary), a WAV file.

    The text's bytes, filled with spaces to a positive multiple of ``unit``, are the codes of a
    mu-law or A-law file, or the blocks (of ``unit`` bytes) of an IMA ADPCM file; ``codec``
    names one of :data:`CODECS`, for all rows or by row. Lossless for every text. No shuffle.

    Defined cases: null counts as empty, a null codec as mu-law, another codec is an error;
    repeated rows stay; an empty table gives an empty table; a very long text is one file.
    """
    own = [text_col, "codec", "n_bytes", "media"]
    rest = [c for c in docs.columns if c not in own]
    codec = F.coalesce(F.lit(codec) if isinstance(codec, str) else codec, F.lit("mu_law"))
    schema = docs.select(*rest, F.lit("").alias("codec"), F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in byte_slices(b, len(rest) + 1):
                sizes, files = [], []
                for name, text in zip(*[part.column(len(rest) + i).to_pylist() for i in range(2)], strict=True):
                    n, payload = text_payload(text, unit)
                    sizes.append(n)
                    files.append(wav_bytes(payload, IMA_ADPCM, rate, 4, unit) if name == "ima_adpcm" else wav_bytes(payload, CODECS[name], rate))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [*rest, "codec", "n_bytes", "media"])

    return docs.select(*rest, codec.alias("codec"), text_col).mapInArrow(run, schema)


#: What decoding adds: name and type.
DECODED = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "pcm_bytes": "long", "pcm_sha256": "string", "error": "string"}
_DECODED = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def _described(media: bytes, file: tuple, pcm: np.ndarray, rate: int, tail: int) -> tuple:
    """Values of :data:`DECODED` and the resampled PCM of one file."""
    payload, x = file[-1], pcm.astype(np.float64)
    signs = np.signbit(x)
    stats = (len(x), x.mean(), np.sqrt(np.mean(x * x)), np.abs(x).max(), np.count_nonzero(signs[1:] != signs[:-1])) if len(x) else (0, 0.0, 0.0, 0.0, 0)
    stored = resample(pcm, file[2], rate).astype("<i2").tobytes()
    feature = "samples={};mean={:.3f};rms={:.3f};peak={:.0f};crossings={};pcm={:08x}".format(*stats, zlib.crc32(stored))
    sha = hashlib.sha256(media).hexdigest()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(media), sha, feature, len(stored), hashlib.sha256(stored).hexdigest(), None, stored


def decode_media(df: DataFrame, media_col: str = "media", rate: int = 16000, tail: int = 16, pcm: bool = False) -> DataFrame:
    """All columns of ``df`` but ``media_col`` and, added or replaced, what its WAV files hold.

    ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (of the last ``tail`` bytes) describe the
    data chunk as read back, ``media_bytes``, ``media_sha256`` the file; ``feature`` gives
    samples, mean, root mean square, peak and zero crossings of the decoded audio and a CRC
    of the audio at ``rate``, ``pcm_bytes`` and ``pcm_sha256`` the size and digest of the latter.
    With ``pcm`` it is also stored, in a column ``pcm`` of little-endian 16-bit samples; it is
    several times the file's size.

    Mu-law and A-law go through 256-entry tables, the ADPCM blocks of many files are decoded
    side by side in numpy. No shuffle; a task holds about 4 MB of files and their audio, or
    one longer file, at a time.

    Defined cases: a null or broken file gets nulls and its ``error``; an empty data chunk
    gives no audio; repeated rows stay; an empty table gives an empty table.
    """
    added = {**DECODED, "pcm": "binary"} if pcm else DECODED
    rest = [c for c in df.columns if c != media_col and c not in DECODED and c != "pcm"]
    schema = df.select(*rest, *[F.lit(None).cast(t).alias(n) for n, t in added.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in byte_slices(b, len(rest)):
                made, files = [], []
                for media in part.column(len(rest)).to_pylist():
                    made.append([None] * 8 + ["no file", None])
                    if media is not None:
                        made[-1][3:5] = len(media), hashlib.sha256(media).hexdigest()
                        try:
                            files.append((len(made) - 1, media, wav_chunks(media)))
                        except ValueError as e:
                            made[-1][8] = str(e)
                for (i, media, file), audio in zip(files, decode_wavs([f for *_, f in files]), strict=True):
                    if isinstance(audio, ValueError):
                        made[i][8] = str(audio)
                    else:
                        made[i] = _described(media, file, audio, rate, tail)
                new = [pa.array([m[k] for m in made], t) for k, t in enumerate(_DECODED[: len(added)])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*rest, *added])

    return df.select(*rest, media_col).mapInArrow(run, schema)
