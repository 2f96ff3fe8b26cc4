"""Media columns: audio features of 8-bit samples stored as WAV.

A payload is stored as unsigned 8-bit mono samples in a WAV container (a binary column), read
back from the stored bytes, resampled by a polyphase filter, cut into overlapping frames whose
log-mel energies are kept as fixed-shape Arrow tensors with time spans, and segmented by energy
with hysteresis: a segment opens above the higher threshold and closes below the lower one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import file_system, in_arrow, passing_folder, shared_dir, texts

UNIT = 192
RATE = 12_000
UP, DOWN = 2, 3
TAPS = 10  # of the filter on either side, in the longer of the two periods
FRAME, HOP, MELS = 256, 128, 20
BLOCK = 32  # frames of a tensor
OPEN, CLOSE = 0.5, -0.25  # standard deviations from the mean energy
CHUNK = 4096  # frames worked on at once: a long payload is never held as floats


def payload(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes with blanks up to a positive multiple of UNIT, number of bytes before)."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b.ljust(max(1, -(-len(b) // UNIT)) * UNIT, b" "), len(b)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    pad = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono WAV, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        if name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _filter() -> np.ndarray:
    """Windowed-sinc low pass at the lower of the two rates, on the fine grid."""
    half = TAPS * max(UP, DOWN)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(UP, DOWN)) * np.kaiser(2 * half + 1, 8.0)
    return h / h.sum() * UP


def _phases() -> tuple[list[np.ndarray], int]:
    """The filter's taps for each output phase, in the order of input samples, and the reach to the left."""
    h = _filter()
    half = len(h) // 2
    reach = half // UP + 1
    out = []
    for p in range(UP):
        # output at fine-grid place p takes input i at fine-grid place UP * i
        k = p - UP * np.arange(-reach, reach + 1) + half
        out.append(np.where((k >= 0) & (k < len(h)), h[np.clip(k, 0, len(h) - 1)], 0.0).astype(np.float32))
    return out, reach


PHASES, REACH = _phases()


def outputs(n: int) -> int:
    """Samples that resample() makes of n."""
    return -(-n * UP // DOWN)


def resample(x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Outputs ``first`` to ``last`` of x at RATE * UP / DOWN: each output phase is one strided filter, nothing is computed on the fine grid.

    Only the inputs that these outputs reach are touched. x may be of unsigned bytes: 128 is silence.
    """
    last = outputs(len(x)) if last is None else last
    low = first * DOWN // UP - REACH  # of the inputs reached
    high = (last - 1) * DOWN // UP + REACH + 1
    pad = np.zeros(max(0, high - low), np.float32)
    part = x[max(0, low) : max(0, high)]
    pad[max(0, -low) : max(0, -low) + len(part)] = (part.astype(np.float32) - 128) / 128 if x.dtype == np.uint8 else part
    view = np.lib.stride_tricks.sliding_window_view(pad, 2 * REACH + 1) if len(pad) > 2 * REACH else np.zeros((0, 2 * REACH + 1), np.float32)
    out = np.empty(max(0, last - first), np.float32)
    for j in range(min(UP, len(out))):  # outputs first + j, first + j + UP, ...: their places step by DOWN
        place, phase = divmod((first + j) * DOWN, UP)
        m = len(range(j, len(out), UP))
        at = place - REACH - low
        out[j::UP] = view[at : at + (m - 1) * DOWN + 1 : DOWN] @ PHASES[phase]
    return out


def _mel_bank() -> np.ndarray:
    """(bins, MELS) triangles, evenly spaced on the mel scale."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    up = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


BANK = _mel_bank()
HANN = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((frames, MELS) log energies in hundredths, (frames,) log energy) of x resampled: overlapping frames, the last padded with zeros. CHUNK frames at once."""
    m = outputs(len(x))
    n = max(1, -(-max(m - FRAME, 0) // HOP) + 1)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n)
    for s in range(0, n, CHUNK):
        e = min(n, s + CHUNK)
        y = np.zeros((e - 1 - s) * HOP + FRAME, np.float32)
        got = resample(x, s * HOP, min(m, s * HOP + len(y)))
        y[: len(got)] = got
        part = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(part * HANN, axis=1)).astype(np.float32) ** 2
        mel[s:e] = np.rint(np.log(power @ BANK + 1e-6) * 100)
        energy[s:e] = np.rint(np.log((part * part).mean(axis=1) + 1e-6) * 1000)
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of the segments that hysteresis opens and closes."""
    mean, dev = float(energy.mean()), float(energy.std())
    if dev == 0:
        return []
    high, low = energy > mean + OPEN * dev, energy < mean + CLOSE * dev
    mark = np.where(high, 1, np.where(low, -1, 0))
    known = np.flatnonzero(mark)
    last = np.zeros(len(mark), np.int64)
    if len(known):
        at = np.searchsorted(known, np.arange(len(mark)), side="right") - 1
        last = np.where(at >= 0, mark[known[np.maximum(at, 0)]], -1)
    inside = np.r_[0, (last > 0).astype(np.int8), 0]
    turns = np.flatnonzero(np.diff(inside))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def tensors(mel: np.ndarray) -> tuple[pa.FixedShapeTensorArray, np.ndarray, np.ndarray]:
    """((BLOCK, MELS) tensors, zero-padded at the end, and each one's start and end in seconds)."""
    n = -(-len(mel) // BLOCK)
    full = np.zeros((n * BLOCK, MELS), np.float32)
    full[: len(mel)] = mel
    rate = RATE * UP / DOWN
    first = np.arange(n) * BLOCK
    last = np.minimum(first + BLOCK, len(mel)) - 1
    return pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, BLOCK, MELS)), first * HOP / rate, (last * HOP + FRAME) / rate


def features(media: bytes) -> dict:
    """What is computed from a stored medium alone."""
    raw, rate = from_wav(media)
    mel, energy = log_mel(np.frombuffer(raw, np.uint8))
    cut = segments(energy)
    block, start, end = tensors(mel)
    digest = hashlib.sha256(block.to_numpy_ndarray().tobytes())
    digest.update(np.array(cut, "<i4").tobytes())
    return {"samples": raw, "rate": rate, "mel": mel, "tensors": block, "start": start, "end": end, "segments": cut, "digest": digest.hexdigest()}


def seconds(cut: list[tuple[int, int]]) -> list[tuple[float, float]]:
    """(start, end) in seconds of segments of frames."""
    rate = RATE * UP / DOWN
    return [(a * HOP / rate, ((b - 1) * HOP + FRAME) / rate) for a, b in cut]


def store_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every text's payload as a WAV. A null or empty text is a payload of blanks. Equal texts give equal media, repeated rows give repeated rows; an empty table gives an empty result. Other columns are not read."""

    def run(batches):
        for b in batches:
            p = [payload(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in p], pa.int64()), pa.array([to_wav(x) for x, _ in p], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary")


SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])


def _blocks(found: list[dict | None]) -> pa.ListArray:
    """Each medium's tensors with their time spans, a list a row; null for a null medium."""
    got = [f for f in found if f is not None]
    n = [0 if f is None else len(f["start"]) for f in found]
    flat = np.concatenate([f["tensors"].to_numpy_ndarray().reshape(-1) for f in got]) if got else np.zeros(0, np.float32)
    mel = pa.ListArray.from_arrays(pa.array(np.arange(sum(n) + 1) * BLOCK * MELS, pa.int32()), pa.array(flat))
    time = [np.concatenate([f[k] for f in got]) if got else np.zeros(0) for k in ("start", "end")]
    at = [None if f is None else int(x) for f, x in zip(found, np.cumsum([0, *n]))] + [sum(n)]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(time[0]), pa.array(time[1]), mel], ["start_s", "end_s", "mel"]))


COLUMNS = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "n_frames": "long", "n_segments": "long"}
TIMES = "start_s:double,end_s:double"


def _described(batches):
    """For every few rows of ``stored``: them, their features (None of a null medium), the arrays of COLUMNS, and the segments' times."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def row(media, f):
        if f is None:
            return (None,) * 8
        raw, cut = f["samples"], f["segments"]
        text = f"frames={len(f['mel'])};segments={len(cut)};inside={sum(b - a for a, b in cut)};sha256={f['digest']}"
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), text, len(f["mel"]), len(cut)

    for b in batches:
        for some in pieces(b, 2):
            media = some.column(2).to_pylist()
            found = [None if m is None else features(m) for m in media]
            c = list(zip(*map(row, media, found))) or [()] * 8
            spans = pa.array([None if f is None else [{"start_s": a, "end_s": e} for a, e in seconds(f["segments"])] for f in found], pa.list_(SPAN))
            yield some, found, [some.column(1), *(pa.array(x, k) for x, k in zip(c, kinds))], spans


def _shape(stored: DataFrame, *own: str) -> str:
    return ", ".join([f"doc_id {stored.schema['doc_id'].dataType.simpleString()}", *(f"{n} {t}" for n, t in COLUMNS.items()), *own, f"spans array<struct<{TIMES}>>"])


def audio_features(stored: DataFrame) -> DataFrame:
    """For ``stored(doc_id, n_bytes, media)``: digests of the payload read back, of the medium, and of its features, and these.

    feature: frames, segments, frames inside segments, and the digest of tensors and segments.
    tensors: the log-mel tensors (BLOCK * MELS values, row-major) with their time spans, in the
    result's rows; write_features() stores them as Arrow tensors. spans: the segments' times. A null medium gives
    nulls. Repeated rows give repeated rows; an empty table gives an empty result. A long medium is
    worked on in chunks; held at once are its bytes and its tensors, less than twice its bytes.
    """

    def run(batches):
        for some, found, columns, spans in _described(batches):
            yield pa.RecordBatch.from_arrays([some.column(0), *columns, _blocks(found), spans], ["doc_id", *COLUMNS, "tensors", "spans"])

    return in_arrow(stored.select("doc_id", "n_bytes", "media"), run, _shape(stored, f"tensors array<struct<{TIMES},mel:array<float>>>"))


class Store:
    """Writes a task's tensors to a file of its own, and gives a row a document: its columns and where its tensors lie."""

    def __init__(self, target: str):
        self.target = target

    def __call__(self, batches):
        system, root = file_system(self.target)
        name = f"tensors-{TaskContext.get().partitionId():06d}.arrow"
        own = f"{root}/{name}.{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        out, sink, k = None, None, 0
        for some, found, columns, spans in _described(batches):
            n = np.array([0 if f is None else len(f["start"]) for f in found], np.int64)
            null = np.array([f is None for f in found], bool)
            if n.sum():
                rows = pa.array(np.repeat(np.arange(len(n)), n))
                flat = _blocks([f for f in found if f is not None]).flatten()
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                held = pa.RecordBatch.from_arrays([some.column(0).take(rows), pa.array(block, pa.int32()), flat.field("start_s"), flat.field("end_s"), tensor_column(flat.field("mel"))], ["doc_id", "block", "start_s", "end_s", "mel"])
                if out is None:
                    sink = system.open_output_stream(own)
                    out = pa.ipc.new_file(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(held)
            places = [pa.array([name] * len(n), mask=null), pa.array(np.full(len(n), k, np.int32), mask=null), pa.array(np.cumsum(n) - n, mask=null), pa.array(n, mask=null)]
            k += int(n.sum() > 0)
            yield pa.RecordBatch.from_arrays([some.column(0), *columns, *places, spans], ["doc_id", *COLUMNS, *PLACES, "spans"])
        if out is not None:
            out.close()
            sink.close()
            system.move(own, f"{root}/{name}")


PLACES = {"tensor_file": "string", "tensor_batch": "int", "first_tensor": "long", "n_tensors": "long"}


def write_features(stored: DataFrame, target: str | None = None) -> DataFrame:
    """audio_features() of ``stored``, with the tensors as fixed-shape Arrow tensors in files below ``target`` and, in their place, where a document's lie.

    A file (Arrow IPC, zstd) holds a task's rows: doc_id, block, start_s, end_s, mel. tensor_file,
    tensor_batch, first_tensor and n_tensors tell a document's rows, for read_tensors(); null for a
    null medium. A file is written under a name of the attempt's own and then renamed, so a
    repeated task writes the same bytes to the same place; what an earlier run or a failed attempt
    left in the folder goes. ``target`` is a folder that all executors share, by default a new one that goes
    with the application. The rows are kept beside the files, in manifest. Repeated rows give
    repeated rows and tensors; an empty table writes no file.
    """
    spark = stored.sparkSession
    target = target or passing_folder(spark, f"{shared_dir(spark)}/audio_tensors/{uuid.uuid4().hex}")
    system, root = file_system(target)
    system.create_dir(root, recursive=True)
    in_arrow(stored.select("doc_id", "n_bytes", "media"), Store(target), _shape(stored, *(f"{n} {t}" for n, t in PLACES.items()))).write.mode("overwrite").parquet(f"{target}/manifest")
    out = spark.read.parquet(f"{target}/manifest")
    files = {r[0] for r in out.select("tensor_file").distinct().collect()}  # one a task
    for f in system.get_file_info(fs.FileSelector(root)):
        if f.base_name.startswith("tensors-") and f.base_name not in files:
            system.delete_file(f.path)
    return out


def read_tensors(target: str, tensor_file: str, tensor_batch: int, first_tensor: int, n_tensors: int) -> pa.RecordBatch:
    """A document's rows of its file, mel being a fixed-shape tensor column; reads one batch."""
    system, root = file_system(target)
    with system.open_input_file(f"{root}/{tensor_file}") as f:
        return pa.ipc.open_file(f).get_batch(tensor_batch).slice(first_tensor, n_tensors)


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 22):
    """The batch's rows in runs of about ``most`` bytes of a binary column, so that what is made of them stays small."""
    size = np.array([0 if m is None else len(m) for m in batch.column(column).to_pylist()], np.int64)
    group = np.cumsum(size) // most
    for s, e in zip(*(lambda cut: (cut, np.r_[cut[1:], len(size)]))(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))) if len(size) else ():
        yield batch.slice(int(s), int(e - s))


def tensor_column(mel: pa.ListArray) -> pa.FixedShapeTensorArray:
    """The mel field of flattened tensors as the fixed-shape tensor type. No null may be in it."""
    flat = mel.flatten()
    kind = pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, BLOCK * MELS))
