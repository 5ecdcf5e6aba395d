"""Small computation graphs for onnxruntime, written as ONNX protobufs (the onnx package isn't needed)."""

from __future__ import annotations

import numpy as np

try:
    import onnxruntime
except ImportError:  # callers compute in numpy then
    onnxruntime = None

#: ONNX's codes of element types, and the version of the operators.
KINDS, OPSET = {"f": 1, "i": 7}, 17


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _part(field: int, x: bytes | str) -> bytes:
    x = x.encode() if isinstance(x, str) else x
    return _varint(field << 3 | 2) + _varint(len(x)) + x


def node(kind: str, inputs: str, output: str, **settings: int | str | list[int]) -> bytes:
    """An operator; inputs: names parted by blanks."""
    made = b""
    for k, v in settings.items():
        value = _int(3, v) + _int(20, 2) if isinstance(v, int) else _part(4, v) + _int(20, 3) if isinstance(v, str) else b"".join(_int(8, x) for x in v) + _int(20, 7)
        made += _part(5, _part(1, k) + value)
    return _part(1, b"".join(_part(1, x) for x in inputs.split()) + _part(2, output) + _part(4, kind) + made)


def constant(name: str, x: np.ndarray) -> bytes:
    return _part(5, b"".join(_int(1, n) for n in x.shape) + _int(2, KINDS[x.dtype.kind]) + _part(8, name) + _part(9, x.tobytes()))


def session(parts: list[bytes], inputs: str, whole: str, outputs: str):
    """A graph of nodes and constants on one thread; inputs: of 32-bit floats, whole: of 64-bit integers."""
    value = lambda field, name, kind: _part(field, _part(1, name) + _part(2, _part(1, _int(1, kind))))
    ends = [value(11, x, 1) for x in inputs.split()] + [value(11, x, 7) for x in whole.split()] + [value(12, x, 1) for x in outputs.split()]
    made = _int(1, 8) + _part(8, _part(1, "") + _int(2, OPSET)) + _part(7, b"".join([*parts, _part(2, "graph"), *ends]))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    return onnxruntime.InferenceSession(made, options, providers=["CPUExecutionProvider"])
