"""Array steps of ``neural_lm`` as graphs of ONNX Runtime, which fuses and vectorises what numpy does one
by one.  Graphs are written in ONNX's wire format; nothing is read from files.  Without the
library (``usable()``) the callers take their numpy form of the same steps.

Rows that belong to one parent are cut into chunks of equal length, so that all products of a call are
one batch (``chunks``); what a chunk lacks are rows of zeros.
"""

from __future__ import annotations

import functools

import numpy as np

try:
    import onnxruntime
except ImportError:
    onnxruntime = None

_FLOAT, _INT64 = 1, 7


def usable() -> bool:
    return onnxruntime is not None


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(k: int, x) -> bytes:
    if isinstance(x, int):
        return _number(k << 3) + _number(x)
    x = x.encode() if isinstance(x, str) else x
    return _number(k << 3 | 2) + _number(len(x)) + x


def _node(op: str, inputs: str, output: str, **attributes) -> bytes:
    """A node; the attributes are integers, texts or lists of integers."""
    out = b"".join(_field(1, x) for x in inputs.split()) + _field(2, output) + _field(4, op)
    for name, x in attributes.items():
        held = _field(3, x) + _field(20, 2) if isinstance(x, int) else _field(4, x) + _field(20, 3) if isinstance(x, str) else b"".join(_field(8, i) for i in x) + _field(20, 7)
        out += _field(5, _field(1, name) + held)
    return _field(1, out)


def _session(nodes: list[bytes], inputs: dict[str, tuple[int, int]], outputs: str):
    """A graph; ``inputs`` have a type and a rank."""
    out = b"".join(nodes) + _field(2, "graph")
    for name, (kind, rank) in inputs.items():
        out += _field(11, _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, _field(1, b"") * rank))))
    for name in outputs.split():
        out += _field(12, _field(1, name) + _field(2, _field(1, _field(1, _FLOAT))))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    model = _field(1, 8) + _field(8, _field(1, b"") + _field(2, 18)) + _field(7, out)
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])


@functools.cache
def _upper():
    nodes = [
        _node("Transpose", "t", "t_t", perm=[0, 2, 1]), _node("MatMul", "ra t_t", "s"), _node("Sigmoid", "s", "p"),
        _node("Reshape", "p flat", "p_flat"), _node("Gather", "p_flat own", "p_own"), _node("Mul", "p_own per", "less"), _node("Sub", "per less", "up"),
        _node("ScatterND", "p_flat own_at up", "g_flat", reduction="add"), _node("Shape", "p", "shape"), _node("Reshape", "g_flat shape", "g"),
        _node("Transpose", "g", "g_t", perm=[0, 2, 1]), _node("MatMul", "g rows", "dr"), _node("MatMul", "g_t r", "total"), _node("MatMul", "mask g", "total_bias"),
    ]
    inputs = {x: (_FLOAT, 3) for x in ("ra", "r", "t", "rows", "mask")} | {"own": (_INT64, 1), "own_at": (_INT64, 2), "per": (_FLOAT, 1), "flat": (_INT64, 1)}
    return _session(nodes, inputs, "dr total total_bias")


def upper(ra: np.ndarray, r: np.ndarray, t: np.ndarray, rows: np.ndarray, own: np.ndarray, per: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """For a batch of chunks whose rows choose among siblings (``t``: embeddings and biases), with g = 1 / (1 + exp(-score)),
    raised by (1 - g) * ``per`` at the own ones (places among all scores): the products of g with ``rows`` (of the siblings), with
    ``r`` and with ``mask``."""
    return _upper().run(None, {"ra": ra, "r": r, "t": t, "rows": rows, "own": own, "own_at": own[:, None], "per": per, "mask": mask, "flat": np.array([-1])})


@functools.cache
def _sums():
    nodes = [_node("ConstantOfShape", "shape", "zeros"), _node("ScatterND", "zeros at x", "y", reduction="add")]
    return _session(nodes, {"shape": (_INT64, 1), "at": (_INT64, 2), "x": (_FLOAT, 2)}, "y")


def sums(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows that belong to each of ``n`` places."""
    return _sums().run(None, {"shape": np.array([n, rows.shape[1]]), "at": at[:, None], "x": rows})[0]


@functools.cache
def _log_choice(small: bool):
    nodes = [_node("Transpose", "t", "t_t", perm=[0, 2, 1]), _node("MatMul", "ra t_t", "s"), _node("GatherElements", "s own", "s_own", axis=2)]
    if not small:
        nodes += [_node("ReduceMax", "s axes", "top", keepdims=1), _node("Sub", "s top", "below"), _node("Sub", "s_own top", "own_below")]
    s, own = ("s", "s_own") if small else ("below", "own_below")
    nodes += [_node("Exp", s, "e"), _node("MatMul", "e ones", "z"), _node("Log", "z", "log_z"), _node("Sub", f"{own} log_z", "y")]
    inputs = {"ra": (_FLOAT, 3), "t": (_FLOAT, 3), "ones": (_FLOAT, 2), "own": (_INT64, 3)}
    return _session(nodes, inputs if small else inputs | {"axes": (_INT64, 1)}, "y")


def log_choice(ra: np.ndarray, t: np.ndarray, own: np.ndarray, small: bool) -> np.ndarray:
    """Log-probability of the own one among the siblings, for each row of each chunk (``small``:
    no score can leave the range of exp)."""
    arrays = {"ra": ra, "t": t, "own": own, "ones": np.ones((t.shape[1], 1), np.float32)}
    return _log_choice(small).run(None, arrays if small else arrays | {"axes": np.array([2])})[0]


def chunks(parent: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of rows in the order of their parents: the rows of each (as many as there are for a row it lacks),
    the places that hold rows, the parent of each, and the first chunk of each parent."""
    n = len(parent)
    begin = np.flatnonzero(np.diff(parent, prepend=-1))
    size = np.diff(begin, append=n)
    many = -(-size // length)
    first = np.cumsum(many) - many
    start = np.repeat(begin - first * length, many) + np.arange(many.sum()) * length
    at = start[:, None] + np.arange(length)
    held = at < np.repeat(begin + size, many)[:, None]
    return np.where(held, at, n), np.flatnonzero(held), np.repeat(parent[begin], many), first
