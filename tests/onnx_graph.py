"""Small ONNX files, written field by field: the stand-in models as graphs."""

import struct


def number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(key, value):
    if isinstance(value, int):
        return number(key << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(key << 3 | 2) + number(len(value)) + value


def ints(name, values):
    return field(5, field(1, name) + b"".join(field(8, v) for v in values) + field(20, 7))


def node(kind, inputs, output, attributes=b""):
    return field(1, b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, kind) + attributes)


def value(name, shape):
    dims = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in shape)
    return field(1, name) + field(2, field(1, field(1, 1) + field(2, dims)))


def model(body, shape, out_shape):
    graph = body + field(2, "g") + field(11, value("x", shape)) + field(12, value("y", out_shape))
    return field(1, 7) + field(7, graph) + field(8, field(1, "") + field(2, 11))


def detector(height=200, width=100):
    """y = x + 0.5"""
    half = field(5, field(2, 1) + field(8, "half") + field(9, struct.pack("<f", 0.5)))
    shape = ["n", 1, height, width]
    return model(node("Add", ["x", "half"], "y") + half, shape, shape)


def recogniser(height=64, step=4):
    """The largest of each four columns, as [steps, n, height]."""
    pool = node("MaxPool", ["x"], "p", ints("kernel_shape", [1, step]) + ints("strides", [1, step]))
    body = pool + node("Squeeze", ["p"], "s", ints("axes", [1])) + node("Transpose", ["s"], "y", ints("perm", [2, 0, 1]))
    return model(body, ["n", 1, height, "w"], ["t", "n", height])
