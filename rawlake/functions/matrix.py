"""3x3 matrices as arrays of nine doubles, row by row.

The functions take and give SQL expression text; ``F.expr`` makes a column of
it. A matrix step names dozens of cells, and one parsed text is far quicker to
hand to Spark than as many column objects. Arguments may be column names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from rawlake import vocab

# ---------------------------------------------------------------------------
# Cone-response matrices of the two adaptation methods.
# ---------------------------------------------------------------------------
BRADFORD = [0.8951, 0.2664, -0.1614, -0.7502, 1.7135, 0.0367, 0.0389, -0.0685, 1.0296]
BRADFORD_INV = [
    0.9869929, -0.1470543, 0.1599627,
    0.4323053, 0.5183603, 0.0492912,
    -0.0085287, 0.0400428, 0.9684867,
]
CAT16 = [0.401288, 0.650173, -0.051461, -0.250268, 1.204414, 0.045854, -0.002079, 0.048952, 0.953127]
CAT16_INV = [
    1.86206786, -1.01125463, 0.14918678,
    0.38752654, 0.62144744, -0.00897398,
    -0.01584150, -0.03412294, 1.04996444,
]
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


_names = count()


def number(value: float) -> str:
    """A double literal; a bare SQL constant would be a decimal."""
    return f"{float(value)!r}D"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is computed once, however often it is used.

    Chained steps name every cell several times; binding keeps the expression
    small where inlining would triple it with each step.
    """
    name = f"v{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def let2(a: str, b: str, body: Callable[[str, str], str]) -> str:
    return let(a, lambda x: let(b, lambda y: body(x, y)))


def array(cells) -> str:
    return f"array({', '.join(cells)})"


def constant(values) -> str:
    return array(number(v) for v in values)


def product(a: str, b: str) -> str:
    """Matrix product."""
    return let2(
        a,
        b,
        lambda x, y: array(
            f"{x}[{3 * r}] * {y}[{c}] + {x}[{3 * r + 1}] * {y}[{c + 3}] + {x}[{3 * r + 2}] * {y}[{c + 6}]"
            for r in range(3)
            for c in range(3)
        ),
    )


def apply(matrix: str, vector: str) -> str:
    """Matrix times a vector, both arrays."""
    return let2(
        matrix,
        vector,
        lambda m, v: array(f"{m}[{3 * r}] * {v}[0] + {m}[{3 * r + 1}] * {v}[1] + {m}[{3 * r + 2}] * {v}[2]" for r in range(3)),
    )


def transpose(matrix: str) -> str:
    return let(matrix, lambda m: array(f"{m}[{3 * c + r}]" for r in range(3) for c in range(3)))


def inverse(matrix: str) -> str:
    """Inverse from cofactors; cells are null for a singular matrix."""

    def minor(m: str, r: int, c: int) -> str:
        p, q = sorted({0, 1, 2} - {r})
        s, t = sorted({0, 1, 2} - {c})
        value = f"{m}[{3 * p + s}] * {m}[{3 * q + t}] - {m}[{3 * p + t}] * {m}[{3 * q + s}]"
        return f"({value})" if (r + c) % 2 == 0 else f"-({value})"

    def cofactors(m: str) -> str:
        det = " + ".join(f"{m}[{c}] * {minor(m, 0, c)}" for c in range(3))
        adjugate = array(minor(m, c, r) for r in range(3) for c in range(3))
        return let2(adjugate, f"try_divide(1D, {det})", lambda adj, d: f"transform({adj}, c -> {d} * c)")

    return let(matrix, cofactors)


def mean_of(a: str, b: str, t: float = 0.5) -> str:
    """Element-wise blend of two matrices."""
    return f"zip_with({a}, {b}, (x, y) -> x * {number(1.0 - t)} + y * {number(t)})"


def scale_rows(matrix: str, factors: str) -> str:
    return let2(matrix, factors, lambda m, f: array(f"{m}[{i}] * {f}[{i // 3}]" for i in range(9)))


def scale_cols(matrix: str, factors: str) -> str:
    return let2(matrix, factors, lambda m, f: array(f"{m}[{i}] * {f}[{i % 3}]" for i in range(9)))


def row_sums(matrix: str) -> str:
    return let(matrix, lambda m: array(f"{m}[{3 * r}] + {m}[{3 * r + 1}] + {m}[{3 * r + 2}]" for r in range(3)))


def white_xyz(x: str, y: str) -> str:
    """M4: XYZ of a chromaticity with Y = 1."""
    return f"array({x} / {y}, 1D, (1D - {x} - {y}) / {y})"


def rgb_to_xyz(primaries: list[str], white: list[str]) -> str:
    """M2: RGB to XYZ from primaries and a white point."""
    xs, ys = primaries[0::2], primaries[1::2]
    top, low = [f"{x} / {y}" for x, y in zip(xs, ys)], [f"(1D - {x} - {y}) / {y}" for x, y in zip(xs, ys)]
    base = array([*top, "1D", "1D", "1D", *low])
    return let(base, lambda m: scale_cols(m, apply(inverse(m), white_xyz(*white))))


def xyz_to_rgb(primaries: list[str], white: list[str]) -> str:
    """M2: XYZ to RGB from primaries and a white point."""
    return inverse(rgb_to_xyz(primaries, white))


def _cone_factors(cone: list[float], source: str, target: str) -> str:
    return f"zip_with({apply(constant(cone), target)}, {apply(constant(cone), source)}, (d, s) -> d / s)"


def bradford(source: str, target: str | None = None) -> str:
    """M3: Bradford adaptation from one white to another."""
    factors = _cone_factors(BRADFORD, source, target or constant(vocab.D65))
    return product(constant(BRADFORD_INV), scale_rows(constant(BRADFORD), factors))


def cat16_adapt(xyz: str, source: str, target: str) -> str:
    """M4: CAT16 adaptation of one colour."""
    scaled = f"zip_with({apply(constant(CAT16), xyz)}, {_cone_factors(CAT16, source, target)}, (v, f) -> v * f)"
    return apply(constant(CAT16_INV), scaled)


def cat16_output(cam_to_xyz: str, source: str, target: str, xyz_to_out: str) -> str:
    """M4: camera to output matrix through a CAT16 adaptation."""
    adapted = scale_rows(product(constant(CAT16), cam_to_xyz), _cone_factors(CAT16, source, target))
    return product(xyz_to_out, product(constant(CAT16_INV), adapted))


def white_distance(matrix: str) -> str:
    """Squared distance of the row sums to D50; infinite if undefined."""

    def squared(s: str) -> str:
        total = " + ".join(f"({s}[{i}] - {number(w)}) * ({s}[{i}] - {number(w)})" for i, w in enumerate(vocab.D50))
        return f"coalesce(nanvl({total}, double('Infinity')), double('Infinity'))"

    return let(row_sums(matrix), squared)


def _ranked(m: str) -> str:
    """Four readings of a matrix with their white distance, the nearest first."""

    def entries(m: str, t: str) -> str:
        listed = [m, t, inverse(m), inverse(t)]
        return array(f"struct({white_distance(c)} AS dist, {i} AS pos)" for i, c in enumerate(listed))

    return let(transpose(m), lambda t: f"array_min({entries(m, t)})")


def orientation_pick(matrix: str) -> str:
    """Number of the winning reading (0 as is, 1 transposed, 2 and 3 inverted)."""
    return let(matrix, lambda m: f"{_ranked(m)}.pos")


def oriented(matrix: str) -> str:
    """The matrix, its transpose or an inverse, whichever white is nearest D50.

    The first reading wins ties, and one that is undefined never wins.
    """

    def pick(m: str, best: str) -> str:
        t = transpose(m)
        return (
            f"CASE WHEN {best}.dist = double('Infinity') OR {best}.pos = 0 THEN {m} WHEN {best}.pos = 1 THEN {t} "
            f"WHEN {best}.pos = 2 THEN {inverse(m)} ELSE {inverse(t)} END"
        )

    return let(matrix, lambda m: let(_ranked(m), lambda best: pick(m, best)))


def dot_rows(matrix: str, vector: list[str]) -> list[Column]:
    """Matrix column times the named channels, for per-pixel work (no binding)."""
    r, g, b = vector
    m = matrix
    return [F.expr(f"{m}[{3 * i}] * {r} + {m}[{3 * i + 1}] * {g} + {m}[{3 * i + 2}] * {b}") for i in range(3)]
