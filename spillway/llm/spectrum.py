"""Leading eigenpairs of a symmetric matrix by spectrum slicing and Rayleigh quotient iteration.

By Sylvester's law of inertia, the LDLᵀ factors of ``matrix - shift`` have as many positive pivots
as the matrix has eigenvalues above the shift.  Counts at a few shifts isolate each leading
eigenvalue in an interval of its own; Rayleigh quotient iteration then converges cubically from
there, and counts on both sides of what it found certify the number of the eigenvalue.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed value: with pivots chosen by this ratio, entries of the factors grow least (Bunch, Parlett).
_RATIO = (1 + 17**0.5) / 8
#: Eigenvalues closer than this part of the largest one are found together; vectors of eigenvalues
#: closer than the second part are kept orthogonal to each other.
_TOGETHER, _NEAR = 1e-11, 1e-3


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``matrix`` are larger than ``shift``: the positive
    pivots of an LDLᵀ factorisation with symmetric pivoting, in blocks of one and two."""
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        on = np.abs(np.diagonal(a))
        r = int(on.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        i, j = divmod(int(off.argmax()), len(a))
        if on[r] == 0 and off[i, j] == 0:
            break  # the rest is zero: eigenvalues at the shift
        if on[r] >= _RATIO * off[i, j]:
            own = [r]
            positive += int(a[r, r] > 0)
        else:  # a block of two with a negative determinant: one eigenvalue on each side
            own = [i, j]
            positive += 1
        rest = np.delete(np.arange(len(a)), own)
        left = a[np.ix_(rest, own)]
        a = a[np.ix_(rest, rest)] - left @ np.linalg.solve(a[np.ix_(own, own)], left.T)
        a = (a + a.T) / 2
    return positive


@dataclass(frozen=True)
class Eigenpairs:
    """``values`` fall; ``vectors`` has a unit column for each."""

    values: np.ndarray
    vectors: np.ndarray


def leading(matrix: np.ndarray, number: int) -> Eigenpairs:
    """The ``number`` largest positive eigenvalues and their vectors, or all positive ones if there
    are fewer; eigenvalues within rounding of zero do not count.

    Equal eigenvalues share a space of several dimensions; any orthonormal basis of it is a right
    answer, and one is returned.
    """
    matrix = (matrix + matrix.T) / 2
    size = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0))
    none = Eigenpairs(np.empty(0), np.empty((size, 0)))
    if not norm or not np.isfinite(norm):
        return none
    counts: dict[float, int] = {}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(matrix, shift)
        return counts[shift]

    floor = norm * size * np.finfo(float).eps * 8
    number = min(number, count(floor))
    values, vectors = np.empty(0), np.empty((size, 0))
    # Intervals (low, high] of the spectrum, the highest on top.
    slices = [(floor, norm * (1 + 1e-12) + floor)]
    while slices and len(values) < number:
        low, high = slices.pop()
        inside = count(low) - count(high)
        if not inside:
            continue
        if inside == 1 or high - low <= _TOGETHER * norm:
            found = _refined(matrix, low, high, inside, values, vectors, norm)
            if found is not None and _certified(count, *found, norm, len(values)):
                values = np.append(values, found[0])
                vectors = np.concatenate([vectors, found[1]], axis=1)
                continue
            if high - low <= 1e-15 * norm:
                raise ArithmeticError("an eigenvalue could not be certified")
        middle = (low + high) / 2
        slices += [(low, middle), (middle, high)]
    return Eigenpairs(values[:number], vectors[:, :number])


def _refined(matrix, low, high, inside, values, vectors, norm):
    """The eigenpairs in ``(low, high]``: Rayleigh quotient iteration for one, inverse iteration of
    a block and its Ritz pairs for several; None if it went astray."""
    near = vectors[:, np.abs(values - high) <= _NEAR * norm + (high - low)]
    start = np.random.default_rng(inside).normal(size=(len(matrix), inside))
    shift, margin = (low + high) / 2, 4 * len(matrix) * np.finfo(float).eps * norm
    for step in range(60):
        start = start - near @ (near.T @ start)
        start, _ = np.linalg.qr(start)
        middle = start.T @ matrix @ start
        if inside == 1:
            ritz, own = middle[0], start
            if step > 2 and low - margin <= ritz[0] <= high + margin:
                shift = float(ritz[0])  # cubic from here on
        else:
            ritz, turn = np.linalg.eigh(middle)
            ritz, own = ritz[::-1], start @ turn[:, ::-1]
        off = np.linalg.norm(matrix @ own - own * ritz, axis=0).max()
        if step > 3 and off <= margin and low - margin <= ritz.min() and ritz.max() <= high + margin:
            return ritz, own
        shifted = matrix - shift * np.eye(len(matrix))
        try:
            start = np.linalg.solve(shifted, own)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            start = np.linalg.solve(shifted + margin / 4 * np.eye(len(matrix)), own)
        if not np.isfinite(start).all():
            return None
    return None


def _certified(count, ritz, own, norm, before: int) -> bool:
    """Whether counts number the pairs ``before + 1`` to ``before + len(ritz)``."""
    slack = max(_TOGETHER, 64 * len(own) * np.finfo(float).eps) * norm
    return count(ritz.max() + slack) <= before and count(ritz.min() - slack) >= before + len(ritz)
