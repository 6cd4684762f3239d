"""Spectrum of a symmetric positive semidefinite matrix of whole numbers, from its exact characteristic polynomial.

The polynomial is found modulo primes (Hessenberg form by similarity, then a recurrence), each
on its own, and put together by Chinese remaindering. All its roots are real, so the number of
roots above a point is exactly the number of changes of sign among the coefficients about that
point (multiple roots count as often). Halving intervals by that count isolates the wanted
roots; a single root is narrowed by signs of the polynomial. Eigenvectors are null vectors of
the matrix less a root, by inverse iteration with far more digits than the result has.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb, gcd

import numpy as np

#: Bits of a root beyond its leading one; roots closer than the second number of bits share a space of vectors.
BITS, TOGETHER = 72, 50
#: Decimal digits and rounds of the inverse iteration.
DIGITS, ROUNDS = 90, 4


def is_prime(n: int) -> bool:
    """For n below 2^32."""
    if n < 2 or any(n % q == 0 for q in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(matrix: list[list[int]]) -> list[int]:
    """Primes below 2^31 whose product exceeds twice the largest coefficient.

    Elementary symmetric functions of d numbers, none negative, are largest when all are equal.
    """
    d, trace = len(matrix), sum(matrix[k][k] for k in range(len(matrix)))
    most = 2 * max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    found, product, n = [], 1, (1 << 31) - 1
    while product <= most:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``p``, of x^0 first."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * f % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        weights = np.zeros(k, np.int64)
        weights[k - 1], chain = h[k - 1, k - 1], 1
        for i in range(k - 2, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            weights[i] = chain * int(h[i, k - 1]) % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (weights[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d]


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The whole coefficients whose residues modulo each prime are given, the ones of least size."""
    product = 1
    for p in residues:
        product *= p
    parts = {p: product // p * pow(product // p, -1, p) for p in residues}
    out = []
    for k in range(len(next(iter(residues.values())))):
        c = sum(int(r[k]) * parts[p] for p, r in residues.items()) % product
        out.append(c - product if 2 * c > product else c)
    return out


@dataclass(frozen=True)
class Root:
    """An eigenvalue ``at`` / 2^``scale``, that stands for ``times`` eigenvalues."""

    at: int
    scale: int
    times: int


class Roots:
    """Real-rooted polynomial with whole coefficients and no negative root."""

    def __init__(self, coefficients: list[int]) -> None:
        self.zeros = next(k for k, c in enumerate(coefficients) if c)
        self.plain = coefficients[self.zeros :]
        self.degree = len(self.plain) - 1
        signs = [c < 0 for c in reversed(self.plain) if c]
        if sum(a != b for a, b in zip(signs, signs[1:])) != self.degree:
            raise ArithmeticError("the polynomial has roots that are not positive")

    def scaled(self, scale: int) -> list[int]:
        """Coefficients of the polynomial whose roots are 2^``scale`` times as large."""
        return [c << scale * (self.degree - k) for k, c in enumerate(self.plain)]

    @staticmethod
    def above(coefficients: list[int], point: int) -> int:
        """Roots greater than ``point``."""
        c = list(coefficients)
        n = len(c) - 1
        for i in range(n):  # the polynomial about the point, by repeated Horner steps
            for k in range(n - 1, i - 1, -1):
                c[k] += point * c[k + 1]
        signs = [x < 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    @staticmethod
    def sign(coefficients: list[int], point: int) -> int:
        value = 0
        for c in reversed(coefficients):
            value = value * point + c
        return (value > 0) - (value < 0)

    def largest(self, wanted: int) -> list[Root]:
        """The ``wanted`` largest roots, or as many as are not zero, in falling order."""
        wanted = min(wanted, self.degree)
        if not wanted:
            return []
        whole, trace = self.scaled(0), -self.plain[-2]
        high = trace.bit_length()
        if self.above(whole, 1) >= wanted:  # the exponent of the least wanted root
            low, top = 0, high
            while low < top:
                middle = (low + top + 1) // 2
                low, top = (middle, top) if self.above(whole, 1 << middle) >= wanted else (low, middle - 1)
            scale = max(0, BITS - low)
        else:
            scale = BITS
            while self.above(self.scaled(scale), 1 << BITS) < wanted:
                scale *= 2
        c = self.scaled(scale)
        stack = [(0, (trace << scale) + 1, self.degree, 0)]
        found: list[tuple[int, int]] = []
        while stack and sum(n for _, n in found) < wanted:
            low, high, more, less = stack.pop()  # roots above low and above high
            if more - less == 1:
                found.append((self.narrowed(c, low, high), 1))
            elif high - low == 1:
                found.append((high, more - less))
            elif more > less:
                middle = (low + high) // 2
                n = self.above(c, middle)
                stack += [(low, middle, more, n), (middle, high, n, less)]
        roots: list[Root] = []
        for at, n in found:
            if roots and (roots[-1].at - at) << TOGETHER < roots[-1].at:
                roots[-1] = Root(roots[-1].at, scale, roots[-1].times + n)
            else:
                roots.append(Root(at, scale, n))
        return roots

    def narrowed(self, c: list[int], low: int, high: int) -> int:
        """The single root in (low, high], up to one; only its leading bits count."""
        end = self.sign(c, high)
        if not end:
            return high
        while (high - low) << BITS > high and high - low > 1:
            middle = (low + high) // 2
            at = self.sign(c, middle)
            if not at:
                return middle
            low, high = (low, middle) if at == end else (middle, high)
        return (low + high) // 2


def null_vectors(matrix: list[list[int]], root: Root) -> list[list[float]]:
    """Unit vectors, orthogonal to each other, that the matrix turns into about ``root`` times themselves."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        value = Decimal(root.at) / Decimal(1 << root.scale)
        a = [[Decimal(x) - value if i == j else Decimal(x) for j, x in enumerate(row)] for i, row in enumerate(matrix)]
        size = max(abs(x) for row in a for x in row) or Decimal(1)
        order = list(range(d))
        for k in range(d):  # triangular factors with row exchanges
            best = max(range(k, d), key=lambda r: abs(a[r][k]))
            a[k], a[best] = a[best], a[k]
            order[k], order[best] = order[best], order[k]
            if not a[k][k]:
                a[k][k] = size.scaleb(-DIGITS // 2)
            top, pivot = a[k], a[k][k]
            for r in range(k + 1, d):
                if a[r][k]:
                    f = a[r][k] / pivot
                    row = a[r]
                    row[k + 1 :] = [x - f * y for x, y in zip(row[k + 1 :], top[k + 1 :])]
                    row[k] = f

        def solved(b: list[Decimal]) -> list[Decimal]:
            x = [b[i] for i in order]
            for i in range(d):
                x[i] -= sum(map(Decimal.__mul__, a[i][:i], x[:i]), Decimal(0))
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - sum(map(Decimal.__mul__, a[i][i + 1 :], x[i + 1 :]), Decimal(0))) / a[i][i]
            return x

        def dot(x: list[Decimal], y: list[Decimal]) -> Decimal:
            return sum(map(Decimal.__mul__, x, y), Decimal(0))

        vectors = [[Decimal((7919 * (i + 1) * (s + 1) + i * i) % 1009 + 1) for i in range(d)] for s in range(root.times)]
        for _ in range(ROUNDS):
            done: list[list[Decimal]] = []
            for v in vectors:
                v = solved(v)
                for u in done * 2:
                    t = dot(u, v)
                    v = [x - t * y for x, y in zip(v, u)]
                length = dot(v, v).sqrt()
                done.append([x / length for x in v])
            vectors = done
        out = []
        for v in vectors:
            lead = max(v, key=abs)
            out.append([float(x) if lead > 0 else float(-x) for x in v])
        return out


def reduced(matrix: list[list[int]]) -> tuple[list[list[int]], int]:
    """The matrix without the common divisor of its entries, and that divisor."""
    g = gcd(*(x for row in matrix for x in row)) or 1
    return [[x // g for x in row] for row in matrix], g
