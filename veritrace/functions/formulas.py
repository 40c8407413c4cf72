"""Formulas in answers: read into small trees, compared as polynomials where they are polynomials, by probing elsewhere.

Everything here is three-valued: ``None`` means that a text could not be read or two formulas could not be decided,
and is never taken for "different". Texts and numbers beyond the limits below are undecided, too.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Callable
from fractions import Fraction

#: Longest formula, deepest nesting, most terms and longest numbers that are worked out.
TOKENS, DEPTH, TERMS, BITS = 400, 60, 400, 4096
# Commands that stand for a name, and functions of one argument.
GREEK = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi rho sigma tau upsilon "
    "phi varphi chi psi omega Gamma Delta Theta Lambda Xi Sigma Phi Psi Omega infty hbar ell").split()
FUNCTIONS: dict[str, Callable[[complex], complex]] = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x),
    "csc": lambda x: 1 / cmath.sin(x), "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "sinh": cmath.sinh,
    "cosh": cmath.cosh, "tanh": cmath.tanh, "ln": cmath.log, "log": cmath.log, "lg": cmath.log10, "exp": cmath.exp,
    "sqrt": cmath.sqrt, "abs": abs,
}
_NAMES = "|".join([*FUNCTIONS, "pi", "infty"])
_TOKEN = re.compile(r"\\[a-zA-Z]+|(?:\d+\.?\d*|\.\d+)|[a-zA-Z]|\*\*|\S")
_FRACS = re.compile(r"\\[dtc]frac")
_BARE_NAME = re.compile(rf"(?<![a-zA-Z\\])({_NAMES})(?![a-zA-Z])")
_WORD = re.compile(r"(?<![a-zA-Z\\])[a-zA-Z]{4,}")
_DIGIT, _FACTOR, _LETTER, _NAMED = (re.compile(p) for p in (r"[\d.]", r"[a-zA-Z(\\]", "[a-zA-Z]", r"[a-zA-Z]|\\pi"))
_DIGITS = re.compile(r"\d{2,}")
_SPACES = re.compile(r"\\left|\\right|\\displaystyle|\\limits|\\[,;:! ]|~|\\quad|\\qquad")
Tree = tuple


class Unreadable(ValueError):
    """A text that is no formula of the kinds known here."""


class Reader:
    """One pass over the tokens of a formula; products may be written without a sign."""

    def __init__(self, text: str):
        text = _SPACES.sub(" ", text)
        text = _FRACS.sub(r"\\frac", text)
        text = _BARE_NAME.sub(r"\\\1", text)
        if _WORD.search(text):
            raise Unreadable(text)  # a word
        self.tokens = _TOKEN.findall(text)
        if len(self.tokens) > TOKENS:
            raise Unreadable(text)
        self.at = self.depth = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or wanted not in (None, token):
            raise Unreadable(token)
        self.at += 1
        return token

    def whole(self) -> Tree:
        tree = self.sum()
        if self.peek():
            raise Unreadable(self.peek())
        return tree

    def sum(self) -> Tree:
        self.depth += 1
        if self.depth > DEPTH:
            raise Unreadable("nesting")
        terms = [self.product()]
        while self.peek() in ("+", "-"):
            terms.append(("neg", self.product()) if self.take() == "-" else self.product())
        self.depth -= 1
        return terms[0] if len(terms) == 1 else ("add", *terms)

    def product(self) -> Tree:
        if self.peek() in ("-", "+"):
            return ("neg", self.product()) if self.take() == "-" else self.product()
        tree = self.power()
        while True:
            token = self.peek()
            if token in ("*", r"\cdot", r"\times"):
                self.take()
                tree = ("mul", tree, self.signed())
            elif token in ("/", r"\div"):
                self.take()
                tree = ("div", tree, self.signed())
            elif token == r"\frac" and tree[0] == "num":
                raise Unreadable("a whole number before a fraction is a sum to some and a product to others")
            elif _FACTOR.match(token) or (_DIGIT.match(token) and not _DIGIT.match(self.tokens[self.at - 1])):
                tree = ("mul", tree, self.power())
            else:
                return tree

    def signed(self) -> Tree:
        return ("neg", self.signed()) if self.peek() == "-" and self.take() else self.power()

    def power(self) -> Tree:
        tree = self.atom()
        while self.peek() in ("^", "**", "!"):
            if self.take() == "!":
                if tree[0] != "num" or tree[1].denominator != 1 or not 0 <= tree[1] <= 50:
                    raise Unreadable("!")
                tree = ("num", Fraction(math.factorial(int(tree[1]))))
            else:
                tree = ("pow", tree, self.group() if self.peek() == "{" else self.signed_atom())
        return tree

    def signed_atom(self) -> Tree:
        return ("neg", self.atom()) if self.peek() == "-" and self.take() else self.atom()

    def group(self) -> Tree:
        self.take("{")
        tree = self.sum()
        self.take("}")
        return tree

    def argument(self) -> Tree:
        r"""``{...}``, or the one digit or letter that a command takes without braces."""
        if self.peek() == "{":
            return self.group()
        token = self.peek()
        if _DIGITS.fullmatch(token):  # \frac12 takes one digit and leaves the other
            self.tokens[self.at:self.at + 1] = [token[0], token[1:]]
        return self.atom()

    def atom(self) -> Tree:
        token = self.take()
        if _DIGIT.match(token):
            if len(token) * 3 > BITS:
                raise Unreadable(token)
            return ("num", Fraction(int(token) if token.isdecimal() else token))
        if token in ("(", "{", "["):
            tree = self.sum()
            self.take({"(": ")", "{": "}", "[": "]"}[token])
            return tree
        if token == "|":
            tree = self.sum()
            self.take("|")
            return ("fn", "abs", tree)
        if token == r"\frac":
            return ("div", self.argument(), self.argument())
        if token == r"\pi":
            return ("pi",)
        if token[0] == "\\" and token[1:] in FUNCTIONS:
            return self.function(token[1:])
        if _LETTER.fullmatch(token) or token[1:] in GREEK:
            name = token.lstrip("\\")
            if self.peek() == "_":
                self.take()
                inner = self.take()
                if inner == "{":
                    inner = ""
                    while self.peek() != "}":
                        inner += self.take()
                    self.take("}")
                name += f"_{inner}"
            return ("sym", name)
        raise Unreadable(token)

    def simple_product(self) -> Tree:
        """What a function takes without brackets: numbers, names and powers of them side by side, as in ``sin 2x``."""
        tree = self.power()
        while _NAMED.fullmatch(self.peek()) or self.peek()[1:] in GREEK:
            tree = ("mul", tree, self.power())
        return tree

    def function(self, name: str) -> Tree:
        power = base = None
        if name == "sqrt" and self.peek() == "[":
            self.take("[")
            root = self.sum()
            self.take("]")
            return ("pow", self.argument(), ("div", ("num", Fraction(1)), root))
        if name == "log" and self.peek() == "_":
            self.take()
            base = self.argument()
        if self.peek() == "^":
            self.take()
            power = self.argument()
        inner = self.argument() if name == "sqrt" or self.peek() in ("{", "(") else self.simple_product()
        tree: Tree = ("fn", name, inner)
        if base is not None:
            tree = ("div", tree, ("fn", name, base))
        return tree if power is None else ("pow", tree, power)


def read(text: str) -> Tree | None:
    """The tree of a formula, or None."""
    try:
        return Reader(text).whole()
    except (Unreadable, RecursionError):
        return None


def symbols(tree: Tree) -> set[str]:
    if tree[0] == "sym":
        return {tree[1]}
    return set().union(*[symbols(x) for x in tree[1:] if isinstance(x, tuple)], set())


# ------------------------------------------------------------------ values

def value(tree: Tree, at: dict[str, complex]) -> complex:
    """Value of a tree where each symbol has the value given; raises ArithmeticError or ValueError outside its domain."""
    kind = tree[0]
    if kind == "num":
        return tree[1].numerator / tree[1].denominator
    if kind == "pi":
        return math.pi
    if kind == "sym":
        return at[tree[1]]
    if kind == "fn":
        return FUNCTIONS[tree[1]](value(tree[2], at))
    parts = [value(x, at) for x in tree[1:]]
    if kind == "neg":
        return -parts[0]
    if kind == "add":
        return sum(parts)
    if kind == "mul":
        return parts[0] * parts[1]
    if kind == "div":
        return parts[0] / parts[1]
    return complex(parts[0]) ** parts[1] if isinstance(parts[0], complex) or (parts[0] < 0 and parts[1] != int(parts[1].real)) else parts[0] ** parts[1]


def constant(tree: Tree) -> float | None:
    """Real value of a formula without symbols; None for another or one without a finite real value."""
    if symbols(tree):
        return None
    try:
        v = complex(value(tree, {}))
    except (ArithmeticError, ValueError, TypeError):
        return None
    if abs(v.imag) > 1e-12 * max(1.0, abs(v.real)) or not math.isfinite(v.real):
        return None
    return v.real


# ------------------------------------------------------------------ polynomials

Poly = dict  # exponents by symbol, sorted, as a tuple of pairs -> coefficient


def _times(a: Poly, b: Poly) -> Poly | None:
    if len(a) * len(b) > TERMS * 10:
        return None
    out: Poly = {}
    for m, x in a.items():
        for n, y in b.items():
            powers = dict(m)
            for s, p in n:
                powers[s] = powers.get(s, 0) + p
            key = tuple(sorted(powers.items()))
            out[key] = out.get(key, 0) + x * y
    out = {k: v for k, v in out.items() if v}
    large = any(max(v.numerator.bit_length(), v.denominator.bit_length()) > BITS for v in out.values())
    return None if large or len(out) > TERMS else out


def polynomial(tree: Tree) -> Poly | None:
    """Coefficients with exact fractions, or None where the formula is no polynomial with fractions as coefficients."""
    kind = tree[0]
    if kind == "num":
        return {(): tree[1]} if tree[1] else {}
    if kind == "sym":
        return {((tree[1], 1),): Fraction(1)}
    if kind in ("pi", "fn"):
        return None
    parts = [polynomial(x) for x in tree[1:]]
    if any(p is None for p in parts):
        return None
    if kind == "neg":
        return {k: -v for k, v in parts[0].items()}
    if kind == "add":
        out: Poly = {}
        for p in parts:
            for k, v in p.items():
                out[k] = out.get(k, 0) + v
        return {k: v for k, v in out.items() if v}
    if kind == "mul":
        return _times(*parts)
    exponent = parts[1].get((), Fraction(0)) if set(parts[1]) <= {()} else None
    if kind == "div":
        return {k: v / exponent for k, v in parts[0].items()} if exponent else None
    if exponent is None or exponent.denominator != 1 or not 0 <= exponent <= 64:
        return None
    out = {(): Fraction(1)}
    for _ in range(int(exponent)):
        out = _times(out, parts[0])
        if out is None:
            return None
    return out


def ratio(a: Poly, b: Poly) -> Fraction | None:
    """The number c with a = c * b, if there is one."""
    if not a or set(a) != set(b):
        return None
    found = {v / b[k] for k, v in a.items()}
    return found.pop() if len(found) == 1 else None


# ------------------------------------------------------------------ comparison

def _points(names: list[str], count: int = 6) -> list[dict[str, float]]:
    """Fixed, irregular positive places, so that repeated runs decide alike."""
    return [{s: 0.31 + ((k + 1) * 0.7548776662466927 + (j + 1) * 0.5698402909980532) % 1.0 * 2.1 for j, s in enumerate(names)} for k in range(count)]


def probe(a: Tree, b: Tree) -> tuple[bool | None, float | None]:
    """Whether two formulas agree at all places where both have a value, and the ratio of their values if it is fixed."""
    names = sorted(symbols(a) | symbols(b))
    seen = []
    for place in _points(names):
        try:
            x, y = complex(value(a, place)), complex(value(b, place))
        except (ArithmeticError, ValueError, TypeError):
            continue
        if cmath.isfinite(x) and cmath.isfinite(y):
            seen.append((x, y))
    if len(seen) < 3:
        return None, None
    same = all(abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y)) for x, y in seen)
    quotients = [x / y for x, y in seen if abs(y) > 1e-9]
    fixed = len(quotients) == len(seen) and all(abs(q - quotients[0]) <= 1e-9 * max(1.0, abs(q)) for q in quotients)
    return same, quotients[0].real if fixed and abs(quotients[0].imag) < 1e-9 else None


def equal_formulas(a: str, b: str, close: Callable[[float, float], bool]) -> bool | None:
    """Two formulas: numbers by ``close``, polynomials by their coefficients, others by probing; None if unreadable.

    A formula with symbols and one without are equal only if the symbols cancel out.
    """
    left, right = read(a), read(b)
    if left is None or right is None:
        return None
    if not symbols(left) and not symbols(right):
        x, y = constant(left), constant(right)
        return None if x is None or y is None else close(x, y)
    p, q = polynomial(left), polynomial(right)
    if p is not None and q is not None:
        return p == q
    if "infty" in symbols(left) | symbols(right):
        return True if left == right else None if symbols(left) == symbols(right) else False
    return probe(left, right)[0]


def equal_equations(a: str, b: str, fits: Callable[[float], bool]) -> bool | None:
    """Two equations: all brought to one side, one is a constant times the other, and the constant ``fits``."""
    sides = [[read(part) for part in text.split("=")] for text in (a, b)]
    if any(len(s) != 2 or None in s for s in sides):
        return None
    left, right = (("add", s[0], ("neg", s[1])) for s in sides)
    p, q = polynomial(left), polynomial(right)
    if p is not None and q is not None:
        if not p or not q:
            return not p and not q
        c = ratio(p, q)
        return c is not None and fits(float(c))
    same, c = probe(left, right)
    return None if same is None else c is not None and fits(c)
