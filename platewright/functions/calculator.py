"""Colour functions as column expressions: calculator programs in postfix form, and tables of samples.

A program is turned into expressions once, on the driver: its stack holds columns, and both branches of
a condition are worked out and chosen between row by row.  So a program costs what its expressions
cost, and rows never carry a stack.  What would need another stack in each row, branches that leave
stacks of different heights or counts that depend on the row, is refused.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class ProgramError(ValueError):
    """A program that has no value: a word it does not know, too few values, unlike branches."""


def _whole(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _shift(a: Column, b: Column) -> Column:
    to = lambda name, by: F.call_function(name, _whole(a), by.cast("int"))
    return F.when(b >= 0, to("shiftleft", b)).otherwise(to("shiftright", -b))


def _parted(a: Column, b: Column) -> Column:
    """Whole quotient, rounded down; 0 where there is none."""
    return F.coalesce(F.floor(_whole(a) / F.nullif(_whole(b), F.lit(0).cast("long"))), F.lit(0).cast("long"))


#: One value taken, one put.
ONE: dict[str, Callable[[Column], Column]] = {
    "neg": lambda a: -a,
    "abs": F.abs,
    "ceiling": F.ceil,
    "floor": F.floor,
    "round": lambda a: F.floor(a + 0.5),
    "truncate": _whole,
    "cvi": _whole,
    "cvr": lambda a: a,
    "sqrt": lambda a: F.sqrt(F.greatest(a, F.lit(0.0))),
    "sin": lambda a: F.sin(F.radians(a)),
    "cos": lambda a: F.cos(F.radians(a)),
    "ln": lambda a: F.log(F.greatest(a, F.lit(1e-12))),
    "log": lambda a: F.log10(F.greatest(a, F.lit(1e-12))),
    "not": lambda a: F.when((a == 0) | (a == 1), 1 - a).otherwise(-_whole(a) - 1),
}
#: Two values taken, one put.
TWO: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0)),
    "idiv": _parted,
    "mod": lambda a, b: F.when(_whole(b) == 0, 0).otherwise(_whole(a) - _whole(b) * _parted(a, b)),
    "exp": F.pow,
    "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)),
    "eq": lambda a, b: _flag(a == b),
    "ne": lambda a, b: _flag(a != b),
    "gt": lambda a, b: _flag(a > b),
    "ge": lambda a, b: _flag(a >= b),
    "lt": lambda a, b: _flag(a < b),
    "le": lambda a, b: _flag(a <= b),
    "and": lambda a, b: _whole(a).bitwiseAND(_whole(b)),
    "or": lambda a, b: _whole(a).bitwiseOR(_whole(b)),
    "xor": lambda a, b: _whole(a).bitwiseXOR(_whole(b)),
    "bitshift": _shift,
}

#: A value of the stack: its column, and its number where the program says it.
Value = tuple[Column, float | None]


def _number(v: float) -> Value:
    return F.lit(float(v)), float(v)


def _blocks(words: list[str]) -> list:
    """Words with what stands in braces as lists."""
    open_: list[list] = [[]]
    for w in words:
        if w == "{":
            open_.append([])
        elif w != "}":
            open_[-1].append(w)
        elif len(open_) > 1:
            done = open_.pop()
            open_[-1].append(done)
        else:
            raise ProgramError("a brace is closed that was not opened")
    if len(open_) > 1:
        raise ProgramError("a brace is not closed")
    return open_[0]


class Compiler:
    """The stack of a program under way."""

    def __init__(self, stack: list[Value]):
        self.stack = stack

    def take(self, n: int) -> list[Value]:
        if n < 0 or len(self.stack) < n:
            raise ProgramError("too few values")
        taken, self.stack = self.stack[len(self.stack) - n :], self.stack[: len(self.stack) - n]
        return taken

    def count(self) -> int:
        ((_, number),) = self.take(1)
        if number is None:
            raise ProgramError("copy, index and roll need numbers of the program itself")
        return int(number)

    def branch(self, then: list, other: list) -> None:
        ((test, _),) = self.take(1)
        one, two = Compiler(list(self.stack)), Compiler(list(self.stack))
        one.run(then)
        two.run(other)
        if len(one.stack) != len(two.stack):
            raise ProgramError("branches leave stacks of different heights")
        self.stack = [a if a is b else (F.when(test != 0, a[0]).otherwise(b[0]), a[1] if a[1] == b[1] else None) for a, b in zip(one.stack, two.stack, strict=True)]

    def word(self, w: str) -> None:
        if w in ONE:
            ((a, _),) = self.take(1)
            self.stack.append((ONE[w](a).cast("double"), None))
        elif w in TWO:
            (a, _), (b, _) = self.take(2)
            self.stack.append((TWO[w](a, b).cast("double"), None))
        elif w in ("true", "false"):
            self.stack.append(_number(w == "true"))
        elif w == "pop":
            self.take(1)
        elif w == "dup":
            (a,) = self.take(1)
            self.stack += [a, a]
        elif w == "exch":
            a, b = self.take(2)
            self.stack += [b, a]
        elif w == "copy":
            n = max(self.count(), 0)
            taken = self.take(n)
            self.stack += taken + taken
        elif w == "index":
            taken = self.take(self.count() + 1)
            self.stack += [*taken, taken[0]]
        elif w == "roll":
            by, n = self.count(), self.count()
            taken = self.take(max(n, 0))
            cut = len(taken) - by % n if n > 0 else 0
            self.stack += taken[cut:] + taken[:cut]
        else:
            try:
                self.stack.append(_number(float(w)))
            except ValueError:
                raise ProgramError(f"no word of calculator programs: {w}") from None

    def run(self, program: list) -> None:
        waiting: list[list] = []
        for w in program:
            if isinstance(w, list):
                waiting.append(w)
            elif w == "if" and len(waiting) == 1:
                self.branch(waiting.pop(), [])
            elif w == "ifelse" and len(waiting) == 2:
                then, other = waiting
                waiting = []
                self.branch(then, other)
            elif waiting:
                raise ProgramError("braces without if or ifelse")
            else:
                self.word(w)
        if waiting:
            raise ProgramError("braces without if or ifelse")


def held(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def calculated(program: str, inputs: list[Column], domain: list[tuple[float, float]], range_: list[tuple[float, float]]) -> list[Column]:
    """The program's last values, as many as `range_` has, held in it; the inputs are held in `domain`."""
    words = _blocks(program.replace("{", " { ").replace("}", " } ").split())
    if len(words) == 1 and isinstance(words[0], list):
        words = words[0]
    run = Compiler([(held(x.cast("double"), *d), None) for x, d in zip(inputs, domain, strict=True)])
    run.run(words)
    if len(run.stack) < len(range_):
        raise ProgramError("fewer values than the range asks for")
    return [held(v, *r) for (v, _), r in zip(run.stack[len(run.stack) - len(range_) :], range_, strict=True)]


def tabulated(samples: Column, inputs: list[Column], sizes: list[int], domain: list[tuple[float, float]], range_: list[tuple[float, float]], encode: list[tuple[float, float]] | None = None, decode: list[tuple[float, float]] | None = None, most: float = 255.0) -> list[Column]:
    """Interpolation in a table of samples (an array, the first input varies fastest, outputs together): each of the 2^n corners by its share.

    Samples of 0 to `most` stand for `decode`, the range if nothing else is said.
    """
    encode, decode, outputs = encode or [(0.0, n - 1.0) for n in sizes], decode or range_, len(range_)
    places, shares = [], []
    for x, n, (d0, d1), (e0, e1), in zip(inputs, sizes, domain, encode, strict=True):
        at = held(e0 + (held(x.cast("double"), d0, d1) - d0) * (e1 - e0) / ((d1 - d0) or 1.0), 0, n - 1)
        places.append(F.floor(at).cast("int"))
        shares.append(at - F.floor(at))
    strides = [math.prod(sizes[:i]) for i in range(len(sizes))]
    corners = []
    for corner in itertools.product((0, 1), repeat=len(sizes)):
        weight, index = F.lit(1.0), F.lit(0)
        for up, low, share, n, stride in zip(corner, places, shares, sizes, strides, strict=True):
            weight = weight * (share if up else 1 - share)
            index = index + F.least(low + up, F.lit(n - 1)) * stride
        corners.append((weight, index))
    mean = lambda k: sum((w * F.get(samples, i * outputs + k) for w, i in corners), F.lit(0.0))
    return [held(d0 + mean(k) * (d1 - d0) / most, *r) for k, ((d0, d1), r) in enumerate(zip(decode, range_, strict=True))]
