"""Channel expressions: linear combinations of signals, planned on the driver and run as columns.

    C3-A2          a label, or else the difference of two
    0.5*(C3 + C4) - mean(A1, A2)
    $EEG C3-A2$    a label as it stands

Brackets [ ] are parentheses. A product of signals, a division by a signal or by 0, and a number added to a signal are
errors. mean() keeps the arguments whose signals a recording has; it is an error if there are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|\$(?P<literal>[^$]+)\$|(?P<name>[A-Za-z_][\w.:]*)|(?P<mark>[-+*/(),\[\]]))")


class ExpressionError(ValueError):
    pass


@dataclass
class Linear:
    """A number plus weighted signals plus weighted means of such sums."""

    number: float = 0.0
    terms: list[tuple[float, str | tuple[Linear, ...]]] = field(default_factory=list)

    def scaled(self, k: float) -> Linear:
        return Linear(self.number * k, [(c * k, x) for c, x in self.terms])

    def plus(self, other: Linear) -> Linear:
        return Linear(self.number + other.number, self.terms + other.terms)

    def labels(self) -> list[str]:
        found = (([x] if isinstance(x, str) else [y for part in x for y in part.labels()]) for _, x in self.terms)
        return list(dict.fromkeys(y for part in found for y in part))


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:1]!r} at {at}")
        kind = m.lastgroup
        out.append((kind, {"[": "(", "]": ")"}.get(m[kind], m[kind])))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.todo = [*tokens(text), ("end", "")]

    def take(self, *marks: str) -> str | None:
        if self.todo[0][0] == "mark" and self.todo[0][1] in marks:
            return self.todo.pop(0)[1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise ExpressionError(f"{mark!r} expected before {self.todo[0][1] or 'the end'!r}")

    def sum(self) -> Linear:
        out = self.product()
        while sign := self.take("+", "-"):
            out = out.plus(self.product().scaled(1.0 if sign == "+" else -1.0))
        return out

    def product(self) -> Linear:
        out = self.factor()
        while sign := self.take("*", "/"):
            other = self.factor()
            if sign == "/":
                if other.terms or other.number == 0:
                    raise ExpressionError("division by a signal or by 0")
                out = out.scaled(1 / other.number)
            elif out.terms and other.terms:
                raise ExpressionError("product of signals")
            else:
                a, b = (out, other) if not other.terms else (other, out)
                out = a.scaled(b.number)
        return out

    def factor(self) -> Linear:
        if sign := self.take("+", "-"):
            return self.factor().scaled(1.0 if sign == "+" else -1.0)
        if self.take("("):
            out = self.sum()
            self.need(")")
            return out
        kind, value = self.todo.pop(0)
        if kind == "number":
            return Linear(float(value))
        if kind == "literal":
            return Linear(0.0, [(1.0, value.strip())])
        if kind != "name":
            raise ExpressionError(f"a signal or number expected at {value or 'the end'!r}")
        if value.lower() == "mean" and self.take("("):
            parts = [self.sum()]
            while self.take(","):
                parts.append(self.sum())
            self.need(")")
            if all(not p.terms for p in parts):
                return Linear(sum(p.number for p in parts) / len(parts))
            return Linear(0.0, [(1.0, tuple(parts))])
        return Linear(0.0, [(1.0, value)])


def parse(text: str) -> Linear:
    p = _Parser(text)
    out = p.sum()
    if p.todo[0][0] != "end":
        raise ExpressionError(f"unexpected {p.todo[0][1]!r}")
    if out.terms and out.number:
        raise ExpressionError("a number cannot be added to a signal")
    return out


def _key(label: str) -> str:
    return label.strip().lower()


def flatten(expr: Linear, available: Iterable[str], named: dict[str, Linear | str] | None = None) -> dict[str, float]:
    """Weight of each available label, names put in and means taken over what is there; weights of 0 go. A name's text is
    parsed when it is met, so a bad one that is not used is no error."""
    have = {}
    for label in available:
        have.setdefault(_key(label), label)
    named = {_key(k): v for k, v in (named or {}).items()}

    def solve(x: Linear, open_: tuple[str, ...]) -> dict[str, float]:
        out: dict[str, float] = {}
        for c, what in x.terms:
            if isinstance(what, tuple):
                parts = []
                for part in what:
                    try:
                        parts.append(solve(part, open_))
                    except LookupError:
                        continue
                if not parts:
                    raise LookupError("no argument of mean() is there")
                found = [(k, v / len(parts)) for p in parts for k, v in p.items()]
            elif _key(what) in named:
                if _key(what) in open_:
                    raise ExpressionError("references form a cycle: " + " -> ".join((*open_, _key(what))))
                value = named[_key(what)]
                found = solve(parse(value) if isinstance(value, str) else value, (*open_, _key(what))).items()
            elif _key(what) in have:
                found = [(have[_key(what)], 1.0)]
            else:
                raise LookupError(f"no signal {what!r}")
            for k, v in found:
                out[k] = out.get(k, 0.0) + c * v
        return out

    return {k: v for k, v in solve(expr, ()).items() if v}


def select(text: str, available: Iterable[str], named: dict[str, str] | None = None) -> dict[str, float]:
    """Weights for what the user wrote: a label as it stands, a difference of two labels, or an expression."""
    available = list(available)
    for label in available:
        if _key(label) == _key(text):
            return {label: 1.0}
    have = {_key(x): x for x in reversed(available)}
    for m in re.finditer("-", text):
        a, b = _key(text[: m.start()]), _key(text[m.end() :])
        if a in have and b in have:
            return {have[a]: 1.0, have[b]: -1.0}
    return flatten(parse(text), available, named)


def references(lines: Iterable[str]) -> dict[str, str]:
    """NAME = expression, one a line; blank lines and what follows # are left out. A name twice is an error."""
    out: dict[str, str] = {}
    for line in lines:
        text = line.split("#", 1)[0].strip()
        if not text:
            continue
        name, mark, value = text.partition("=")
        if not mark or not name.strip() or not value.strip():
            raise ExpressionError(f"not NAME = expression: {line!r}")
        if _key(name) in map(_key, out):
            raise ExpressionError(f"{name.strip()!r} is given twice")
        out[name.strip()] = value.strip()
    return out


def satisfied(text: str, available: Iterable[str], named: dict[str, str] | None = None) -> bool:
    """Can the expression be taken from these labels? Bad syntax is an error, a missing signal is not."""
    try:
        select(text, available, named)
    except LookupError:
        return False
    return True


def needed(texts: Iterable[str], available: Iterable[str], named: dict[str, str] | None = None) -> list[str]:
    """The labels that the expressions read, each once, for a reader that can leave out the others."""
    available = list(available)
    return list(dict.fromkeys(label for t in texts for label in select(t, available, named)))


def read_channel(spark, path, text: str, named: dict[str, str] | None = None, chunk_seconds: float = 300.0) -> DataFrame:
    """(path, t0, fs, x): the expression over each recording of EDF files, of which only the needed channels are decoded.
    Recordings that lack a signal of it have no rows."""
    from ..sources.edf import read_edf, read_headers

    heads = read_headers(spark, path).where("error IS NULL").groupBy("path").agg(F.collect_list("ch").alias("have")).collect()  # one row a file
    plans = {r["path"]: select(text, r["have"], named) for r in heads if satisfied(text, r["have"], named)}
    parts = [(p, label, w) for p, plan in plans.items() for label, w in plan.items()]
    weights = spark.createDataFrame(parts, "path string, ch string, w double")
    count = weights.groupBy("path").agg(F.count("*").alias("_k"))
    chunks = read_edf(spark, path, sorted({label for _, label, _ in parts}), chunk_seconds, skip_bad=True)
    scaled = chunks.join(F.broadcast(weights), ["path", "ch"]).select("path", "t0", "fs", F.transform("x", lambda v: v * F.col("w")).alias("x"))
    rows = scaled.select("path", "t0", "fs", F.posexplode("x").alias("i", "v")).groupBy("path", "t0", "fs", "i").agg(F.sum("v").alias("v"), F.count("*").alias("_n"))
    rows = rows.join(F.broadcast(count), "path").where("_n = _k")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda z: z["v"])
    return rows.groupBy("path", "t0", "fs").agg(ordered.alias("x"))


def evaluate(samples: DataFrame, weights: dict[str, float], by: list[str], channel: str = "ch", value: str = "x", name: str = "x") -> DataFrame:
    """Long samples (by, channel, value) -> (by, name): only the channels of the combination are read. A sample that
    any of them lacks is NULL."""
    w: Column = reduce(lambda a, kv: a.when(F.col(channel) == kv[0], F.lit(kv[1])), list(weights.items())[1:], F.when(F.col(channel) == next(iter(weights)), F.lit(next(iter(weights.values())))))
    rows = samples.where(F.col(channel).isin(list(weights))).groupBy(*by).agg(F.sum(F.col(value) * w).alias(name), F.count(value).alias("_n"))
    return rows.withColumn(name, F.when(F.col("_n") == len(weights), F.col(name))).drop("_n")
