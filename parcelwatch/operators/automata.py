"""Finite automata over texts in parts: what a part does to every state, and the state each part starts in.

A part is read where it lies and leaves its effect, one state for each state it may start in.  Effects
are a few bytes each; following them in order gives the state at the start of every part, as if one
reader had gone through the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIRST_LETTER = ord("A")
_BLOCK = 1 << 16


@dataclass(frozen=True)
class Automaton:
    """``moves[state]`` has the next state for each of ``symbols`` and, last, for any other character.

    Two other characters in a row must lead where one does.  State 0 is the start.
    """

    symbols: str
    moves: tuple[tuple[int, ...], ...]


def _classes(automaton: Automaton, text: str) -> np.ndarray:
    """Number of the symbol of every character, runs of other characters as one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    other = len(automaton.symbols)
    found = np.full(len(points), other, dtype=np.uint8)
    for i, symbol in enumerate(automaton.symbols):
        found[points == ord(symbol)] = i
    repeated = (found[1:] == other) & (found[:-1] == other)
    return found[np.concatenate([[True], ~repeated])] if len(found) else found


def _composed(automaton: Automaton, text: str) -> str:
    """The state after ``text`` for each state before it, as letters."""
    steps = np.array(automaton.moves, dtype=np.uint8).T
    whole = np.arange(len(automaton.moves), dtype=np.uint8)
    classes = _classes(automaton, text)
    for at in range(0, len(classes), _BLOCK):
        effects = steps[classes[at : at + _BLOCK]]
        while len(effects) > 1:
            odd = effects[-1:] if len(effects) % 2 else effects[:0]
            pairs = np.take_along_axis(effects[1::2], effects[0 : len(effects) - len(odd) : 2], axis=1)
            effects = np.concatenate([pairs, odd])
        whole = effects[0][whole]
    return (whole + _FIRST_LETTER).tobytes().decode("ascii")


def effect(automaton: Automaton, text: Column) -> Column:
    """A string with one letter per state: where ``text`` leads from there ('A' is state 0)."""

    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _composed(automaton, t))

    return F.pandas_udf(compose, T.StringType())(text)


def states_at(automaton: Automaton, mark: str, text: Column, entry: Column) -> Column:
    """The state behind each ``mark`` in ``text``, read from state ``entry``: one letter per mark."""
    tokens = re.compile(f"[{re.escape(automaton.symbols)}]|[^{re.escape(automaton.symbols)}]+")

    def read(texts: pd.Series, entries: pd.Series) -> pd.Series:
        index = {c: i for i, c in enumerate(automaton.symbols)}
        other, out = len(index), []
        for body, state in zip(texts, entries):
            seen = []
            for token in tokens.findall(body):
                state = automaton.moves[state][index.get(token, other)]
                if token == mark:
                    seen.append(chr(_FIRST_LETTER + state))
            out.append("".join(seen))
        return pd.Series(out, dtype="object")

    return F.pandas_udf(read, T.StringType())(text, entry)


def entries(effects: DataFrame, key: Sequence[str], part: str) -> DataFrame:
    """``effects(*key, part, effect, n)`` to ``*key, part, entry, before``.

    ``entry`` is the state a part starts in and ``before`` the sum of ``n`` over earlier parts of its key.
    One task follows the parts of a key, a row of some tens of bytes each: a cell holds 2 GB at most, so
    chunks of 64 KB are at most 32,768 rows.  Rows stream by; nothing is gathered.
    """
    names = [*key, part]
    schema = T.StructType(
        [effects.schema[n] for n in names]
        + [T.StructField("entry", T.IntegerType()), T.StructField("before", T.LongType())]
    )

    def follow(frames):
        last, state, total = None, 0, 0
        for frame in frames:
            starts, sums = [], []
            for row in zip(*[frame[k] for k in key], frame["effect"], frame["n"]):
                if row[:-2] != last:
                    last, state, total = row[:-2], 0, 0
                starts.append(state)
                sums.append(total)
                state, total = ord(row[-2][state]) - _FIRST_LETTER, total + row[-1]
            out = frame[names].copy()
            out["entry"], out["before"] = starts, sums
            yield out

    narrow = effects.select(*names, "effect", F.col("n").cast("bigint").alias("n"))
    dealt = narrow.repartition(*key).sortWithinPartitions(*names)
    return dealt.mapInPandas(follow, schema)
