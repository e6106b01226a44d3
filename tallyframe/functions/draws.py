"""Random numbers that any engine can repeat: a permutation of 0..MODULUS-1 for each (seed, replicate).

Whole-number arithmetic only, below 2^63: fifth powers modulo a prime whose predecessor 5 does not divide are a
permutation, and so are the steps between them. Numbers of different places never tie.
"""

from __future__ import annotations

import numpy as np

from tallyframe.session import ship

ship(__name__)

# Fixed values; the SQL twins use the same.
MODULUS = 2147483647
SPREAD, TURN = 48271, 69621
SEEDS, REPLICATES = 1000003, 7919


def fifth(x: np.ndarray | int) -> np.ndarray | int:
    square = x * x % MODULUS
    return square * square % MODULUS * x % MODULUS


def drawn(seed: int, rep: int, places: np.ndarray) -> np.ndarray:
    """The number of each place in a replicate; all different for different places below MODULUS."""
    first = fifth((seed * SEEDS + rep * REPLICATES + 1) % MODULUS)
    second = fifth((first + rep + 1) % MODULUS)
    return fifth((fifth((places.astype(np.int64) * SPREAD + first) % MODULUS) * TURN + second) % MODULUS)


def sql_fifth(x: str) -> str:
    return f"((({x} * {x} % {MODULUS}) * ({x} * {x} % {MODULUS}) % {MODULUS}) * {x} % {MODULUS})"


def sql_drawn(name: str, source: str, place: str, seed: int, reps: int, columns: str) -> str:
    """CTE ``name`` (rep, columns, draw): a number per replicate and row of ``source``, whose ``place`` counts from 0."""
    return f"""
{name}_r AS (SELECT rep, first, {sql_fifth('second')} AS second FROM (SELECT rep, first, (first + rep + 1) % {MODULUS} AS second
  FROM (SELECT rep, {sql_fifth('x')} AS first FROM (SELECT range AS rep, ({seed * SEEDS} + range * {REPLICATES} + 1) % {MODULUS} AS x FROM range({reps}))))),
{name} AS (SELECT rep, {columns}, {sql_fifth('y')} AS draw FROM (SELECT rep, {columns}, ({sql_fifth('x')} * {TURN} + second) % {MODULUS} AS y
  FROM (SELECT rep, {columns}, second, ({place}::BIGINT * {SPREAD} + first) % {MODULUS} AS x FROM {source}, {name}_r)))"""
