"""The text form (songlen,bit_rate,num_errors,<696 hex>,<132 hex>,<signed ints by spaces>): format and strict parse."""

from __future__ import annotations

from .scores import signed

#: The words are tested one by one: a pattern over all of them would need a stack as deep as the print is long.
PATTERN = r"^\\((\\d+),(\\d+),(\\d+),([0-9A-Fa-f]{696}),([0-9A-Fa-f]{132}),([-0-9 ]*)\\)$"
WORD = r"^-?\\d{1,10}$"


def text_of(fp: str) -> str:
    r = f"array_join(transform({fp}.r32, w -> lpad(hex(w), 8, '0')), '')"
    dom = f"array_join(transform({fp}.dom16, w -> lpad(hex(w), 4, '0')), '')"
    ints = f"array_join(transform({fp}.cprint, x -> CAST({signed('x')} AS STRING)), ' ')"
    return f"concat('(', {fp}.songlen, ',', {fp}.bit_rate, ',', {fp}.num_errors, ',', {r}, ',', {dom}, ',', {ints}, ')')"


def parsed(text: str) -> str:
    """Struct of a literal; an error for anything else, NULL for NULL. The text is matched once and cut once."""
    words = lambda k, n, d: f"transform(sequence(0, {n - 1}), i -> CAST(conv(substr(f[{k}], {d} * i + 1, {d}), 16, 10) AS BIGINT))"
    tokens = "IF(f[5] = '', CAST(array() AS ARRAY<STRING>), split(f[5], ' '))"
    ints = "transform(ts, t -> IF(CAST(t AS BIGINT) < 0, CAST(t AS BIGINT) + 4294967296L, CAST(t AS BIGINT)))"
    made = f"named_struct('songlen', CAST(f[0] AS BIGINT), 'bit_rate', CAST(f[1] AS BIGINT), 'num_errors', CAST(f[2] AS BIGINT), 'r32', {words(3, 87, 8)}, 'dom16', {words(4, 33, 4)}, 'cprint', {ints})"
    whole = f"transform(array({tokens}), ts -> IF(forall(ts, t -> t RLIKE '{WORD}'), {made}, raise_error('not a fingerprint literal')))[0]"
    cut = f"transform(array(split(substr({text}, 2, length({text}) - 2), ',')), f -> {whole})[0]"
    return f"CASE WHEN {text} IS NULL THEN NULL WHEN {text} RLIKE '{PATTERN}' THEN {cut} ELSE raise_error('not a fingerprint literal') END"
