"""MurmurHash3 (x64-128 and x86-32) as SQL (DuckDB), to check the vectorised one: from wider numbers, a step at a time."""

from __future__ import annotations

_MASK = "18446744073709551615::UHUGEINT"
# The multipliers of the hash.
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
_F1, _F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def times(x: str, factor: int) -> str:
    return f"(({x}) * {factor}::UHUGEINT & {_MASK})"


def plus(x: str, y: str) -> str:
    return f"((({x}) + ({y})) & {_MASK})"


def turn(column: str, bits: int) -> str:
    return f"((({column} << {bits}) | ({column} >> {64 - bits})) & {_MASK})"


def _lane(at: str) -> str:
    """The 8 bytes of the padded hex text from lane `at`, the lowest first."""
    pairs = " || ".join(f"substr(hx, ({at}) * 16 + {2 * k + 1}, 2)" for k in range(7, -1, -1))
    return f"('0x' || {pairs})::UBIGINT::UHUGEINT"


def then(columns: str, source: str) -> str:
    return f"(SELECT {columns} FROM {source})"


def _mixed_in(source: str, words: bool) -> str:
    """source: rows of (id, hx, n, b, h1, h2). Lanes 2b and 2b + 1 are mixed in; with the sums of a whole block, where words."""
    at = then(f"id, hx, n, b, h1, h2, {times(_lane('b * 2'), _C1)} AS k1, {times(_lane('b * 2 + 1'), _C2)} AS k2", source)
    at = then(f"id, hx, n, b, h1, h2, {turn('k1', 31)} AS k1, {turn('k2', 33)} AS k2", at)
    at = then(f"id, hx, n, b, h2, xor(h1, {times('k1', _C2)}) AS h1, {times('k2', _C1)} AS k2", at)
    if not words:
        return then("id, hx, n, b, h1, xor(h2, k2) AS h2", at)
    at = then(f"id, hx, n, b, h2, k2, {plus(times(plus(turn('h1', 27), 'h2'), 5), str(0x52DCE729))} AS h1", at)
    at = then("id, hx, n, b, h1, xor(h2, k2) AS h2", at)
    return then(f"id, hx, n, b, h1, {plus(times(plus(turn('h2', 31), 'h1'), 5), str(0x38495AB5))} AS h2", at)


def _avalanche(source: str) -> str:
    for factor in (_F1, _F2):
        source = then(f"id, {times('xor(h1, h1 >> 33)', factor)} AS h1, {times('xor(h2, h2 >> 33)', factor)} AS h2", source)
    return then("id, xor(h1, h1 >> 33) AS h1, xor(h2, h2 >> 33) AS h2", source)


def _sums(source: str) -> str:
    return then(f"id, h1, {plus('h1', 'h2')} AS h2", then(f"id, {plus('h1', 'h2')} AS h1, h2", source))


def murmur3_128(items: str, seed: int = 42) -> str:
    """items: SQL of rows (id, item), item text. A query of (id, h1, h2), unsigned."""
    raw = then("id, hex(encode(item)) AS hx, octet_length(encode(item)) AS n", f"({items})")
    begun = then(f"id, rpad(hx, ((n // 16 + 1) * 32)::INTEGER, '0') AS hx, n, 0::BIGINT AS b, {seed}::UHUGEINT AS h1, {seed}::UHUGEINT AS h2", raw)
    step = then("id, hx, n, b + 1, h1, h2", _mixed_in("(SELECT * FROM blocks WHERE b < n // 16)", True))
    tail = _mixed_in("(SELECT * FROM blocks WHERE b = n // 16)", False)  # lanes of zeros change nothing
    ended = then("id, xor(h1, n::UHUGEINT) AS h1, xor(h2, n::UHUGEINT) AS h2", tail)
    return f"(WITH RECURSIVE blocks AS (SELECT * FROM {begun} UNION ALL {step[1:-1]}) SELECT * FROM {_sums(_avalanche(_sums(ended)))})"


# The multipliers of the 32-bit hash.
_D1, _D2 = 0xCC9E2D51, 0x1B873593
_G1, _G2 = 0x85EBCA6B, 0xC2B2AE35
_LOW = "4294967295::UBIGINT"


def times32(x: str, factor: int) -> str:
    return f"((({x})::UHUGEINT * {factor}::UHUGEINT & 4294967295::UHUGEINT)::UBIGINT)"


def turn32(column: str, bits: int) -> str:
    return f"((({column} << {bits}) | ({column} >> {32 - bits})) & {_LOW})"


def murmur3_32(items: str, seed: int = 0) -> str:
    """items: SQL of rows (id, item), item text. A query of (id, route), the signed 32-bit hash."""
    raw = then("id, hex(encode(item)) AS hx, octet_length(encode(item)) AS n", f"({items})")
    begun = then(f"id, rpad(hx, ((n // 4 + 1) * 8)::INTEGER, '0') AS hx, n, 0::BIGINT AS b, {seed}::UBIGINT AS h", raw)
    pairs = " || ".join(f"substr(hx, b * 8 + {2 * k + 1}, 2)" for k in range(3, -1, -1))

    def mixed_in(source: str, whole: bool) -> str:
        at = then(f"id, hx, n, b, h, {times32(f"('0x' || {pairs})::UBIGINT", _D1)} AS k", source)
        at = then(f"id, hx, n, b, h, {turn32('k', 15)} AS k", at)
        at = then(f"id, hx, n, b, xor(h, {times32('k', _D2)}) AS h", at)
        return then(f"id, hx, n, b, ({times32(turn32('h', 13), 5)} + {0xE6546B64}) & {_LOW} AS h", at) if whole else at

    step = then("id, hx, n, b + 1, h", mixed_in("(SELECT * FROM words WHERE b < n // 4)", True))
    at = then("id, xor(h, n::UBIGINT) AS h", mixed_in("(SELECT * FROM words WHERE b = n // 4)", False))
    at = then(f"id, {times32('xor(h, h >> 16)', _G1)} AS h", at)
    at = then(f"id, {times32('xor(h, h >> 13)', _G2)} AS h", at)
    at = then("id, xor(h, h >> 16)::BIGINT AS h", at)
    ended = then("id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS route", at)
    return f"(WITH RECURSIVE words AS (SELECT * FROM {begun} UNION ALL {step[1:-1]}) SELECT * FROM {ended})"
