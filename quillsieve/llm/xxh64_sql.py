"""XXH64 as SQL (DuckDB), to check fingerprints with: from numbers of 128 bits, a step at a time."""

from __future__ import annotations

from quillsieve.plans.murmur_sql import plus, then, times, turn

# The multipliers of the hash.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _number(at: str, size: int) -> str:
    """`size` bytes of the hex text from byte `at`, the lowest first."""
    pairs = " || ".join(f"substr(hx, (({at}) + {k}) * 2 + 1, 2)" for k in range(size - 1, -1, -1))
    return f"('0x' || {pairs})::UBIGINT::UHUGEINT"


def _mixed(source: str, names: list[str], keep: str) -> str:
    """Each of the names, a lane, becomes turn(lane * P2, 31) * P1."""
    at = then(keep + ", " + ", ".join(f"{times(x, _P2)} AS {x}" for x in names), source)
    at = then(keep + ", " + ", ".join(f"{turn(x, 31)} AS {x}" for x in names), at)
    return then(keep + ", " + ", ".join(f"{times(x, _P1)} AS {x}" for x in names), at)


def xxh64(items: str, seed: int = 42) -> str:
    """items: SQL of rows (id, item), item text. A query of (id, h), unsigned."""
    u = lambda x: f"{x % (1 << 64)}::UHUGEINT"
    v = ["v1", "v2", "v3", "v4"]
    begun = then(f"id, hex(encode(item)) AS hx, octet_length(encode(item)) AS n, 0::BIGINT AS pos, {u(seed + _P1 + _P2)} AS v1, {u(seed + _P2)} AS v2, {u(seed)} AS v3, {u(seed - _P1)} AS v4", f"({items})")
    # Stripes of 32 bytes.
    lanes = ", ".join(f"{plus(x, times(_number(f'pos + {8 * k}', 8), _P2))} AS {x}" for k, x in enumerate(v))
    at = then(f"id, hx, n, pos, {lanes}", "(SELECT * FROM stripes WHERE pos + 32 <= n)")
    at = then("id, hx, n, pos, " + ", ".join(f"{turn(x, 31)} AS {x}" for x in v), at)
    step = then("id, hx, n, pos + 32, " + ", ".join(f"{times(x, _P1)} AS {x}" for x in v), at)
    ended = then("*", "(SELECT * FROM stripes WHERE pos + 32 > n)")
    total = plus(plus(turn("v1", 1), turn("v2", 7)), plus(turn("v3", 12), turn("v4", 18)))
    merged = _mixed(then(f"id, hx, n, pos, {total} AS h, {', '.join(v)}", ended), v, "id, hx, n, pos, h")
    for x in v:
        merged = then(f"id, hx, n, pos, {plus(times(f'xor(h, {x})', _P1), u(_P4))} AS h, {', '.join(v)}", merged)
    first = then(f"id, hx, n, pos, {plus(f'CASE WHEN n >= 32 THEN h ELSE {u(seed + _P5)} END', 'n::UHUGEINT')} AS h", merged)
    # What is left: 8 bytes, 4 bytes or one at a time.
    kind = then("*, CASE WHEN n - pos >= 8 THEN 8 WHEN n - pos >= 4 THEN 4 ELSE 1 END AS size", "(SELECT * FROM tails WHERE pos < n)")
    lane = then(f"*, CASE size WHEN 8 THEN {_number('pos', 8)} WHEN 4 THEN {_number('pos', 4)} ELSE {_number('pos', 1)} END AS x", kind)
    whole = then(f"id, hx, n, pos, h, size, CASE size WHEN 8 THEN {times('x', _P2)} WHEN 4 THEN {times('x', _P1)} ELSE {times('x', _P5)} END AS x", lane)
    turned = then(f"id, hx, n, pos, h, size, CASE size WHEN 8 THEN {times(turn('x', 31), _P1)} ELSE x END AS x", whole)
    joined = then("id, hx, n, pos, size, xor(h, x) AS h", turned)
    rest = f"CASE size WHEN 8 THEN {plus(times(turn('h', 27), _P1), u(_P4))} WHEN 4 THEN {plus(times(turn('h', 23), _P2), u(_P3))} ELSE {times(turn('h', 11), _P1)} END"
    after = then(f"id, hx, n, pos + size, {rest}", joined)
    out = then("id, xor(h, h >> 33) AS h", "(SELECT * FROM tails WHERE pos >= n)")
    out = then(f"id, {times('h', _P2)} AS h", out)
    out = then(f"id, {times('xor(h, h >> 29)', _P3)} AS h", out)
    out = then("id, xor(h, h >> 32)::UBIGINT AS h", out)
    return f"(WITH RECURSIVE stripes AS (SELECT * FROM {begun} UNION ALL {step[1:-1]}), tails AS (SELECT * FROM {first} UNION ALL {after[1:-1]}) SELECT * FROM {out})"
