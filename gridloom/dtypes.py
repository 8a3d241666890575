"""Promotion of element types, casting rules and the types that reductions widen to."""

from __future__ import annotations

# Spark's type for each element type, and (kind, bits).
SPARK = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint",
    "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double",
    "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>", "str": "string",
}
_KIND = {"b": 0, "u": 1, "i": 2, "f": 4, "c": 5}


def _split(t: str) -> tuple[str, int]:
    if t == "bool":
        return "b", 1
    for name, kind in (("uint", "u"), ("int", "i"), ("float", "f"), ("complex", "c")):
        if t.startswith(name):
            return kind, int(t[len(name) :])
    raise TypeError(f"{t} doesn't promote")


def result_type(a: str, b: str) -> str:
    """The least type that holds both."""
    if a == b:
        return a
    (ka, na), (kb, nb) = sorted((_split(a), _split(b)), key=lambda x: _KIND[x[0]])
    if ka == "b":
        return b if _split(a)[0] == "b" else a
    if kb in "fc":
        part = nb // 2 if kb == "c" else nb
        need = {"u": lambda n: 16 if n == 8 else 32 if n == 16 else 64, "i": lambda n: 16 if n == 8 else 32 if n == 16 else 64,
                "f": lambda n: n, "c": lambda n: n // 2}[ka](na)
        bits = max(part, need)
        return f"complex{2 * max(bits, 32)}" if kb == "c" else f"float{bits}"
    if ka == kb:
        return f"{'uint' if ka == 'u' else 'int'}{max(na, nb)}"
    return f"int{max(nb, 2 * na)}" if 2 * na <= 64 else "float64"  # unsigned with signed


def can_cast(a: str, b: str, casting: str = "safe") -> bool:
    if casting in ("no", "equiv"):
        return a == b
    if casting == "unsafe":
        return True
    safe = result_type(a, b) == b
    return safe or (casting == "same_kind" and _KIND[_split(a)[0]] <= _KIND[_split(b)[0]])


def widened(t: str) -> str:
    """What a sum of this type is."""
    kind, _ = _split(t)
    return {"b": "int64", "i": "int64", "u": "uint64"}.get(kind, t)


def of_mean(t: str) -> str:
    return t if _split(t)[0] in "fc" else "float64"
